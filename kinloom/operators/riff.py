"""G1 in Columns: what a WAV file says of itself, by a fold over its chunks; no Python runs per file.

A chunk has four letters, its length (little-endian) and that many bytes, and begins at an even place.
Chunks are walked from the start to `data`; the fold takes as many steps as the longest walk of all files needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.audio import CODECS

#: Letters of chunks, in hexadecimal, and the format tags of other codecs than PCM.
RIFF, WAVE, FORMAT, DATA = "52494646", "57415645", "666D7420", "64617461"
PCM, FLOAT, A_LAW, MU_LAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
FIRST_STEPS = 16


def _hex(content: Column, at: Column, n: int) -> Column:
    return F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))


def _number(content: Column, at: Column, n: int) -> Column:
    """The little-endian number of n bytes at a place; null behind the end."""
    h = _hex(content, at, n)
    return F.when(F.length(h) == 2 * n, F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long"))


def _walk(content: Column, steps: int) -> Column:
    """at (the next chunk), format, data (where these bodies begin), length (of data, as declared), done."""
    none = F.lit(None).cast("long")
    size = F.length(content)
    whole = (_hex(content, F.lit(0), 4) == RIFF) & (_hex(content, F.lit(8), 4) == WAVE)
    first = F.struct(F.lit(12).cast("long").alias("at"), none.alias("format"), none.alias("data"), none.alias("length"), (~F.coalesce(whole, F.lit(False))).alias("done"))

    def step(s: Column, _: Column) -> Column:
        name, n, body = _hex(content, s["at"], 4), _number(content, s["at"] + 4, 4), s["at"] + 8
        over = s["done"] | (body > size)
        found = ~over & (name == DATA)
        new = F.struct(
            F.when(over | found, s["at"]).otherwise(body + n + n % 2).alias("at"), F.when(~over & (name == FORMAT) & s["format"].isNull(), body).otherwise(s["format"]).alias("format"),
            F.when(found, body).otherwise(s["data"]).alias("data"), F.when(found, n).otherwise(s["length"]).alias("length"), (over | found).alias("done"),
        )
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)


def probe(files: DataFrame) -> DataFrame:
    """path and G1 of files (path, content): duration_sec, sample_rate_hz, channels, bits, codec, size_bytes, bitrate_kbps,
    bitrate_source, frames, probe_error.

    The bitrate is the one declared, else size * 8 / duration; what cannot be told is null. Data cut short, or of a
    length that was never filled in, counts as far as it goes. Without a header, a format or data there is an error and
    nothing else but the size. A null content is an empty file. Rows that repeat are probed one by one.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    steps = FIRST_STEPS
    while not files.select(_walk(content, steps)["done"].alias("done")).where("NOT done").isEmpty():
        steps *= 2
    walked = files.select("path", content.alias("content"), _walk(content, steps).alias("w"))
    at = lambda k, n: _number(F.col("content"), F.col("w.format") + k, n)
    short = F.col("w.format").isNotNull() & (F.col("w.format") + 16 > F.length("content"))
    error = (
        F.when(~F.coalesce((_hex(F.col("content"), F.lit(0), 4) == RIFF) & (_hex(F.col("content"), F.lit(8), 4) == WAVE), F.lit(False)), "probe failed: no RIFF header")
        .when(F.col("w.format").isNull() | short, "probe failed: no format").when(F.col("w.data").isNull(), "probe failed: no data")
    )
    found = walked.select(
        "path", F.length("content").cast("long").alias("size"), error.alias("error"), at(0, 2).alias("tag"), at(2, 2).alias("channels"), at(4, 4).alias("rate"), at(8, 4).alias("bytes"),
        at(12, 2).alias("block"), at(14, 2).alias("bits"), at(24, 2).alias("sub"), F.least("w.length", F.length("content") - F.col("w.data")).alias("length"),
    ).withColumn("tag", F.when(F.col("tag") == EXTENSIBLE, F.col("sub")).otherwise(F.col("tag")))
    fine = F.col("error").isNull()
    frames = F.when(fine & (F.col("block") > 0), F.floor(F.col("length") / F.col("block")))
    seconds = F.when((frames > 0) & (F.col("rate") > 0), frames / F.col("rate"))
    declared, derived = F.when(fine & (F.col("bytes") > 0), F.col("bytes") * 8), F.col("size") * 8 / seconds
    pcm = F.coalesce(*[F.when(F.col("bits") == 8 * width, name) for width, name in CODECS.items()])
    codec = F.when(F.col("tag") == PCM, pcm).when(F.col("tag") == FLOAT, F.concat(F.lit("pcm_f"), F.col("bits"), F.lit("le"))).when(F.col("tag") == A_LAW, "pcm_alaw").when(F.col("tag") == MU_LAW, "pcm_mulaw")
    some = lambda c: F.when(fine & (F.col(c) > 0), F.col(c)).cast("int").alias
    return found.select(
        "path", F.round(seconds, 3).alias("duration_sec"), some("rate")("sample_rate_hz"), some("channels")("channels"), some("bits")("bits"), F.when(fine, codec).alias("codec"), F.col("size").alias("size_bytes"),
        F.round(F.coalesce(declared, derived) / 1000, 1).alias("bitrate_kbps"), F.when(declared.isNotNull(), "declared").when(derived.isNotNull(), "derived from size/duration").alias("bitrate_source"),
        frames.cast("long").alias("frames"), F.col("error").alias("probe_error"),
    )
