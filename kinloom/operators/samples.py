"""G3 to G8 on rows of samples: recordings of any length, spread over any number of tasks.

A frame's state (sum of squares, samples, peak, clipped samples) merges with that of other frames, so a
recording is measured from its frames. Loudness runs the K-weighting filter, a linear recurrence with four
numbers of state, over blocks of 100 ms at once: a block maps its first state to its last by a fixed matrix
and an offset, offsets of the blocks before give each block its first state, and each block is filtered
again from there. The matrix fades so fast that offsets of a few blocks give all that doubles can hold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.audio import CLIP, FLOOR_DB, MIN_FRAMES
from kinloom.operators.quantile import nearest_ranks
from kinloom.shared import scratch, written

#: Effects of states below it are lost in doubles anyway.
FADED = 1e-17
NOISE, SIGNAL = 0.10, 0.90


def decibels(v: Column) -> Column:
    return F.when(v > 0, F.greatest(F.lit(FLOOR_DB), 20 * F.log10(v))).otherwise(F.lit(FLOOR_DB))


def frames(samples: DataFrame, recording: str, place: str, value: str, frame: int) -> DataFrame:
    """Recording, frame, squares, n, peak, clipped of tumbling frames of `frame` samples, by their places
    from 0; the last of a recording may have fewer. Values are shares of full scale; null ones are no samples."""
    x = F.col(f"`{value}`").cast("double")
    rows = samples.where(x.isNotNull()).select(F.col(f"`{recording}`").alias("recording"), F.floor(F.col(f"`{place}`") / frame).cast("long").alias("frame"), x.alias("x"))
    return rows.groupBy("recording", "frame").agg(
        F.sum(F.col("x") * F.col("x")).alias("squares"), F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"), F.count_if(F.abs("x") >= CLIP).alias("clipped")
    )


def frame_levels(states: DataFrame, frame: int) -> DataFrame:
    """recording, frame, level_db of whole frames."""
    return states.where(F.col("n") == frame).select("recording", "frame", decibels(F.sqrt(F.col("squares") / F.col("n"))).alias("level_db"))


def measures(samples: DataFrame, recording: str, place: str, value: str, frame: int, min_frames: int = MIN_FRAMES) -> DataFrame:
    """Recording, samples, frames, rms_db, peak_db, clip_pct, noise_db, snr_db. The latter two are null
    below min_frames whole frames. Recordings without a sample are absent; a null recording is one."""
    spark = samples.sparkSession
    with scratch(spark):
        states = written(frames(samples, recording, place, value, frame), "frames", tidy=True)
        whole = F.count_if(F.col("n") == frame)
        total = states.groupBy("recording").agg(
            F.sum("n").alias("samples"), whole.alias("frames"), decibels(F.sqrt(F.sum("squares") / F.sum("n"))).alias("rms_db"), decibels(F.max("peak")).alias("peak_db"),
            (100 * F.sum("clipped") / F.sum("n")).alias("clip_pct"),
        )
        ranks = nearest_ranks(frame_levels(states, frame), "recording", "level_db", (NOISE, SIGNAL))
        levels = ranks.where(F.col("n") >= min_frames).groupBy("recording").agg(F.max(F.when(F.col("share") == NOISE, F.col("value"))).alias("noise_db"), F.max(F.when(F.col("share") == SIGNAL, F.col("value"))).alias("signal_db"))
        levels = levels.withColumnRenamed("recording", "r")
        joined = total.join(levels.hint("merge"), F.col("recording").eqNullSafe(F.col("r")), "left")
        return written(joined.select("recording", "samples", "frames", "rms_db", "peak_db", "clip_pct", "noise_db", (F.col("signal_db") - F.col("noise_db")).alias("snr_db")), "measures", keep=True, tidy=True)


def k_weighting(rate: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The shelf and the high-pass filter of ITU-R BS.1770 for a rate, each as b0, b1, b2, a1, a2."""
    # Fixed values of the standard's analogue prototypes: frequency, gain in dB, quality, exponent of the middle gain.
    shelf_hz, shelf_db, shelf_q, middle = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
    pass_hz, pass_q = 38.13547087602444, 0.5003270373238773
    k, v = np.tan(np.pi * shelf_hz / rate), 10 ** (shelf_db / 20)
    d, w = 1 + k / shelf_q + k * k, v**middle
    shelf = ((v + w * k / shelf_q + k * k) / d, 2 * (k * k - v) / d, (v - w * k / shelf_q + k * k) / d, 2 * (k * k - 1) / d, (1 - k / shelf_q + k * k) / d)
    k = np.tan(np.pi * pass_hz / rate)
    d = 1 + k / pass_q + k * k
    return tuple(map(float, shelf)), (1.0, -2.0, 1.0, float(2 * (k * k - 1) / d), float((1 - k / pass_q + k * k) / d))


def transition(rate: int) -> np.ndarray:
    """The matrix that takes the filters' state (two numbers each) over one sample of silence."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, e1, e2) = k_weighting(rate)
    # y = s0 leaves the shelf; z = c0 * y + s2 leaves the high-pass.
    return np.array([[-a1, 1, 0, 0], [-a2, 0, 0, 0], [c1 - e1 * c0, 0, -e1, 1], [c2 - e2 * c0, 0, -e2, 0]])


def _run(x: Column, first: Column, rate: int) -> Column:
    """The state, and the sum of squares that left the filters, after the samples of an array."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, e1, e2) = k_weighting(rate)

    def step(s: Column, v: Column) -> Column:
        y = b0 * v + s["s0"]
        z = c0 * y + s["s2"]
        return F.struct(
            (b1 * v - a1 * y + s["s1"]).alias("s0"), (b2 * v - a2 * y).alias("s1"), (c1 * y - e1 * z + s["s3"]).alias("s2"), (c2 * y - e2 * z).alias("s3"), (s["e"] + z * z).alias("e")
        )

    return F.aggregate(x, first, step)


def _state(values: list[Column]) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(("s0", "s1", "s2", "s3", "e"), [*values, F.lit(0.0)])])


def loudness(samples: DataFrame, recording: str, channel: str, place: str, value: str, rate: int) -> DataFrame:
    """Recording, lufs: integrated loudness by ITU-R BS.1770-4 of samples at one rate, null where no block of
    400 ms passes the gates.

    Channels 0 and 1 count. Places run from 0 without gaps; a block of 100 ms with a gap or a null is left out,
    as is the rest after the last whole one. A recording without samples is absent.
    """
    size = rate // 10
    over = np.linalg.matrix_power(transition(rate), size)
    powers = [np.eye(4)]  # how much of the last blocks' offsets is left
    while np.abs(powers[-1]).max() > FADED:
        powers.append(powers[-1] @ over)
    spark = samples.sparkSession
    key = ["recording", "channel", "block"]
    c = {x: F.col(f"`{x}`") for x in (recording, channel, place, value)}
    with scratch(spark):
        rows = samples.where(c[channel].isin(0, 1) & c[value].isNotNull()).select(
            F.coalesce(c[recording].cast("string"), F.lit("\0")).alias("recording"), c[channel].cast("int").alias("channel"), F.floor(c[place] / size).cast("long").alias("block"),
            F.struct(c[place].alias("i"), c[value].cast("double").alias("x")).alias("v"),
        )
        blocks = rows.groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias("v")).where(F.size("v") == size)  # rate / 10 samples
        blocks = written(blocks.select(*key, F.transform("v", lambda v: v["x"]).alias("x")), "blocks", tidy=True)
        offsets = blocks.select(*key, _run(F.col("x"), _state([F.lit(0.0)] * 4), rate).alias("s"))
        moved = offsets.select("recording", "channel", "block", "s", F.posexplode(F.array(*[F.array(*[F.array(*map(F.lit, map(float, row))) for row in m]) for m in powers])).alias("age", "m"))
        times = [reduce(lambda a, b: a + b, [F.col("m")[i][j] * F.col(f"s.s{j}") for j in range(4)]) for i in range(4)]
        first = moved.select("recording", "channel", (F.col("block") + 1 + F.col("age")).alias("block"), *[t.alias(f"p{i}") for i, t in enumerate(times)])
        first = first.groupBy(*key).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)])
        energy = blocks.join(first.hint("merge"), key, "left").select("recording", "block", _run(F.col("x"), _state([F.coalesce(f"p{i}", F.lit(0.0)) for i in range(4)]), rate)["e"].alias("e"))
        per = energy.groupBy("recording", "block").agg(F.sum("e").alias("e"))
        wide = per.select("recording", "e", F.explode(F.sequence(F.col("block") - 3, F.col("block"))).alias("begin"))
        wide = wide.groupBy("recording", "begin").agg(F.sum("e").alias("e"), F.count("*").alias("n")).where("n = 4")
        wide = written(wide.select("recording", (F.col("e") / (4 * size)).alias("z")), "gated", tidy=True)
        level = lambda p: F.lit(-0.691) + 10 * F.log10(F.greatest(p, F.lit(1e-20)))
        loud = wide.where(level(F.col("z")) > -70)
        gate = loud.groupBy("recording").agg((level(F.avg("z")) - 10).alias("gate"))
        result = loud.join(gate.hint("merge"), "recording").where(level(F.col("z")) > F.col("gate")).groupBy("recording").agg(level(F.avg("z")).alias("lufs"))
        every = rows.select("recording").distinct().join(result.hint("merge"), "recording", "left")
        return written(every.select(F.nullif("recording", F.lit("\0")).alias("recording"), F.round("lufs", 1).alias("lufs")), "loudness", keep=True, tidy=True)
