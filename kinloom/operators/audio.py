"""What a recording measures, from bytes to a verdict.

Decoding and measuring run in numpy on batches of files; the verdict and all fallbacks are columns.
WAV (PCM of 8 to 32 bits) is decoded; other containers end in analysis_error, as no decoder is here.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, FRAME_MS, CLIP, FULL_SCALE, FLOOR_DB, MIN_FRAMES = 16_000, 20, 0.99, 32_768, -120.0, 5
MEASURES = (
    "duration_sec double, sample_rate_hz int, bitrate_kbps double, channels int, codec string, size_bytes long, loudness_dbfs double, peak_dbfs double, "
    "loudness_lufs double, noise_floor_dbfs double, snr_db double, clipping_pct double, bitrate_source string, analysis_error string"
)
#: Fixed value: the verdict on a recording whose noise cannot be told from its signal.
UNMEASURED = "unknown (SNR not measurable - continuous audio with no pauses)"
CODECS = {1: "pcm_u8", 2: "pcm_s16le", 3: "pcm_s24le", 4: "pcm_s32le"}


def dbfs(linear):
    with np.errstate(divide="ignore"):
        return np.maximum(FLOOR_DB, 20 * np.log10(np.maximum(linear, 0)))


def _fixed(x, places: int = 2):
    return None if x is None or not np.isfinite(x) else round(float(x), places)


def nearest_rank(sorted_, p: float):
    """A13."""
    return sorted_[min(len(sorted_) - 1, int(p * len(sorted_)))]


def measure(samples: np.ndarray) -> dict | None:
    """G3 to G7 of 16-bit mono samples at 16 kHz; None without samples."""
    if not len(samples):
        return None
    x = samples.astype(np.float64)
    frame = RATE * FRAME_MS // 1000
    n = len(x) // frame
    out = {"loudness_dbfs": dbfs(np.sqrt(np.mean(x**2)) / FULL_SCALE), "peak_dbfs": dbfs(np.abs(x).max() / FULL_SCALE), "noise_floor_dbfs": None, "snr_db": None}
    if n >= MIN_FRAMES:
        levels = np.sort(dbfs(np.sqrt((x[: n * frame].reshape(n, frame) ** 2).mean(1)) / FULL_SCALE))
        out["noise_floor_dbfs"] = nearest_rank(levels, 0.10)
        out["snr_db"] = nearest_rank(levels, 0.90) - out["noise_floor_dbfs"]
    return {k: _fixed(v) for k, v in out.items()} | {"clipping_pct": _fixed(100 * np.mean(np.abs(x) >= CLIP * FULL_SCALE), 3)}


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int, int]:
    """(samples as floats of -1 to 1 by channel, rate, channels, bytes a sample)."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float64) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / (1 << 8 * width - 1)
    return x[: len(x) // channels * channels].reshape(-1, channels), rate, channels, width


def to_analysis(x: np.ndarray, rate: int) -> np.ndarray:
    """Mono 16-bit at 16 kHz, resampled linearly."""
    mono = x.mean(1)
    if rate != RATE and len(mono):
        n = int(len(mono) * RATE / rate)
        mono = np.interp(np.arange(n) * rate / RATE, np.arange(len(mono)), mono)
    return np.clip(np.round(mono * FULL_SCALE), -FULL_SCALE, FULL_SCALE - 1).astype(np.int16)


def _biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """A second-order filter, run by blocks of its impulse response (which fades within 0.2 s)."""
    n = 1 << 14
    h, z = np.zeros(n), np.zeros(n)
    z[0] = 1
    for i in range(n):
        h[i] = b[0] * z[i] + (b[1] * z[i - 1] if i else 0) + (b[2] * z[i - 2] if i > 1 else 0) - (a[1] * h[i - 1] if i else 0) - (a[2] * h[i - 2] if i > 1 else 0)
    size = 1 << int(np.ceil(np.log2(len(x) + n)))
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def integrated_lufs(x: np.ndarray, rate: int) -> float | None:
    """ITU-R BS.1770-4: K-weighting, 400 ms blocks with 75 % overlap, absolute and relative gates."""
    step, block = rate // 10, 4 * (rate // 10)
    if len(x) < block:
        return None

    def shelf(f0=1681.974450955533, gain=3.999843853973347, q=0.7071752369554196):
        k, v = np.tan(np.pi * f0 / rate), 10 ** (gain / 20)
        w, d = v**0.4996667741545416, 1 + k / q + k * k
        return ((v + w * k / q + k * k) / d, 2 * (k * k - v) / d, (v - w * k / q + k * k) / d), (1, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)

    def high_pass(f0=38.13547087602444, q=0.5003270373238773):
        k = np.tan(np.pi * f0 / rate)
        d = 1 + k / q + k * k
        return (1, -2, 1), (1, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)

    power = np.zeros(len(x))
    for c in range(min(2, x.shape[1])):
        power += _biquad(_biquad(x[:, c], *shelf()), *high_pass()) ** 2
    total = np.concatenate([[0], np.cumsum(power)])
    starts = np.arange(0, len(x) - block + 1, step)
    z = (total[starts + block] - total[starts]) / block
    level = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-20))
    z = z[level(z) > -70]
    if len(z):
        z = z[level(z) > level(z.mean()) - 10]
    return _fixed(level(z.mean()), 1) if len(z) else None


def analyse(data: bytes | None) -> dict:
    """G1 to G8, G10 of one file; what fails is null and named in analysis_error."""
    out = dict.fromkeys(c.split()[0] for c in MEASURES.split(", "))
    data = data or b""
    try:
        x, rate, channels, width = decode_wav(data)
    except Exception as e:  # noqa: BLE001  any damage of the file
        return out | {"analysis_error": f"probe failed: {str(e) or type(e).__name__}".split("\n")[0]}
    seconds = len(x) / rate if rate else 0
    declared = rate * channels * width * 8
    out |= {"size_bytes": len(data), "sample_rate_hz": rate, "channels": channels, "codec": CODECS.get(width), "duration_sec": _fixed(seconds, 3) or None}
    out |= {"bitrate_kbps": _fixed(declared / 1000, 1) or None, "bitrate_source": "declared" if declared else None}
    found = measure(to_analysis(x, rate))
    if found is None:
        return out | {"analysis_error": "decoded to no samples"}
    return out | found | {"loudness_lufs": integrated_lufs(x, rate)}


def quality_label(snr: Column, clipping: Column, loudness: Column) -> Column:
    """G9."""
    reasons = lambda *more: F.array_compact(F.array(F.when(clipping > 1, "clipped"), F.when(loudness < -45, "very quiet"), *more))
    without, all_ = reasons(), reasons(F.when(snr < 10, "noisy"))
    text = lambda label, r: F.concat(F.lit(f"{label} ("), F.array_join(r, ", "), F.lit(")"))
    unusable = snr.isNull() | (snr < 3)
    return (
        F.when(unusable & (F.size(without) > 0), text("poor", without)).when(unusable, UNMEASURED)
        .when(F.size(all_) == 0, F.when(snr >= 25, "good").otherwise("fair")).when(F.size(all_) == 1, text("fair", all_)).otherwise(text("poor", all_))
    )


def analyse_files(files: DataFrame) -> DataFrame:
    """Files of spark.read.format("binaryFile") with their measures and quality_label."""

    def run(batches):
        for pdf in batches:
            rows = [analyse(b) for b in pdf["content"]]
            yield pd.concat([pdf[["path"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1).astype(object).where(lambda d: d.notna(), None)

    out = files.select("path", "content").mapInPandas(run, f"path string, {MEASURES}")
    return out.withColumn("quality_label", F.when(F.col("loudness_dbfs").isNotNull(), quality_label(F.col("snr_db"), F.col("clipping_pct"), F.col("loudness_dbfs"))))


def sample_measures(samples: Column, frame: int, min_frames: int = MIN_FRAMES) -> Column:
    """G3 to G7 as columns, for samples of -1 to 1 in an array: rms_db, peak_db, clip_pct, noise_db, snr_db."""
    x = samples
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    db = lambda v: F.when(v > 0, F.greatest(F.lit(FLOOR_DB), 20 * F.log10(v))).otherwise(F.lit(FLOOR_DB))
    n = F.floor(F.size(x) / frame).cast("int")
    levels = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: db(F.sqrt(square(F.slice(x, i * frame + 1, frame)) / frame))))
    at = lambda p: F.get(levels, F.least(n - 1, F.floor(F.lit(p) * n).cast("int")))
    enough = n >= min_frames
    return F.struct(
        db(F.sqrt(square(x) / F.size(x))).alias("rms_db"), db(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))).alias("peak_db"),
        (100 * F.size(F.filter(x, lambda v: F.abs(v.cast("double")) >= CLIP)) / F.size(x)).alias("clip_pct"),
            F.when(enough, at(0.1)).alias("noise_db"), F.when(enough, at(0.9) - at(0.1)).alias("snr_db"),
    )
