"""Ranks, frames and loudness over rows against numpy."""

import math
import random

import numpy as np
import pytest

from kinloom.operators import audio, samples
from kinloom.operators.quantile import nearest_ranks


def test_nearest_ranks(spark):
    rng = random.Random(1)
    groups = {
        "hot": [rng.gauss(0, 1e3) for _ in range(6000)], "ties": [1.5] * 500 + [2.0, -3.0], "one": [7.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        "close": [1 + k * 2.0**-52 for k in range(300)], "zero": [0.0, -0.0, 0.0, 5e-324, -5e-324], "ends": [math.inf, -math.inf, 1.0, 2.0], None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("nan", math.nan), ("one", math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n double").repartition(5)
    got = {(r["g"], r["share"]): (r["n"], r["value"]) for r in nearest_ranks(df, "g", "n", (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    want = {(g, p): (len(v), sorted(v)[min(len(v) - 1, int(p * len(v)))]) for g, v in groups.items() for p in (0.0, 0.1, 0.5, 0.9, 1.0)}
    assert got == want


def test_no_rows_no_ranks(spark):
    assert nearest_ranks(spark.createDataFrame([], "g int, v int"), "g", "v", (0.5,)).count() == 0


def test_measures_of_rows_are_those_of_arrays(spark):
    rng = np.random.default_rng(2)
    takes = {"a": rng.normal(0, 0.2, 3333), "b": np.clip(rng.normal(0, 0.9, 2000), -1, 1), "short": rng.normal(0, 0.1, 700), "silent": np.zeros(1700)}
    rows = [(k, i, float(v)) for k, x in takes.items() for i, v in enumerate(x)] + [("void", 0, None)]
    df = spark.createDataFrame(rows, "take string, i long, v double").repartition(7)
    got = {r["recording"]: r for r in samples.measures(df, "take", "i", "v", 320).collect()}
    assert set(got) == set(takes)
    for k, x in takes.items():
        want, r = audio.measure(x * audio.FULL_SCALE), got[k]
        assert r["samples"] == len(x) and r["frames"] == len(x) // 320
        for own, name in (("rms_db", "loudness_dbfs"), ("peak_db", "peak_dbfs"), ("noise_db", "noise_floor_dbfs"), ("snr_db", "snr_db")):
            assert (r[own] is None) == (want[name] is None) and (r[own] is None or r[own] == pytest.approx(want[name], abs=0.006)), (k, own)
        assert r["clip_pct"] == pytest.approx(want["clipping_pct"], abs=0.0006)


@pytest.mark.parametrize("rate", [8000, 16000])
def test_loudness_of_rows(spark, rate):
    rng = np.random.default_rng(3)
    t = np.arange(2 * rate) / rate
    takes = {
        "tone": np.stack([0.5 * np.sin(2 * np.pi * 997 * t)] * 2, 1), "hum": np.stack([0.3 * np.sin(2 * np.pi * 45 * t) + 0.05, 0.1 * rng.normal(size=len(t))], 1),
        "steps": np.concatenate([np.zeros(rate // 2), 0.4 * rng.normal(size=rate), np.full(rate // 3 + 7, 0.9)])[:, None], "silent": np.zeros((rate, 1)), "short": 0.5 * np.ones((rate // 4, 1)),
    }
    rows = [(k, c, i, float(v)) for k, x in takes.items() for c in range(x.shape[1]) for i, v in enumerate(x[:, c])]
    df = spark.createDataFrame(rows, "take string, c int, i long, v double").repartition(6)
    found = samples.loudness(df, "take", "c", "i", "v", rate)
    got = {r["recording"]: r["lufs"] for r in found.collect()}
    for k, x in takes.items():
        want = audio.integrated_lufs(x, rate)
        assert (got[k] is None) == (want is None) and (want is None or got[k] == pytest.approx(want, abs=0.1)), k


def test_states_are_composed_without_loss():
    for rate in (8000, 48000):
        over = np.linalg.matrix_power(samples.transition(rate), rate // 10)
        assert np.abs(over).max() < 1e-3 and np.abs(np.linalg.eigvals(samples.transition(rate))).max() < 1


def test_loudness_of_events(spark):
    from kinloom import queries

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").select("value").collect()
    x = np.array([r[0] for r in rows]) / 50 - 1
    got = {r["recording"]: r["lufs"] for r in queries.event_loudness(spark, sf).collect()}
    assert len(got) == math.ceil(len(x) / 20_000)
    for k, lufs in got.items():
        assert lufs == pytest.approx(audio.integrated_lufs(x[int(k) * 20_000 : (int(k) + 1) * 20_000, None], 8000), abs=0.1)
