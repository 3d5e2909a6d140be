"""Operator 2: toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first five, six and seven bytes of longer words, hashed into
``BUCKETS`` buckets; a text is the set of its buckets. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): the pair part lets two terms together mean more
(an insult beside a group mention) than their weights add up to. Rendle, "Factorization Machines"
(2010).

Two kinds of buckets are active, at most ``MAX_ACTIVE`` of each: those that tell the classes apart
by themselves, and those that do so among the rows that have a certain one of the ``MAX_INSULTS``
which lean most to label 1, as a group mention may that is as common in clean texts. They are
counted by Spark over a sample of at most ``max_rows`` labelled rows; what reaches the driver of a
row is its active buckets, so the model and the fit have a fixed size. A pair of terms of which neither says anything
alone is not learnt. Scoring runs in tasks, a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import held_out, labelled_sample

BUCKETS = 1 << 18
#: The bound on active buckets of each kind, and how many rows and standard errors one needs.
MAX_ACTIVE, MIN_ROWS, MIN_Z = 1024, 3, 3.5
#: The same for terms beside one of so many others, with the least variance of a count: more is asked as more is tried.
MAX_INSULTS, MIN_VARIANCE_BESIDE, MIN_Z_BESIDE = 64, 5, 5.0
#: The bound on labelled rows that a model is fitted on.
MAX_ROWS = 10_000
FACTORS = 8
#: Bytes of the beginnings of longer words that are terms too.
STEMS = (5, 6, 7)
_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """The distinct buckets of one whole text, sorted; none for null or empty texts."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split())
    starts = {w[:k] for w in words for k in STEMS if len(w) > k}
    found = [crc32(w) for w in words]
    found += [crc32(w, 0x5EED) for w in starts]
    return np.unique(np.array(found, np.uint32) & np.uint32(BUCKETS - 1)).astype(np.int32)


@dataclass
class FactorizationMachine:
    w0: float
    slot: np.ndarray  # place of a bucket among the active ones, or -1
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of many texts at once, given by their buckets."""
        n = len(rows)
        at = self.slot[np.concatenate(rows)] if n else np.zeros(0, np.int32)
        row = np.repeat(np.arange(n), [len(r) for r in rows])[at >= 0]
        at = at[at >= 0]
        total = lambda x: np.bincount(row, x, n)
        z = self.w0 + total(self.w[at])
        for v in self.v.T.astype(np.float64):
            z += 0.5 * (total(v[at]) ** 2 - total(v[at] ** 2))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, active: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> FactorizationMachine:
    """Adam on the logistic loss over rows of buckets, of which the active ones count. Without rows or
    active buckets, or with one class only, the model is a constant."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    w0 = float(np.log(share / (1 - share)))
    slot = np.full(BUCKETS, -1, np.int32)
    if not n or y.min() == y.max() or not len(active):
        return FactorizationMachine(w0, slot, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    slot[active] = np.arange(len(active))
    x = np.zeros((n, len(active)), np.float32)
    for i, b in enumerate(rows):
        at = slot[b]
        x[i, at[at >= 0]] = 1
    rng = np.random.default_rng(seed)
    params = [np.array([w0], np.float32), np.zeros(len(active), np.float32), rng.normal(0, 0.01, (len(active), FACTORS)).astype(np.float32)]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            _, w, v = params
            xv = xb @ v
            f = params[0][0] + xb @ w + 0.5 * ((xv**2).sum(1) - xb @ (v**2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - yb).astype(np.float32) / len(yb)
            grads = [np.array([e.sum()], np.float32), xb.T @ e + decay * w, xb.T @ (e[:, None] * xv) - (xb.T @ e)[:, None] * v + decay * v]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(float(params[0][0]), slot, params[1], params[2])


def _z(mean: Column) -> Column:
    """How many standard errors the share of label 1 in n rows, pos of them, lies from the mean."""
    return (F.col("pos") - F.col("n") * mean) / F.sqrt(F.col("n") * mean * (1 - mean))


def telling(sample: DataFrame) -> list[tuple[int, float]]:
    """(bucket, z) of the buckets of sample (y, x) that tell the classes apart most."""
    n, mean = sample.agg(F.count("*"), F.avg("y")).first()
    if not n or mean in (0, 1):
        return []
    counted = sample.select(F.explode("x").alias("b"), "y").groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    best = counted.where(F.col("n") >= MIN_ROWS).select("b", _z(F.lit(mean)).alias("z")).where(F.abs("z") >= MIN_Z)
    return [tuple(r) for r in best.orderBy(F.abs("z").desc(), "b").limit(MAX_ACTIVE).collect()]


def telling_beside(sample: DataFrame, insults: list[int]) -> list[int]:
    """Buckets that tell the classes apart most among the rows that have one of the insults."""
    met = sample.select(F.explode(F.array_intersect("x", F.lit(insults).cast("array<int>"))).alias("a"), "x", "y")
    own = met.groupBy("a").agg(F.avg("y").alias("mean"))  # MAX_INSULTS rows
    counted = met.select("a", F.explode("x").alias("b"), "y").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    z = counted.join(F.broadcast(own), "a").where(F.col("n") * F.col("mean") * (1 - F.col("mean")) >= MIN_VARIANCE_BESIDE).groupBy("b").agg(F.max(F.abs(_z(F.col("mean")))).alias("z"))
    return [r["b"] for r in z.where(F.col("z") >= MIN_Z_BESIDE).orderBy(F.col("z").desc(), "b").limit(MAX_ACTIVE).collect()]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic") -> FactorizationMachine:
    """Fit on at most max_rows labelled rows, none of them held out; see `labelled_sample`."""
    sample = labelled_sample(docs, labels, label, max_rows, lambda texts: pa.array([terms(t) for t in texts], pa.list_(pa.int32())), "array<int>")
    alone = telling(sample)
    insults = [b for b, z in alone if z > 0][:MAX_INSULTS]
    active = np.array(sorted({*(b for b, _ in alone), *(telling_beside(sample, insults) if insults else ())}), np.int64)
    kept = F.array_intersect("x", F.lit(active.tolist()).cast("array<int>"))  # at most 2 * MAX_ACTIVE of a row
    got = sorted((r["id"], r["y"], sorted(r["x"])) for r in sample.select("id", "y", kept.alias("x")).collect())
    return fit([np.array(r[2], np.int64) for r in got], np.array([r[1] for r in got]), active)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. A null or empty text scores w0 alone;
    repeated rows score alike; an empty table gives an empty result; other columns are not read."""

    def add(batches):
        for batch in batches:
            s = model.scores([terms(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(add, "doc_id long, held_out boolean, score double, predicted int")
