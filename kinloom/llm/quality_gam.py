"""Operator 8: quality classifier, a generalised additive model with pairwise interactions.

Each text is summarised by the features below. Boosting visits the features in turn; each step
fits a shallow tree on one feature's bins to the gradient of the logistic loss and adds it, shrunk,
to that feature's lookup table. Then the pairs that explain most of what is left get
two-dimensional tables, of which every cell takes a shrunk Newton step of its own, visited in turn
as well. A score is a sum of table entries, looked up for whole batches at once.

Features are computed and scored by tasks, a batch at a time. Only the features (not the texts) of
at most ``max_rows`` labelled rows reach the driver, where the tables, a few kilobytes, are fitted.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import held_out, labelled_sample

FEATURES = (
    "log_bytes log_words mean_word mean_line symbol_share upper_share digit_share punct_share bang_share bar_share "
    "distinct_share top_word_share same_next_share same_line_share end_mark_share short_line_share wide_share space_share"
).split()
#: The bound on labelled rows that a model is fitted on.
MAX_ROWS = 20_000


def features(text: str | None) -> list[float]:
    """The features of one whole text; null as the empty text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    words = b.split()
    m = max(1, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    count = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    return [
        np.log1p(len(b)), np.log1p(len(words)), sum(map(len, words)) / m, np.log1p(len(b) / k),
        count(b"#*$%&<>"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789"), count(b".,;:?'\"()-"), b.count(b"!") / m, b.count(b"|") / m,
        len(set(words)) / m, max(Counter(words).values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(set(lines)) / k,
        sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines) / k, sum(len(x) < 30 for x in lines) / k,
        sum(map(b.count, (b"\xc2", b"\xc3", b"\xe2"))) / n, count(b" \t\r\n"),
    ]


@dataclass
class Gam:
    intercept: float
    edges: list  # cut points of each feature
    tables: list  # a value for each bin
    coarse: list  # cut points of each feature in pairs
    pairs: list  # (i, j, table)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, (cut, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(cut, x[:, i], side="right")]
        if self.pairs:
            bins = [np.searchsorted(cut, x[:, i], side="right") for i, cut in enumerate(self.coarse)]
            for i, j, t in self.pairs:
                out += t[bins[i], bins[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values of a tree of up to `leaves` leaves over ordered bins with gradient sums g and hessian sums h."""
    parts = [(0, len(g))]
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = left_g**2 / (left_h + ridge) + (g[a:b].sum() - left_g) ** 2 / (h[a:b].sum() - left_h + ridge) - worth(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> Gam:
    """Without rows, or with one class only, the model is a constant: the smoothed share of label 1."""
    n, d = len(y), len(FEATURES)
    share = (y.sum() + 1) / (n + 2)
    out = Gam(float(np.log(share / (1 - share))), [_cuts(x[:, i], bins) for i in range(d)], [], [_cuts(x[:, i], pair_bins) for i in range(d)], [])
    out.tables = [np.zeros(len(c) + 1) for c in out.edges]
    if not n or y.min() == y.max():
        return out
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(out.edges)]
    f = np.full(n, out.intercept)

    def grads():
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(d):
            g, h = grads()
            t = rate * _tree(*(np.bincount(at[i], w, len(out.tables[i])) for w in (g, h)))
            out.tables[i] += t
            f += t[at[i]]
    low = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(out.coarse)]
    size = [len(c) + 1 for c in out.coarse]
    cell = lambda i, j: low[i] * size[j] + low[j]
    g, h = grads()
    gain = []
    for i in range(d):
        for j in range(i):
            a, b = (np.bincount(cell(i, j), w, size[i] * size[j]) for w in (g, h))
            gain.append(((a**2 / (b + 1)).sum(), i, j))
    chosen = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in sorted(gain, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            g, h = grads()
            k = cell(i, j)
            a, b = (np.bincount(k, w, t.size) for w in (g, h))
            step = rate * a / (b + 1)
            t += step.reshape(t.shape)
            f += step[k]
    out.pairs = chosen
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "quality") -> Gam:
    """Fit on at most max_rows labelled rows, none of them held out; see `labelled_sample`."""
    summarise = lambda texts: pa.array([features(t) for t in texts], pa.list_(pa.float64()))
    got = sorted((r["id"], r["y"], tuple(r["x"])) for r in labelled_sample(docs, labels, label, max_rows, summarise, "array<double>").collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Gam, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. A null text scores as the empty text;
    repeated rows score alike; an empty table gives an empty result; other columns are not read."""

    def add(batches):
        for batch in batches:
            text = batch.column("text").to_pylist()
            s = model.scores(np.array([features(t) for t in text]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(add, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: Gam, cut: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the cut."""

    def keep(batches):
        for batch in batches:
            s = model.scores(np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(s >= cut))

    return docs.mapInArrow(keep, docs.schema)
