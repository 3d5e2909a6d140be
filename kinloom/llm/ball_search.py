"""Operator 12: exact ranked lexical search by ball trees over sparse documents.

A document's score for an item is the sum of w * x over the item's terms, once each: w the term's weight
and x what the document has of it, both integers. With y = w * x on the document's side, that is the inner
product of y and a 0/1 vector of the item, which has length sqrt(number of terms). A subtree keeps the
centroid of its documents and the radius around it, so by Cauchy and Schwarz none of them scores more than
<item, centroid> + sqrt(terms) * radius. Bounds are raised by more than rounding can take from them;
subtrees whose bound is below an item's 50th score so far go unseen, best bounds come first, and what is
left is scored exactly at the leaves.

Items are searched in blocks of bounded size, which tasks receive whole; every block reads all documents.
A task builds a tree over some documents at a time, keeps each item's best so far across its trees, and
returns at most `top` rows an item. These are merged in two steps, so that no task gets all of an item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.shared import scratch, written

TOP = 50
#: A block of items ends before it has more items, distinct terms or bytes of terms than these; one item makes a block at least.
BLOCK_ITEMS, BLOCK_TERMS, BLOCK_BYTES = 512, 1 << 14, 1 << 20
#: Documents, and terms in them with repeats, of a tree at most; documents of a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 4096, 1 << 20, 64
#: Salts of the first merge.
SALTS = 64
#: Sums below it are exact in doubles.
EXACT = 1 << 53
#: a term's characters are 0-9, A-Z, a-z and all beyond ASCII; as bytes of UTF-8, those from x80 on.
_CHARS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, A-Z lower-cased, with repeats; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CHARS).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_ITEMS) -> Iterator[tuple[list, dict[bytes, int]]]:
    """Blocks of items as a list of (id, term numbers) and the numbers of the terms."""
    rows, vocabulary, size = [], {}, 0
    for r in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        own = Counter(terms(r[1]))
        fresh = [t for t in own if t not in vocabulary]
        size += sum(map(len, fresh))
        if rows and (len(rows) >= most or len(vocabulary) + len(fresh) > BLOCK_TERMS or size > BLOCK_BYTES):
            yield rows, vocabulary
            rows, vocabulary, size = [], {}, sum(map(len, own))
        for t in own:
            vocabulary.setdefault(t, len(vocabulary))
        rows.append((r[0], [vocabulary[t] for t in own]))
    if rows:
        yield rows, vocabulary


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n (terms with repeats), t, tf (of the vocabulary's terms, in order) of every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_TERMS and BLOCK_BYTES at most, or one item's

    def run(batches):
        numbers = known.value
        for batch in batches:
            ids, n, t, tf = [], [], [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(terms(text))
                if own:
                    found = sorted((numbers[x], c) for x, c in own.items() if x in numbers)
                    ids.append(id_)
                    n.append(own.total())
                    t.append([x for x, _ in found])
                    tf.append([c for _, c in found])
            lists = [pa.array(t, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["id", "n", "t", "tf"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, n long, t array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Tree:
    """A ball tree over documents: document i has the terms t[starts[i] : starts[i + 1]], ascending, with y, exact."""

    def __init__(self, starts: np.ndarray, t: np.ndarray, y: np.ndarray, leaf: int = LEAF):
        self.starts, self.t, self.y = starts, t, y
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.square = np.bincount(self.row, (y.astype(float)) ** 2, len(starts) - 1)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, float, tuple[int, int] | None]] = []
        self.leaf = leaf
        if len(starts) > 1:
            self._build(np.arange(len(starts) - 1))

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in t and y of the entries of docs, and which of docs each is of."""
        length = self.starts[docs + 1] - self.starts[docs]
        which = np.repeat(np.arange(len(docs)), length)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        return np.arange(length.sum()) - np.repeat(first - self.starts[docs], length), which

    def _distances(self, at: np.ndarray, which: np.ndarray, docs: np.ndarray, cols: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances of docs from a point, given on cols, which hold all terms of docs."""
        inner = np.bincount(which, self.y[at] * point[np.searchsorted(cols, self.t[at])], len(docs))
        return self.square[docs] - 2 * inner + point @ point

    def _build(self, root: np.ndarray) -> None:
        todo = [(root, None)]
        links: dict[int, list[int]] = {}
        while todo:
            docs, parent = todo.pop()
            at, which = self.entries(docs)
            cols, place = np.unique(self.t[at], return_inverse=True)
            centre = np.bincount(place, self.y[at], len(cols)) / len(docs)
            far = self._distances(at, which, docs, cols, centre)
            # The difference of large squares may lose this much to rounding.
            slack = 1e-9 * (self.square[docs].max(initial=0) + centre @ centre)
            radius = math.sqrt(max(0.0, far.max()) + slack) * (1 + 1e-9) + 1
            number = len(self.nodes)
            self.nodes.append((docs, cols, centre, radius, None))
            if parent is not None:
                links.setdefault(parent, []).append(number)
            if len(docs) > self.leaf:
                # Two documents far apart pull the others to their side; ties and equal documents are halved.
                a = self._dense(docs[far.argmax()], cols)
                from_a = self._distances(at, which, docs, cols, a)
                b = self._dense(docs[from_a.argmax()], cols)
                side = from_a - self._distances(at, which, docs, cols, b)
                order = np.argsort(side, kind="stable")
                cut = int(np.searchsorted(side[order], 0))
                cut = cut if len(docs) // 8 <= cut <= len(docs) - len(docs) // 8 else len(docs) // 2
                todo += [(docs[order[:cut]], number), (docs[order[cut:]], number)]
        for k, (one, two) in links.items():
            self.nodes[k] = (*self.nodes[k][:4], (one, two))

    def _dense(self, doc: int, cols: np.ndarray) -> np.ndarray:
        a, e = self.starts[doc], self.starts[doc + 1]
        out = np.zeros(len(cols))
        out[np.searchsorted(cols, self.t[a:e])] = self.y[a:e]
        return out

    def scores(self, docs: np.ndarray, cols: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Exact scores of docs, whose terms are cols: a row for each of docs, a column for each of items
        (0/1, a row for each of cols)."""
        at, which = self.entries(docs)
        kind = float if np.bincount(which, self.y[at], len(docs)).max(initial=0) < EXACT else np.int64
        dense = np.zeros((len(docs), len(cols)), kind)
        dense[which, np.searchsorted(cols, self.t[at])] = self.y[at]
        return (dense @ items.astype(kind)).astype(np.int64)


def search(tree: Tree, items: np.ndarray, floor: np.ndarray, take) -> int:
    """Score what may enter an item's best; the number of leaves seen.

    items: 0/1, a row for each term of the vocabulary and a column for each item; floor: each item's least score that still counts, raised by `take`, which is
    given documents, numbers of items and their scores.
    """
    if not tree.nodes:
        return 0
    reach = np.sqrt(items.sum(0, dtype=float))

    def bound(k: int) -> np.ndarray:
        _, cols, centre, radius, _ = tree.nodes[k]
        inner = centre @ items[cols].astype(float)
        return inner * (1 + 1e-9) + reach * radius + 1

    heap, seen = [(-np.inf, 0, bound(0))], 0
    while heap:
        _, k, most = heapq.heappop(heap)
        open_ = np.flatnonzero(most >= floor)
        if not len(open_):
            continue
        docs, cols, _, _, below = tree.nodes[k]
        if below is None:
            seen += 1
            take(docs, open_, tree.scores(docs, cols, items[cols][:, open_]))
            continue
        for child in below:
            b = bound(child)
            gain = b - floor
            if gain.max() >= 0:
                heapq.heappush(heap, (-float(gain.max()), child, b))
    return seen


class _Best:
    """Each item's `top` best (score descending, id ascending, null ids last) so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items)
        self.score = [np.empty(0, np.int64)] * n_items
        self.id = [np.empty(0, np.int64)] * n_items
        self.null = [np.empty(0, bool)] * n_items

    def take(self, ids: np.ndarray, null: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        enters = scores >= self.floor[items]
        for j in np.flatnonzero(enters.any(0)):
            k, rows = items[j], np.flatnonzero(enters[:, j])
            score = np.concatenate([self.score[k], scores[rows, j]])
            id_, none = np.concatenate([self.id[k], ids[rows]]), np.concatenate([self.null[k], null[rows]])
            order = np.lexsort((id_, none, -score))[: self.top]
            self.score[k], self.id[k], self.null[k] = score[order], id_[order], none[order]
            if len(order) == self.top:
                self.floor[k] = max(1, score[order[-1]])


def _searched(vectors: DataFrame, block: list, n_docs: int, n_terms: int, weights: np.ndarray, top: int) -> DataFrame:
    """q (number of the item in its block), id, score: each task's best."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(([own for _, own in block], weights))

    def flush(parts: list, items: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        ids, n, length, t, tf = (np.concatenate([p[i] for p in parts]) for i in range(5))
        null = np.concatenate([p[5] for p in parts])
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        x = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, length))
        tree = Tree(np.concatenate([[0], np.cumsum(length)]), t, weights[t] * x)
        search(tree, items, best.floor, lambda docs, open_, scores: best.take(ids[docs], null[docs], open_, scores))

    def run(batches):
        wanted, weights = shared.value
        items = np.zeros((len(weights), len(wanted)), np.int8)
        for k, own in enumerate(wanted):
            items[own, k] = 1
        best, parts, docs, size = _Best(len(wanted), top), [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                length = pc.list_value_length(b.column("t")).to_numpy().astype(np.int64)
                flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
                ids = b.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                parts.append((ids, b.column("n").to_numpy(), length, flat("t").astype(np.int64), flat("tf"), b.column("id").is_null().to_numpy(zero_copy_only=False)))
                docs, size = docs + b.num_rows, size + int(length.sum())
                if docs >= TREE_DOCS or size >= TREE_TERMS:
                    flush(parts, items, weights, best)
                    parts, docs, size = [], 0, 0
        if parts:
            flush(parts, items, weights, best)
        for k in range(len(wanted)):
            if len(best.score[k]):
                q = pa.array(np.full(len(best.score[k]), k, np.int32))
                yield pa.RecordBatch.from_arrays([q, pa.array(best.id[k], mask=best.null[k]), pa.array(best.score[k])], ["q", "id", "score"])

    return vectors.mapInArrow(run, "q int, id long, score long")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` best documents with a score above zero.

    Equal scores are in the order of ids, null ids last; rows that repeat are ranked one by one. A null
    text has no terms: such a document counts nowhere, such an item finds nothing. Items that share an id
    are searched one by one. Empty tables give an empty result. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for block, vocabulary in item_blocks(items, item_id, item_text, block_items):
        with scratch(spark):
            vectors = written(_vectors(docs, doc_id, doc_text, vocabulary), "vectors", tidy=True)
            n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            frequency = np.zeros(len(vocabulary), np.int64)
            for t, df in vectors.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # the block's terms at most
                frequency[t] = df
            weights = np.array([weight(n_docs, int(df)) for df in frequency], np.int64)
            found = _searched(vectors.where(F.size("t") > 0), block, n_docs, max(1, n_terms), weights, top)
            found = _best(found.withColumn("salt", F.spark_partition_id() % SALTS), ["q", "salt"], top).drop("rank")
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"q int, item_id {kind}")  # a block's items
            best = _best(found, ["q"], top).join(F.broadcast(ids), "q")
            best = written(best.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"), "ranked", keep=True, tidy=True)
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
