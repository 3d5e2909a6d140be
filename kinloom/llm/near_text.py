"""Near-duplicates by SimHash ball hashing, with keys of MinHash beside it and a check of every pair.

A text is the set of its shingles of `n` words; two texts are near if their Jaccard similarity is at
least `percent` of a hundred. Texts with the same words are one node. Candidates come from two sides. Operator 4
fingerprints the shingles and links what differs in three bits or fewer (simhash.links); of the texts of one
fingerprint the smallest node stands for it. Near texts of similarity 0.8 often differ in more bits, which no ball
reaches; so each node also has BANDS keys, every key a hash of ROWS minima; a pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, which is
1 - 3e-6 for s = 0.8. Nodes that share a key are held against the smallest of them, so a key
gives no more pairs than it has nodes. All pairs of both sides are verified on whole texts, exactly.

Recall is below one by what both miss, and where two near texts are both not near the smallest
node of every key and fingerprint that they share; the README has measured figures.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import simhash
from kinloom.operators.components import connected_components
from kinloom.shared import written

BANDS, ROWS = 32, 5
#: Shingles that are permuted at once.
BLOCK = 1 << 12


def hashed(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """(hash of all words, hashes of all shingles, repeats included); a text of 1 to n - 1 words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        found = [digest(line, 42)] if words else []
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1].tolist()
        found = [digest(line[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]
    return digest(line, 7), np.array(found, "<u8")


def shingles(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """(hash of all words, distinct hashes of the shingles)."""
    whole, found = hashed(text, n)
    return whole, np.unique(found)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, signed; none for an empty set."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    a, b = _permutations()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), BLOCK):
        x = a * hashes[k : k + BLOCK] + b
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(1), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64)


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """id, t (text hash), node, size, bands, fp (signed SimHash) of every row."""
    names = ["id", "t", "node", "size", "bands", "fp"]
    step = simhash.BLOCK

    def run(batches):
        for batch in batches:
            node, size, keys, fps = [], [], [], []
            for text in batch.column("text").to_pylist():
                whole, found = hashed(text, n)
                hashes = np.unique(found)
                node.append(whole)
                size.append(len(hashes))
                keys.append(bands(hashes))
                fps.append(simhash.sign(found[k : k + step] for k in range(0, len(found), step)))
            node, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fps))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), node, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), fps], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "id long, t long, node long, size long, bands array<long>, fp long")


def _ball(nodes: DataFrame) -> DataFrame:
    """src, dst (nodes): the smallest node of a fingerprint with its others, and with those of fingerprints in its ball."""
    centre = written(nodes.groupBy("fp").agg(F.min("node").alias("src")), "fingerprints")
    linked = written(simhash.links(centre.select("fp")), "ball", tidy=True)  # its shuffle is the stage's largest
    node = lambda fp, name: centre.select(F.col("fp").alias(fp), F.col("src").alias(name)).hint("merge")
    across = linked.withColumnsRenamed({"src": "a", "dst": "b"}).join(node("a", "src"), "a").join(node("b", "dst"), "b").select("src", "dst")
    same = nodes.select("node", "fp").join(centre.hint("merge"), "fp").where("node <> src").select("src", F.col("node").alias("dst"))
    return same.unionByName(across).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """src, dst (nodes, distinct pairs) that the ball links or that share a key, and whose sizes allow the similarity."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min("node").alias("src"), F.count("*").alias("n")).where("n > 1").select("key", "src")
    met = keys.join(centre.hint("merge"), "key").where("node <> src").select("src", F.col("node").alias("dst"))
    met = met.unionByName(_ball(nodes)).distinct()
    sizes = nodes.select("node", "size")
    sized = met.join(sizes.select(F.col("node").alias("src"), F.col("size").alias("m")).hint("merge"), "src")
    sized = sized.join(sizes.select(F.col("node").alias("dst"), F.col("size").alias("k")).hint("merge"), "dst")
    return sized.where(F.least("m", "k") * 100 >= F.greatest("m", "k") * percent).select("src", "dst")


def _verified(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """src, dst of the pairs (src, dst, a, b: texts) whose similarity is percent or more."""

    def run(batches):
        last, left = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            near = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                if last is None or x != last:
                    last, left = x, shingles(x, n)[1]
                right = shingles(y, n)[1]
                both = len(np.intersect1d(left, right, assume_unique=True))
                near[i] = 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(near))

    return pairs.mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, parts) as simhash.deduplicated takes them: parts has node, component and first, first
    being the component's first row as (last, id, t): null ids come last, then by id, then by hash.

    Texts without a word are one node, null texts included.
    """
    rows = written(_rows(docs, n), "shingled")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t", "size", "bands", "fp")  # these three follow from the text
    nodes = written(rows.groupBy("node").agg(F.min(order).alias("k")).select("node", F.struct("k.last", "k.id", "k.t").alias("k"), "k.size", "k.bands", "k.fp"), "nodes")
    pairs = written(_candidates(nodes, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    wanted = wanted.join(nodes, "node").select("node", F.col("k.id").alias("id"), F.col("k.t").alias("t"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"), F.col("text").alias("text"))
    texts = written(keyed.join(wanted.hint("merge"), F.col("_d").eqNullSafe(F.col("id")) & (F.col("_t") == F.col("t"))).select("node", "text").dropDuplicates(["node"]), "texts")
    text = lambda key, name: texts.select(F.col("node").alias(key), F.col("text").alias(name))
    both = pairs.join(text("dst", "b"), "dst").join(text("src", "a"), "src").select("src", "dst", "a", "b")
    linked = connected_components(_verified(both, n, percent))
    named = nodes.select("node", "k").join(linked, "node", "left").select("node", "k", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("k").alias("first"))
    return rows, named.join(first, "component").select("node", "component", "first")
