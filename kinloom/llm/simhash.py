"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 3 meet at a value that is at most 2 bits from one and at most 1
from the other. Every fingerprint emits the values around it, the shuffle brings equal values
together, and what meets is linked.

Not all 2,081 values within 2 bits are needed. With A the values within 1 bit and B those at 2:
- at distance 1 or 3 the parities differ: the odd fingerprint emits A, the even one itself and B.
  Of three differing bits two lie in the same half of the word, so B needs only pairs of bits of
  one half (992 of 2,016).
- at distance 2 both have the same parity and meet in A.
So odd fingerprints emit 64 values and even ones 65 + 992.

All fingerprints that meet in A of one value are within 2 bits of each other and within 3 of those
that meet it from B, so the smallest of A linked to each of the others gives the same components
as all pairs would: a value adds no more links than it has fingerprints, and a value has 1,121
fingerprints at most, however many documents share them. Links are deduplicated and verified.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components
from kinloom.shared import written

#: Shingles whose bits are summed at once.
BLOCK = 1 << 16


def sign(blocks: Iterable[np.ndarray]) -> int:
    """The SimHash of shingle hashes that come in blocks, unsigned: a bit is 1 if more than half of them have it."""
    total, count = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(h)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    """The SimHash of one whole text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and x20, x09-x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < n:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1].tolist()
    ends = (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return sign(np.array([digest(line[a:b], 42) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], "<u8") for k in range(0, len(starts), BLOCK))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t (text hash), fp (signed 64-bit) of every row."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(fp)], ["doc_id", "t", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SINGLES = [_signed(1 << i) for i in range(64)]
PAIRS = [_signed(1 << i | 1 << j) for i in range(64) for j in range(i) if i // 32 == j // 32]


def links(fps: DataFrame) -> DataFrame:
    """src, dst: links that connect fingerprints of fps (fp, distinct) at 3 or fewer differing bits."""
    # A fingerprint grows into hundreds of rows, so the few fingerprints are dealt out first.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    odd = F.bit_count("fp") % 2 == 1
    around = lambda masks: F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))
    near = fps.select("fp", F.explode(F.when(odd, around(SINGLES)).otherwise(F.concat(F.array("fp"), around(SINGLES)))).alias("v"))
    far = fps.where(~odd).select("fp", F.explode(around(PAIRS)).alias("v"))
    centre = near.groupBy("v").agg(F.min("fp").alias("src"))
    # By sort-merge, which spills: a table of hashed centres would have to fit a task.
    met = near.unionByName(far).join(centre.hint("merge"), "v").where("fp <> src")
    return met.select("src", F.col("fp").alias("dst")).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 3).distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, t (text hash), fp; parts: fp, component, first), first being the component's
    first row as (last, id, t): null ids come last, then by id, then by text hash.

    Rows are combined by fingerprint before components are looked at, so a group of copies counts
    once there.
    """
    rows = written(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    nodes = written(rows.groupBy("fp").agg(F.min(order).alias("k")), "nodes")
    linked = connected_components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "component")
    named = nodes.join(linked, "fp", "left").select("fp", "k", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("k").alias("first"))
    return rows, named.join(first, "component").select("fp", "component", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Texts without a word have fingerprint zero, as null texts, and are linked like others. Repeated
    rows come back as often as they are in docs. A null doc_id comes back with its component's
    smallest id, which is null only if the component has no other. An empty table gives an empty
    result; other columns are not read.
    """
    rows, parts = _components(docs)
    return rows.join(parts, "fp").select("doc_id", "fp", F.col("first.id").alias("component_id"))


def deduplicated(docs: DataFrame, components=_components) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that of its smallest doc_id.

    `components` gives (rows, parts) of docs, parts with component and first. Null ids come last; of rows that share the smallest id the one with the smallest text hash
    stays, and of rows equal in id and text one.
    """
    _, parts = components(docs)
    keep = parts.groupBy("component").agg(F.min("first").alias("k")).select(F.col("k.id").alias("_id"), F.col("k.t").alias("_h"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h"))
    kept = packed.join(keep.hint("merge"), same).select("doc", "_d", "_t")
    again = kept.groupBy("_d", "_t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_d").alias("_id"), F.col("_t").alias("_h"))
    again = written(again, "again")
    single = kept.join(again.hint("merge"), same, "left_anti").select("doc")
    if again.isEmpty():  # ids are unique, as they should be
        return kept.select("doc.*")
    one = kept.join(again.hint("merge"), same, "left_semi").groupBy("_d", "_t").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return single.unionByName(one).select("doc.*")
