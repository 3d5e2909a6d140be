"""Operator 10: balanced shards by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Longest-processing-time scheduling sorts
groups by size and gives each to the least loaded shard, kept in a heap. A heap over billions of
groups cannot run on one machine, so only groups larger than total / bundles are scheduled on
their own (there are fewer than ``bundles`` of those, whatever the input); the others are first
summed into ``bundles`` fixed bundles by the hash of their text, and those are scheduled beside
the large groups. The heap thus sees at most 2 * bundles items at any input size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import repeated
from kinloom.shared import written

#: Ranges in which slots are numbered, so that no task numbers a whole shard.
SLOT_RANGES = 4096


def lpt(items: list[tuple[int, tuple]], n_shards: int) -> dict[tuple, int]:
    """{key: shard} for (size, key) items, largest first, each to the least loaded shard."""
    loads = [(0, k) for k in range(n_shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, k = loads[0]
        out[key] = k
        heapq.heapreplace(loads, (load + size, k))
    return out


def shard_documents(docs: DataFrame, n_shards: int = 40, bundles: int = 10_240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law `bytes`.

    A null text counts as the empty text (size 16, crc32 0) and shares its group. Repeated rows are
    rows of their own with slots of their own; they are counted, numbered as one and made again in
    pieces, so a row that a third of all repeat fills no task. An empty table gives an empty result. Other columns
    of docs are not read. Shards differ by one bundle at most, unless one group exceeds a shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(977), text).alias("g2"),
        ),
        "sizes",
    )
    groups = written(slim.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * bundles > total
    bundle = F.pmod("g1", F.lit(bundles)).cast("int")
    alone = [(r["bytes"], (0, r["g1"], r["g2"])) for r in groups.where(large).toLocalIterator()]
    summed = groups.where(~large).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = lpt(alone + [(r["bytes"], (1, r["b"], 0)) for r in summed], n_shards)
    big = spark.createDataFrame([(k[1], k[2], v) for k, v in placed.items() if k[0] == 0], "g1 long, g2 long, own int")
    rest = spark.createDataFrame([(k[1], v) for k, v in placed.items() if k[0] == 1], "b int, bundled int")
    put = (
        slim.withColumn("b", bundle)
        .join(F.broadcast(big), ["g1", "g2"], "left")  # fewer than `bundles` rows
        .join(F.broadcast(rest), "b", "left")  # `bundles` rows at most
        .select("doc_id", "size", "text_crc32", "g1", "g2", F.coalesce("own", "bundled").alias("shard"))
        .groupBy("shard", "doc_id", "size", "text_crc32", "g1", "g2").agg(F.count("*").alias("n"))
        .withColumn("range", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(SLOT_RANGES)).cast("int"))
    )
    before = (
        put.groupBy("shard", "range").agg(F.sum("n").alias("n"))
        .select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    )
    in_range = Window.partitionBy("shard", "range").orderBy(F.col("doc_id").asc_nulls_first(), "g1", "g2").rowsBetween(Window.unboundedPreceding, 0)
    kinds = put.withColumn("first", F.sum("n").over(in_range) - F.col("n")).join(before, ["shard", "range"])
    return repeated(kinds, "n", "copy").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("first") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
