"""Small pieces that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.shared import written

#: The white space of the contracts: x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    spaced = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:  # a search for one byte each, where translate would look up every character
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0. A null id counts as held out: nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, summarise: Callable[[list], pa.Array], x_type: str) -> DataFrame:
    """id, y, x for at most max_rows rows of docs that are labelled and not held out, summarised in tasks.

    The labelled ids of least hash are taken, then the rows of docs with these ids, then, as ids may
    repeat, the rows of least hash of id and text. Labelled rows with a null label or id, or without
    a document, are not used; conflicting labels of an id are all used.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.join(F.broadcast(ids), "id").select("id", "y", "h", "text")  # max_rows ids

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "y", "h")], summarise(batch.column("text").to_pylist())], ["id", "y", "h", "x"])

    found = written(rows.mapInArrow(run, f"id long, y double, h long, x {x_type}").withColumn("u", F.monotonically_increasing_id()), "labelled")
    if found.count() > max_rows:
        h, u = found.select("h", "u").orderBy("h", "u").limit(max_rows).agg(F.max(F.struct("h", "u")).alias("m")).select("m.*").first()
        found = found.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("u") <= u)))
    return found.select("id", "y", "x")


#: Copies of one row that a task makes at once.
COPIES = 4096


def repeated(df: DataFrame, n: str, copy: str) -> DataFrame:
    """Each row of df as often as its column n says, with `copy` from 0. Rows are dealt out in pieces
    of at most COPIES before they are made, so no task makes all copies of a row."""
    pieces = df.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long"))))
    dealt = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn(copy, F.explode(F.sequence(F.col(copy), F.least(F.col(copy) + COPIES, F.col(n)) - 1)))
