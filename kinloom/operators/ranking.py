"""Dense numbers for sorted rows without sorting them all in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.shared import written


def numbered(df: DataFrame, order: str, name: str, first: int = 1) -> DataFrame:
    """df with `name`: first, first + 1, ... in the order of a column without repeats.

    Rows are dealt to ranges; each range counts its rows, and what reaches the driver is a count for
    each range.
    """
    df = written(df, "unnumbered")  # read twice, for a sample of the order and to be dealt
    dealt = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = sorted(map(tuple, dealt.groupBy("_range").count().collect()))
    before, rows = first - 1, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) + F.col("_before")
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")
