"""A13 over rows: the nearest rank of many groups, exactly, without sorting or gathering a group.

Values are counted by group once. Then the bucket that holds the wanted rank is looked for in a histogram of
each group, and what lies in it is cut into a histogram again: by octaves first, then evenly between the
least and the greatest value left. A bucket of one value ends the search. A step moves a row for each
bucket and task; of a group that most rows belong to no task sees more than its own share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.shared import scratch, written

BUCKETS = 1024
#: A range of doubles within an octave is used up by half as many steps.
MOST_STEPS = 16


def _octave(x):
    """Ascending with x: the octave of a number, with its sign."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(2000.0))).cast("int") + 1100  # from 26 for the smallest to 3100 for infinity
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size)


def nearest_ranks(df: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """group, share, n, value: of the n values of each group, ascending, the one with floor(share * n) before it,
    the last at most. Null values and NaN are not counted, a group without others is absent; a null group is
    a group. Repeated rows count as often as they are there."""
    spark = df.sparkSession
    x = F.col(f"`{value}`").cast("double") + F.lit(0.0)  # one zero
    with scratch(spark):
        rows = df.select(F.col(f"`{group}`").alias("g"), x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
        counts = written(rows.groupBy("g", "x").agg(F.count("*").alias("c")), "values", tidy=True)
        sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
        wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        rank = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("share") * F.col("n")))).cast("long")
        wanted = written(wanted.select("g", "share", "n", rank.alias("rank"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")), "wanted", tidy=True)
        found = []
        for step in range(MOST_STEPS):
            even = F.least(F.lit(BUCKETS - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int"))
            # Targets are rows too; the join is one of two sides that can be split.
            inside = counts.join(wanted.withColumnRenamed("g", "g2").hint("merge"), F.col("g").eqNullSafe(F.col("g2")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("g2")
            bars = inside.groupBy("g", "share", "n", "rank", (_octave(F.col("x")) if step == 0 else even).alias("b")).agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            before = F.sum("c").over(Window.partitionBy("g", "share").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # 4200 buckets at most
            bars = bars.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
            bars = written(bars.select("g", "share", "n", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi"), "bars", tidy=True)
            found.append(bars.where("lo = hi").select("g", "share", "n", F.col("lo").alias("value")))
            wanted = bars.where("lo < hi")
            if wanted.isEmpty():
                break
        else:
            raise RuntimeError(f"ranks not found in {MOST_STEPS} steps")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return written(out.withColumnRenamed("g", group), "ranks", keep=True, tidy=True)
