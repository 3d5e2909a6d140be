"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Edges stay linear in the
input, each round is two joins, and rounds grow with the logarithm of the longest path. Minima
are taken with map-side combining; the joins are plain equi-joins, so adaptive execution splits
a hub that many edges share. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v")))


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or is such a smaller one, and none is both."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"),
        F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    per = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return per.where((F.col("child") + F.col("root")) > 1).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Nodes that have no edge, or only one to themselves, are absent: they are their own component.
    Edges with a null end are ignored; repeated edges change nothing. Raises if max_rounds do not
    suffice, rather than return labels that are not final.
    """
    star = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    star = written(star.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_star(star):
            roots = star.select(F.col("v").alias("node")).distinct()
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        star = written(_small_star(_large_star(star).distinct()).distinct(), "star")
    raise RuntimeError(f"components not final after {max_rounds} rounds")
