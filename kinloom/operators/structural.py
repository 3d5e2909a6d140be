"""Structural cleaning of cell arrays, before any field is read.

Input: (source_file, source_row, cells). The first rule that drops a row ends its way; each finding
becomes an issue. Only C6 needs rows to meet, on a key of the repaired cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.normalise import EMAIL
from kinloom.functions.values import issue, ws_trim
from kinloom.shared import written
from kinloom.sources.specs import SourceSpec


def judge(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Raw without its header row, with working (cells, null if dropped) and found (issues)."""
    trimmed = F.transform("cells", lambda c: F.coalesce(ws_trim(c), F.lit("")))
    rows = raw.where("source_row > 1").withColumn("trimmed", trimmed).withColumn("joined", F.array_join("trimmed", "|"))
    if spec.email_index is not None:  # where the first address stands, from 0; -1: nowhere
        rows = rows.withColumn("at", (F.array_position(F.transform("trimmed", lambda c: c.rlike(EMAIL)), True) - 1).cast("int"))
    width = len(spec.header)
    blank = F.forall("trimmed", lambda c: c == "")
    header = ~blank & (F.lower("joined") == "|".join(h.strip().lower() for h in spec.header))
    live = ~blank & ~header
    found = [
        issue(blank, "blank_row", "medium", F.lit(None), "row dropped", "every cell is empty"),
        issue(header, "repeated_header", "high", F.col("joined"), "row dropped", "the header stands within the data"),
        issue(live & (F.size("cells") != width), "column_count_mismatch", "high", F.col("joined"), "looked at for shifted columns",
            F.format_string(f"{width} cells expected, %d found", F.size("cells"))),
    ]
    working = F.when(live, F.col("cells"))
    if spec.email_index is not None:
        here = F.coalesce(F.get("trimmed", F.lit(spec.email_index)).rlike(EMAIL), F.lit(False))
        off = F.col("at") - spec.email_index
        # C4: rotated left until the first address stands in its column; null if none stands right of it.
        rotated = F.concat(F.slice("cells", off + 1, F.size("cells") - off), F.slice("cells", F.lit(1), off))
        rows = rows.withColumn("misplaced", live & ~here).withColumn("turned", F.when(F.col("misplaced") & (F.size("cells") > 1) & (off > 0), rotated))
        misplaced, turned = F.col("misplaced"), F.col("turned")
        shown = F.array_join(F.transform(turned, lambda c: F.coalesce(ws_trim(c), F.lit(""))), "|")
        found += [
            issue(misplaced & turned.isNotNull(), "column_shift", "high", F.col("joined"), F.concat(F.lit("cells rotated back: "), shown),
                "the address stands right of its column"),
            issue(misplaced & turned.isNull(), "column_shift_unrepairable", "high", F.col("joined"), "row dropped", "no address right of its column tells the order"),
        ]
        working = F.when(misplaced, turned).otherwise(working)
    return rows.select("source_file", "source_row", "joined", working.alias("working"), F.concat(*found).alias("found"))


def clean_source(raw: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): rows have source_file, source_row and data, a map of the header's columns."""
    judged = judge(raw, spec)
    judged = judged.withColumn("key", F.array_join(F.transform("working", lambda c: F.lower(F.coalesce(ws_trim(c), F.lit("")))), "|"))
    judged = written(judged, "judged")  # read for the first of equal rows, for the rows and for the issues
    live = judged.where("working IS NOT NULL")
    # C6 by aggregation and an equi-join, which a frequent row does not crowd into one task.
    first = live.groupBy("source_file", "key").agg(F.min("source_row").alias("first_row"))
    marked = live.join(first, ["source_file", "key"])
    repeated = F.col("source_row") > F.col("first_row")
    width = len(spec.header)
    extra = F.size("working") > width
    marked = marked.withColumn("more", F.concat(
        issue(repeated, "duplicate_row_in_source", "high", F.col("joined"), F.format_string("row dropped, it repeats row %d", "first_row"),
            "equal but for case and outer white space"),
        issue(~repeated & extra, "extra_fields", "medium", F.array_join(F.slice("working", width + 1, 1_000_000), "|", ""), "surplus cells dropped",
            F.format_string(f"%d cells, the header has {width}", F.size("working"))),
    ))
    data = F.map_from_arrays(F.array(*map(F.lit, spec.header)), F.array(*[F.get("working", F.lit(i)) for i in range(width)]))
    rows = marked.where(~repeated).select("source_file", "source_row", data.alias("data"))
    flat = lambda df, c: df.select("source_file", "source_row", F.lit(None).cast("string").alias("column_name"),
        F.explode(c).alias("i")).select("source_file", "source_row", "column_name", "i.*")
    return rows, flat(judged, "found").unionByName(flat(marked, "more"))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """C6 on any table: of rows with equal keys the first by `order` stays. As only the first rank is
    kept, every task passes on one row of a key, so a frequent key is no burden."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
