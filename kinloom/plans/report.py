"""What the issue log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.display import short_file

SEVERITIES = ("high", "medium", "low")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def sorted_issues(issues: DataFrame) -> DataFrame:
    """By what the severity means, then type, file and row; nulls first."""
    return issues.orderBy(severity_rank(F.col("severity")), "issue_type", "source_file", "source_row")


def by_confidence(people: DataFrame) -> DataFrame:
    """A2."""
    return people.groupBy("match_confidence").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match_confidence")


def by_type(issues: DataFrame) -> DataFrame:
    """A3, A4, R2."""
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("n")).orderBy(severity_rank(F.col("severity")), F.desc("n"), "issue_type")


def by_severity(issues: DataFrame) -> DataFrame:
    """One row, a column for each severity."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def examples(issues: DataFrame, n: int = 3) -> DataFrame:
    """The first n issues of each type by file and row, shortened for a table."""
    order = Window.partitionBy("issue_type").orderBy("source_file", "source_row", "column_name", "raw_value")
    short = lambda c, size: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), 1, size)
    where = F.concat(short_file(F.col("source_file")), F.coalesce(F.concat(F.lit(":"), F.col("source_row").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" · "), "column_name"), F.lit("")))
    top = issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.select("issue_type", "rank", where.alias("place"), short(F.col("raw_value"), 70).alias("value"), short(F.col("action_taken"), 90).alias("action"))


def undecided(issues: DataFrame) -> DataFrame:
    """R6."""
    return issues.where(F.col("issue_type").isin("ambiguous_name_match", "no_identifier")).select("issue_type", "raw_value", "detail")


def summary(records: DataFrame, tables: dict[str, DataFrame], review: DataFrame) -> DataFrame:
    """One row of totals."""
    one = records.agg(F.count("*").alias("source_rows"))
    for name, df in (("people", tables["people"]), ("identifiers", tables["person_identifiers"]), ("skills", tables["skills"]),
        ("issues", tables["data_issues"]), ("review", review)):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))
    return one.withColumn("merged", F.col("source_rows") - F.col("people"))


def markdown(issues: DataFrame, people: DataFrame, sources: DataFrame) -> str:
    """K4: the report as text, from aggregates whose size depends on the number of types alone."""
    types = by_type(issues).collect()
    total, levels = sum(t["n"] for t in types), by_severity(issues).first()
    out = ["# Data issues", "", f"{total} issues of {len(types)} types in {sources.count()} source rows of {people.count()} people.", "",
        "| Severity | Count |", "|---|---:|"]
    out += [f"| {s} | {levels[s]} |" for s in SEVERITIES]
    shown: dict = {}
    for e in examples(issues).orderBy("issue_type", "rank").collect():
        shown.setdefault(e["issue_type"], []).append(f"| `{e['place']}` | `{e['value']}` | {e['action']} |")
    last = None
    for i, t in enumerate(types, 1):
        if t["severity"] != last:
            last = t["severity"]
            out += ["", f"## {last.capitalize()} severity"]
        out += ["", f"### {i}. {t['issue_type']}", "", f"{t['n']} in all.", "", "| Where | Value | Action |", "|---|---|---|", *shown.get(t["issue_type"], [])]
    open_ = undecided(issues).groupBy("issue_type").agg(F.count("*").alias("n")).collect()
    out += ["", "## Not decided", "", *([f"- {r['issue_type']}: {r['n']}" for r in open_] or ["- nothing; people of one name in different cities stay apart"])]
    return "\n".join(out) + "\n"
