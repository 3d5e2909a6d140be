"""The merge from files to tables: load, clean, stage, resolve, survive, persist, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.resolve import Resolution, resolve
from kinloom.operators.staging import stage_all, staged_issues
from kinloom.operators.structural import clean_source
from kinloom.operators.survivorship import build_golden
from kinloom.plans import report, store
from kinloom.shared import scratch, sorted_joins, written
from kinloom.sources.ragged import read_ragged
from kinloom.sources.specs import SOURCES, SourceSpec


@dataclass
class Merged:
    records: DataFrame
    tables: dict[str, DataFrame]
    review: DataFrame
    resolution: Resolution | None
    candidates: DataFrame

    def summary(self) -> DataFrame:
        return report.summary(self.records, self.tables, self.review)


def merge_staged(staged: DataFrame, structural_issues: DataFrame | None = None) -> Merged:
    """Staged records to tables. U2: issues of all steps are one table."""
    with sorted_joins(staged.sparkSession):
        return _merge_staged(staged, structural_issues)


def _merge_staged(staged: DataFrame, structural_issues: DataFrame | None) -> Merged:
    staged = written(staged, "staged")
    found = resolve(staged)
    golden = build_golden(staged, found.members, found.clusters)
    issues = staged_issues(staged).unionByName(found.issues).unionByName(golden.issues)
    if structural_issues is not None:
        issues = structural_issues.unionByName(issues)
    tables = {
        "people": golden.people, "person_identifiers": golden.identifiers, "person_sources": golden.sources, "skills": golden.skills,
        "person_skills": golden.person_skills, "data_issues": written(issues, "issues"),
    }
    return Merged(staged, tables, written(found.review, "review"), found, written(found.candidates, "candidates"))


def merge_files(spark: SparkSession, paths: dict[str, str], specs: tuple[SourceSpec, ...] = SOURCES) -> Merged:
    """paths: the file of each spec by its name."""
    cleaned, issues = {}, None
    for spec in specs:
        raw = read_ragged(spark, paths[spec.name]).withColumn("source_file", F.lit(spec.name))
        cleaned[spec.name], own = clean_source(raw, spec)
        issues = own if issues is None else issues.unionByName(own)
    return merge_staged(stage_all(cleaned, specs), issues)


def run(spark: SparkSession, paths: dict[str, str], out: str, specs: tuple[SourceSpec, ...] = SOURCES) -> Merged:
    """Merge, store a new version of the tables, write the reports below `out`; the result reads these.

    What the steps wrote to the shared folder on the way is deleted once all is stored.
    """
    with scratch(spark):
        merged = merge_files(spark, paths, specs)
        version = store.rebuild(spark, f"{out}/store", merged.tables)
        store.write_csv_report(report.sorted_issues(merged.tables["data_issues"]), f"{out}/reports/data_issues")
        store.write_review(merged.review, f"{out}/reports/review_queue")
        store.write_review(merged.candidates, f"{out}/reports/review_candidates")
    tables = store.snapshot(spark, f"{out}/store", version).tables()
    review, candidates = (spark.read.schema(df.schema).json(f"{out}/reports/{name}") for df,
        name in ((merged.review, "review_queue"), (merged.candidates, "review_candidates")))
    return Merged(tables["person_sources"], tables, review, None, candidates)
