"""Cleaned rows of any source to one shape, with their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import normalise as N
from kinloom.functions.values import ISSUE
from kinloom.sources.specs import SOURCES, SourceSpec

SKILLS_TYPE = "array<struct<canonical_name:string,match_key:string>>"
#: Records of one source number less than this.
SOURCE_STRIDE = 1 << 40
#: field of the common shape: (type, field of a normaliser's result)
STAGED = {
    "name": "string", "name_key": "string", "has_initial": "boolean", "email": "string", "phone": "string", "city": "string",
    "city_canonical": "boolean", "experience_years": "double", "ctc_inr": "bigint", "applied_date": "date", "rate_per_hour": "double",
    "rate_raw": "string", "status": "string", "is_verified": "int", "projects_completed": "bigint", "skills": SKILLS_TYPE,
}


def _applicants(d) -> dict[str, tuple[str, Column]]:
    return {
        "name": ("Full Name", N.name(d("Full Name"))), "email": ("Email", N.email(d("Email"))), "phone": ("Phone", N.phone(d("Phone"))),
        "city": ("City", N.city(d("City"))), "experience_years": ("Experience (Years)", N.real(d("Experience (Years)"), "Experience (Years)")),
        "ctc_inr": ("Current CTC", N.ctc(d("Current CTC"))), "applied_date": ("Applied Date", N.applied_date(d("Applied Date"))),
            "skills": ("Skills", N.skills(d("Skills"))),
    }


def _gig_workers(d) -> dict[str, tuple[str, Column]]:
    return {
        "name": ("worker_name", N.name(d("worker_name"))), "email": ("email_id", N.email(d("email_id"))), "city": ("location", N.city(d("location"))),
        "rate_per_hour": ("rate", N.rate(d("rate"))), "status": ("status", N.status(d("status"))), "skills": ("skill_tags", N.skills(d("skill_tags"))),
    }


def _contacts(d) -> dict[str, tuple[str, Column]]:
    return {
        "name": ("Name", N.name(d("Name"))), "phone": ("Phone Number", N.phone(d("Phone Number"))), "city": ("City", N.city(d("City"))),
        "is_verified": ("Verified", N.verified(d("Verified"))), "projects_completed": ("Projects Completed", N.integer(d("Projects Completed"), "Projects Completed")),
    }


STAGERS = {"applicants": _applicants, "gig_workers": _gig_workers, "contacts": _contacts}


def stage_source(rows: DataFrame, spec: SourceSpec, ordinal: int) -> DataFrame:
    """Rows (source_file, source_row, data) of one source in the common shape, plus `issues`.

    record_id orders records as they are loaded: by source, then by row. It is a function of the
    row, so that it does not depend on how rows are partitioned.
    """
    if spec.kind not in STAGERS:
        raise ValueError(f"no stager for {spec.kind}")
    fields = STAGERS[spec.kind](lambda c: F.try_element_at("data", F.lit(c)))
    staged = rows.select("source_file", "source_row", "data", *[r.alias(f"_{f}") for f, (_, r) in fields.items()])
    value = lambda f: F.col(f"_{f}.value") if f in fields else F.lit(None)
    made = {f: value(f) for f in STAGED}
    made |= {"name_key": F.col("_name.key"), "has_initial": F.coalesce(F.col("_name.has_initial"), F.lit(False)),
        "city_canonical": F.coalesce(F.col("_city.canonical"), F.lit(False))}
    if "rate_per_hour" in fields:
        made["rate_raw"] = F.coalesce("_rate_per_hour.raw", F.try_element_at("data", F.lit("rate")))
    made["skills"] = F.coalesce(value("skills").cast(SKILLS_TYPE), F.array().cast(SKILLS_TYPE))

    def at(column: str):
        return lambda i: F.struct(F.lit(column).alias("column_name"), *[i[x].alias(x) for x in ("issue_type", "severity", "raw_value", "action_taken", "detail")])

    own = [F.transform(f"_{f}.issues", at(c)) for f, (c, _) in fields.items()]
    nobody = made["email"].isNull() & made["phone"].isNull()
    none = F.when(nobody, F.array(F.struct(
        F.lit(None).cast("string").alias("column_name"), F.lit("no_identifier").alias("issue_type"), F.lit("high").alias("severity"), value("name").alias("raw_value"),
        F.lit("kept as a person of its own").alias("action_taken"), F.lit("neither address nor number").alias("detail"),
    ))).otherwise(F.array())
    issues = F.concat(*own, none).cast("array<" + ISSUE.replace("struct<", "struct<column_name:string,") + ">")
    return staged.select(
        (F.lit(ordinal * SOURCE_STRIDE) + F.col("source_row")).cast("bigint").alias("record_id"), "source_file", F.col("source_row").cast("int").alias("source_row"),
        F.lit(spec.priority).alias("priority"), F.lit(spec.kind).alias("kind"), "data", *[made[f].cast(t).alias(f) for f, t in STAGED.items()], issues.alias("issues"),
    )


def stage_all(cleaned: dict[str, DataFrame], specs: tuple[SourceSpec, ...] = SOURCES) -> DataFrame:
    """The sources that are given, in the order of the specs."""
    parts = [stage_source(cleaned[s.name], s, i) for i, s in enumerate(specs) if s.name in cleaned]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def staged_issues(staged: DataFrame) -> DataFrame:
    """An issue a row, with its source file, row and column."""
    return staged.select("source_file", "source_row", F.explode("issues").alias("i")).select("source_file", "source_row", "i.*")
