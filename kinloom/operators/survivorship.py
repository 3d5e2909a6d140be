"""One golden record for each person, with identifiers, skills, lineage and conflicts.

Everything is an aggregation by person; an order key (priority, record_id) stands for "first".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.values import number_text
from kinloom.operators.ranking import numbered
from kinloom.shared import written

#: V3: the kind of source that owns a field.
OWNERS = {
    "experience_years": "applicants", "ctc_inr": "applicants", "applied_date": "applicants", "rate_per_hour": "gig_workers",
    "rate_raw": "gig_workers", "is_verified": "contacts", "projects_completed": "contacts",
}
#: V5 to V9: fields whose conflicts are logged: name in the log, type, severity, detail.
DISAGREE = "sources disagree; all values stay in the lineage"
LOGGED = {
    "name": ("name", "name_variants_merged", "low", "one person's name written in more than one way"),
    "email": ("email", "multiple_emails_one_person", "medium", "one person with several emails, all kept as identifiers"),
    "phone": ("phone", "multiple_phones_one_person", "medium", "one person with several phones, all kept as identifiers"),
    "experience_years": ("experience_years", "field_conflict", "medium", DISAGREE),
    "ctc_inr": ("current_ctc_inr", "field_conflict", "medium", DISAGREE),
    "city": ("city", "field_conflict", "medium", DISAGREE),
}
#: Variants of a person, and records of a variant, that an issue names; of the others it tells the number.
SHOWN = 20


@dataclass
class Golden:
    people: DataFrame
    identifiers: DataFrame
    sources: DataFrame
    skills: DataFrame
    person_skills: DataFrame
    issues: DataFrame


def pick(field: str, owner: str | None = None) -> Column:
    """V2: the first value that is not null or '', the owner's first, then by priority."""
    c = F.col(field)
    filled = c.isNotNull() & (c.cast("string") != "")
    preferred = F.lit(0) if owner is None else F.when(F.col("kind") == owner, 0).otherwise(1)
    return F.min_by(F.when(filled, c), F.when(filled, F.struct(preferred.alias("o"), F.col("priority"), F.col("record_id"))))


def best_name() -> Column:
    """V5: most whole tokens, then longest, then by priority."""
    whole = F.size(F.filter(F.split("name", " "), lambda t: F.length(F.regexp_replace(t, r"^([^.]*)\.", "$1")) > 1))
    return F.min_by("name", F.when(F.col("name").isNotNull(), F.struct((-whole).alias("w"), (-F.length("name")).alias("l"), F.col("priority"), F.col("record_id"))))


def best_cities(rows: DataFrame) -> DataFrame:
    """V6: (person_id, best_city, n_cities): most votes, then best priority, then first seen."""
    votes = rows.where("city IS NOT NULL AND city <> ''").groupBy("person_id", "city").agg(F.count("*").alias("n"), F.min("priority").alias("p"),
        F.min(F.struct("priority", "record_id")).alias("f"))
    return votes.groupBy("person_id").agg(F.min_by("city", F.struct((-F.col("n")).alias("n"), "p", "f")).alias("best_city"), F.count("*").alias("n_cities"))


def email_order(e: Column) -> Column:
    """V7: alias addresses last, then the shortest, then by text."""
    return F.struct(F.when(e.startswith("alt."), 1).otherwise(0).alias("alt"), F.length(e).alias("n"), e.alias("e"))


def identifiers_of(rows: DataFrame) -> DataFrame:
    """person_id, id_type, value, source_file, is_primary."""
    typed = rows.select("person_id", "priority", "record_id", "source_file",
        F.explode(F.array(F.struct(F.lit("email").alias("id_type"), F.col("email").alias("value")),
        F.struct(F.lit("phone").alias("id_type"), F.col("phone").alias("value")))).alias("i"))
    typed = typed.select("person_id", "priority", "record_id", "source_file", "i.*").where("value IS NOT NULL AND value <> ''")
    order = F.struct("priority", "record_id")
    once = typed.groupBy("person_id", "id_type", "value").agg(F.min(order).alias("first"), F.min_by("source_file", order).alias("source_file"))
    rank = F.when(F.col("id_type") == "email", F.struct(email_order(F.col("value")).alias("e"),
        F.lit(None).cast("struct<priority:int,record_id:bigint>").alias("p"))).otherwise(
        F.struct(F.lit(None).cast("struct<alt:int,n:int,e:string>").alias("e"), F.col("first").alias("p")))
    best = once.groupBy("person_id", "id_type").agg(F.min_by("value", rank).alias("best"))
    return once.join(best, ["person_id", "id_type"]).select("person_id", "id_type", "value", "source_file",
        (F.col("value") == F.col("best")).cast("int").alias("is_primary"), "first")


def skills_of(rows: DataFrame) -> DataFrame:
    """person_id, match_key, canonical_name, place: the union of skills, first spelling wins."""
    each = rows.select("person_id", "priority", "record_id", F.posexplode("skills").alias("i", "s")).select("person_id",
        F.struct("priority", "record_id", "i").alias("place"), "s.*")
    return each.groupBy("person_id", "match_key").agg(F.min_by("canonical_name", "place").alias("canonical_name"), F.min("place").alias("place"))


def build_golden(records: DataFrame, members: DataFrame, clusters: DataFrame) -> Golden:
    """records: staged; members: record_id, person_id; clusters: person_id, match_confidence, match_reason."""
    rows = written(records.drop("issues").join(members.select("record_id", "person_id"), "record_id"), "golden-rows")
    own = {f: pick(f, o) for f, o in OWNERS.items()}
    status = F.coalesce(F.min_by(F.when(F.col("kind") == "gig_workers", F.col("status")),
        F.when((F.col("kind") == "gig_workers") & (F.col("status") != ""), F.struct("priority", "record_id"))), F.lit("unknown"))
    core = rows.groupBy("person_id").agg(best_name().alias("full_name"), status.alias("gig_status"), *[c.alias(f) for f, c in own.items()])
    ids = written(identifiers_of(rows), "identifiers")
    primary = ids.where("is_primary = 1").groupBy("person_id").agg(F.max(F.when(F.col("id_type") == "email", F.col("value"))).alias("primary_email"),
        F.max(F.when(F.col("id_type") == "phone", F.col("value"))).alias("primary_phone"))
    people = core.join(primary, "person_id", "left").join(best_cities(rows), "person_id",
        "left").join(clusters.select("person_id", "match_confidence", "match_reason"), "person_id")
    people = written(people.select(
        "person_id", "full_name", "primary_email", "primary_phone", F.col("best_city").alias("city"), "experience_years", F.col("ctc_inr").alias("current_ctc_inr"),
        F.col("rate_per_hour").alias("rate_inr_per_hour"), "rate_raw", "gig_status", "is_verified",
            F.col("projects_completed").cast("int").alias("projects_completed"), "applied_date",
        F.lit(None).cast("string").alias("skill_category"), "match_confidence", "match_reason",
    ), "people")
    sources = rows.select("person_id", "source_file", "source_row", F.to_json("data", {"ignoreNullFields": "false"}).alias("raw_json"))
    per_person = written(skills_of(rows), "person-skills")
    # Surrogate ids by first appearance; places of different skills differ, so they can be sorted.
    by_key = per_person.groupBy("match_key").agg(F.min(F.struct("person_id", "place")).alias("at"),
        F.min_by("canonical_name", F.struct("person_id", "place")).alias("canonical_name"))
    known = numbered(by_key, "at", "skill_id").select("skill_id", "canonical_name", "match_key")
    known = written(known, "skills")
    linked = written(per_person.join(known.select("skill_id", "match_key"), "match_key").select("person_id", "skill_id"), "skill-links")
    return Golden(people, ids.drop("first"), sources, known, linked, conflicts(rows, people))


def variants(rows: DataFrame) -> DataFrame:
    """person_id, field, n and vs for each field in which a person has several values: the first SHOWN
    values with the first SHOWN records of each, and how many there are.

    Ranks up to SHOWN are pruned before rows are moved, and counts are combined there, so a person
    with a third of all rows gives as many rows to a task as any other.
    """
    shown = lambda f: number_text(F.col(f).cast("double")) if f in ("experience_years", "ctc_inr") else F.col(f)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), shown(f).alias("text")) for f in LOGGED])
    label = F.concat_ws(":", "source_file", F.col("source_row").cast("string"))
    long = rows.select("person_id", F.struct("priority", "record_id").alias("o"), label.alias("l"), F.explode(each).alias("i"))
    long = long.select("person_id", "o", "l", "i.*").where("v IS NOT NULL AND v <> ''")
    value = ["person_id", "field", "v"]
    counted = long.groupBy(*value).agg(F.count("*").alias("records"), F.min("o").alias("f"), F.min("text").alias("text"))
    several = counted.groupBy("person_id", "field").agg(F.count("*").alias("n")).where("n > 1")
    rank = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    first = counted.withColumn("rn", rank(["person_id", "field"], "f")).where(F.col("rn") <= SHOWN).drop("rn").join(several, ["person_id", "field"])
    labels = long.withColumn("rn", rank(value, "o")).where(F.col("rn") <= SHOWN)
    labels = labels.groupBy(*value).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]).alias("where"))
    vs = F.array_sort(F.collect_list(F.struct("f", "text", "where", "records")))
    return first.join(labels, value).groupBy("person_id", "field").agg(F.first("n").alias("n"), vs.alias("vs"))


def conflicts(rows: DataFrame, people: DataFrame) -> DataFrame:
    """V5 to V9: what was merged although it differed; located at the person's first record, for a
    name at the first record that has the name that won."""
    order = F.struct("priority", "record_id")
    place = F.struct("source_file", "source_row")
    found = written(variants(rows), "variants")
    whose = rows.join(found.select("person_id").distinct(), "person_id", "left_semi").join(people.select("person_id", "full_name"), "person_id")
    at = whose.groupBy("person_id").agg(F.min_by(place, order).alias("at"),
        F.min_by(F.when(F.col("name") == F.col("full_name"), place), F.when(F.col("name") == F.col("full_name"), order)).alias("named_at"))
    found = found.join(people, "person_id").join(at, "person_id")
    more = lambda n, shown: F.when(n > shown, F.format_string(" and %d more", n - shown)).otherwise("")
    listed = F.concat(F.array_join(F.transform("vs", lambda x: x["text"]), " / "), more(F.col("n"), F.size("vs")))
    told = F.transform("vs", lambda x: F.concat(x["text"], F.lit(" ("), F.array_join(x["where"], ", "), more(x["records"], F.size(x["where"])), F.lit(")")))
    full = F.concat(F.array_join(told, " vs "), more(F.col("n"), F.size("vs")))
    won = {"name": F.col("full_name"), "email": F.col("primary_email"), "phone": F.col("primary_phone"), "city": F.col("city"),
        "experience_years": number_text(F.col("experience_years").cast("double")), "ctc_inr": number_text(F.col("current_ctc_inr").cast("double"))}
    by_field = lambda values: F.coalesce(*[F.when(F.col("field") == f, c) for f, c in values.items()])
    said = lambda i: by_field({f: F.lit(x[i]) for f, x in LOGGED.items()})
    found = found.withColumns({"where": F.when(F.col("field") == "name", F.col("named_at")).otherwise(F.col("at")), "issue_type": said(1)})
    return found.select(
        "where.source_file", "where.source_row", said(0).alias("column_name"), "issue_type", said(2).alias("severity"),
        F.when(F.col("issue_type") == "field_conflict", full).otherwise(listed).alias("raw_value"),
        F.concat(F.lit("kept "), by_field(won)).alias("action_taken"), said(3).alias("detail"),
    )
