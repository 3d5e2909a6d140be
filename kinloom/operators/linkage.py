"""Submissions, tags and listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import display as D
from kinloom.functions import normalise as N
from kinloom.functions.values import is_blank, ws_collapse, ws_trim
from kinloom.operators.ranking import numbered
from kinloom.shared import written

CATEGORIES = ("automation-heavy", "web-dev", "data", "qa-automation", "backend")
#: Fixed values.
AUDIO_TYPES = (
    "audio/webm", "audio/ogg", "audio/wav", "audio/x-wav", "audio/wave", "audio/mpeg", "audio/mp3", "audio/mp4", "audio/x-m4a", "audio/aac", "audio/flac", "video/webm",
)
MAX_UPLOAD = 25 * 1024 * 1024


def reject_reason(mime: Column, size: Column, name: Column, phone: Column) -> Column:
    """The first check that an upload fails, or null."""
    return (
        F.when(mime.isNotNull() & ~mime.isin(*AUDIO_TYPES), "unsupported type").when(size > MAX_UPLOAD, "too large").when(is_blank(name), "name is required")
        .when(is_blank(phone), "phone is required").when(mime.isNull() | size.isNull(), "file is required")
    )


def clamp_limit(limit, default: int = 100, most: int = 500) -> int | None:
    """None means all rows, as a negative limit does."""
    try:
        n = int(float(limit)) or default
    except (TypeError, ValueError):
        n = default
    return None if n < 0 else min(n, most)


def link_submissions(submissions: DataFrame, people: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(submissions with person_id and created, new people, new identifiers).

    submissions: submission_id, name, phone. A phone that is known belongs to its person; of those
    that are not, equal phones make one new person, named by the first submission; submissions
    without a usable phone make a person each.
    """
    subs = submissions.withColumns({"normalised_phone": N.phone(F.col("phone"))["value"],
        "display": F.coalesce(N.name(F.col("name"))["value"], ws_trim(F.coalesce("name", F.lit(""))))})
    known = identifiers.where("id_type = 'phone'").groupBy(F.col("value").alias("normalised_phone")).agg(F.min("person_id").alias("known_id"))
    found = subs.join(known, "normalised_phone", "left")
    key = F.coalesce("normalised_phone", F.concat(F.lit("#"), F.col("submission_id").cast("string")))
    fresh = found.where("known_id IS NULL").groupBy(key.alias("key")).agg(F.min("submission_id").alias("first"),
        F.min_by("display", "submission_id").alias("full_name"), F.first("normalised_phone").alias("primary_phone"))
    top = people.agg(F.coalesce(F.max("person_id"), F.lit(0))).first()[0]
    fresh = numbered(fresh, "first", "new_id", first=top + 1)
    linked = found.join(fresh.select(F.col("key").alias("k"), "new_id", "first"), key == F.col("k"), "left").select(
        "submission_id", "name", "phone", "normalised_phone", F.coalesce("known_id", "new_id").alias("person_id"),
            (F.col("known_id").isNull() & (F.col("submission_id") == F.col("first"))).alias("created")
    )
    new_people = fresh.select(F.col("new_id").alias("person_id"), "full_name", "primary_phone", F.lit("single-source").alias("match_confidence"),
        F.lit("created from a submission").alias("match_reason"))
    new_ids = fresh.where("primary_phone IS NOT NULL").select(F.col("new_id").alias("person_id"), F.lit("phone").alias("id_type"),
        F.col("primary_phone").alias("value"), F.lit("audio_app").alias("source_file"), F.lit(1).alias("is_primary"))
    return linked, new_people, new_ids


def list_submissions(submissions: DataFrame, people: DataFrame) -> DataFrame:
    """Newest first, with the person's name, city and confidence."""
    return submissions.join(people.select("person_id", F.col("full_name").alias("matched_name"), "city", "match_confidence"), "person_id",
        "left").orderBy(F.desc("submission_id"))


def get_submission(submissions: DataFrame, submission_id: int) -> DataFrame:
    """A point lookup; the filter reaches the scan."""
    return submissions.where(F.col("submission_id") == submission_id)


def insert_submission(rows: DataFrame, path: str) -> None:
    """K5, D3: append those rows whose submission_id the table at path lacks, so a batch that is sent
    twice is stored once; of equal new ids one. Rows without an id are appended as they are.

    Only the table's row groups between the least and the largest new id are read. One writer at a time.
    """
    spark = rows.sparkSession
    new = written(rows, "submissions")
    fresh = new.where("submission_id IS NOT NULL").dropDuplicates(["submission_id"])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        low, high = new.agg(F.min("submission_id"), F.max("submission_id")).first()
        known = spark.read.schema(new.schema).parquet(path).where(F.col("submission_id").between(low, high)).select("submission_id")
        fresh = fresh.join(known, "submission_id", "left_anti")
    fresh.unionByName(new.where("submission_id IS NULL")).write.mode("append").parquet(path)


def display_submissions(listed: DataFrame) -> DataFrame:
    """P10: a listing (J5) with its measures as text."""
    return listed.select(
        "submission_id", F.coalesce(F.concat("matched_name", F.lit(" #"), F.col("person_id").cast("string")), F.lit("unlinked")).alias("person"),
        D.kilohertz(F.col("sample_rate_hz")).alias("rate"), D.measure(F.col("snr_db")).alias("snr"), D.kilobytes(F.col("size_bytes")).alias("size"),
            D.pill(F.col("quality_label")).alias("pill"),
    )


def with_skills(people: DataFrame, person_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """People with `skills`, their canonical names joined in the order of skill_id; '' for none."""
    named = person_skills.join(skills, "skill_id").groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("skill_id",
        "canonical_name"))), lambda s: s["canonical_name"]), ", ").alias("skills"))
    return people.join(named, "person_id", "left").withColumn("skills", F.coalesce("skills", F.lit("")))


def list_people(people: DataFrame, person_skills: DataFrame, skills: DataFrame, limit=100, untagged: bool = False) -> DataFrame:
    """At most `limit` people by id; untagged: those with skills and no category.

    The page is found first; skills are gathered for the people on it alone.
    """
    page = people
    if untagged:
        named = person_skills.join(skills.where("canonical_name <> ''").select("skill_id"), "skill_id", "left_semi")
        page = page.where("skill_category IS NULL").join(named, "person_id", "left_semi")
    n = clamp_limit(limit)
    if n is not None:
        page = written(page.select("person_id", "full_name", "city", "skill_category").orderBy("person_id").limit(n), "page")
        person_skills = person_skills.join(F.broadcast(page.select("person_id")), "person_id", "left_semi")  # a page: at most 500 ids
    return with_skills(page, person_skills, skills).select("person_id", "full_name", "city", "skill_category", "skills").orderBy("person_id")


def sanitise_reply(reply: Column) -> Column:
    """The category a free-text reply names: as a word of its own, else anywhere; else null."""
    clean = F.regexp_replace(F.lower(F.coalesce(reply, F.lit(""))), "[^a-z-]", " ")
    tokens = F.split(ws_collapse(clean), " ")
    allowed = F.array(*map(F.lit, CATEGORIES))
    return F.coalesce(F.get(F.filter(allowed, lambda c: F.array_contains(tokens, c)), F.lit(0)),
        F.get(F.filter(allowed, lambda c: F.contains(ws_trim(clean), c)), F.lit(0)))


def tag_outcomes(updates: DataFrame, people: DataFrame) -> DataFrame:
    """Updates (person_id, skill_category) with outcome: 'invalid' before 'missing', else 'updated'."""
    known = people.select(F.col("person_id"), F.lit(True).alias("known"))
    tidy = ws_trim(F.coalesce("skill_category", F.lit("")))
    outcome = F.when(~tidy.isin(*CATEGORIES), "invalid").when(F.col("known").isNull(), "missing").otherwise("updated")
    return updates.join(known, "person_id", "left").select("person_id", tidy.alias("skill_category"), outcome.alias("outcome"))


def apply_tags(people: DataFrame, outcomes: DataFrame, order: str | None = None) -> DataFrame:
    """People with the categories of valid updates; of several for a person the last by `order`."""
    good = outcomes.where("outcome = 'updated'")
    last = good.groupBy("person_id").agg((F.max_by("skill_category", order) if order else F.max("skill_category")).alias("_new"))
    return people.join(last, "person_id", "left").withColumn("skill_category", F.coalesce("_new", "skill_category")).drop("_new")


@dataclass(frozen=True)
class TagFlow:
    """L1: how a run of the tagging flow goes: people a run (-1: all), tries of a person, seconds between them."""

    limit: int = 10
    tries: int = 4
    wait: float = 2.0


def tag_untagged(people: DataFrame, person_skills: DataFrame, skills: DataFrame, classify, flow: TagFlow = TagFlow()) -> tuple[DataFrame, DataFrame]:
    """(people with new categories, outcomes of the run) of the first untagged people by id."""
    asked = list_people(people, person_skills, skills, limit=flow.limit, untagged=True)
    replies = classify_untagged(asked, classify, flow.tries, flow.wait)
    outcomes = tag_outcomes(replies.where("valid").select("person_id", "skill_category"), people)
    outcomes = written(outcomes, "tag-outcomes")  # a reply is asked for once
    return apply_tags(people, outcomes), outcomes


def classify_untagged(people: DataFrame, classify, tries: int = 4, wait: float = 2.0) -> DataFrame:
    """person_id, raw_reply, skill_category, valid, tries, error. classify: function from a
    pandas frame with full_name and skills to a series of replies, run on batches in tasks.

    A batch that fails is asked for again person by person, after `wait` seconds and until each has
    been tried `tries` times. Who keeps failing has an empty reply and the last error (see
    `dead_letters`); the others of the batch are not lost.
    """
    import time

    import pandas as pd

    def asked(pdf):
        """Replies, or the error."""
        try:
            replies = list(classify(pdf))
            if len(replies) != len(pdf):
                raise ValueError(f"{len(replies)} replies to {len(pdf)} people")
            return replies, None
        except Exception as e:  # noqa: BLE001  an outside service
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            replies, error = asked(pdf)
            out = pd.DataFrame({"person_id": pdf["person_id"], "raw_reply": replies or [""] * len(pdf), "tries": 1, "error": error})
            open_ = [] if error is None else list(range(len(pdf)))
            for n in range(2, tries + 1):
                if not open_:
                    break
                time.sleep(wait)
                left = []
                for i in open_:
                    replies, error = asked(pdf.iloc[i : i + 1])
                    out.loc[out.index[i], ["raw_reply", "tries", "error"]] = ["" if error else replies[0], n, error]
                    if error:
                        left.append(i)
                open_ = left
            yield out

    said = people.select("person_id", "full_name", "skills").mapInPandas(run, "person_id long, raw_reply string, tries long, error string")
    category = sanitise_reply(F.col("raw_reply"))
    return said.select("person_id", "raw_reply", category.alias("skill_category"), category.isNotNull().alias("valid"), "tries", "error")


def dead_letters(replies: DataFrame) -> DataFrame:
    """L4: people whose every try failed, with the last error."""
    return replies.where("error IS NOT NULL").select("person_id", "tries", "error")


def stats(people: DataFrame, submissions: DataFrame, issues: DataFrame) -> DataFrame:
    """A1: one row of counts."""
    one = people.agg(F.count("*").alias("people"), F.count("skill_category").alias("tagged"))
    return one.crossJoin(submissions.agg(F.count("*").alias("submissions"))).crossJoin(issues.agg(F.count("*").alias("issues"))).select("people",
        "submissions", "tagged", "issues")


def summary_text(counts: DataFrame) -> DataFrame:
    """One row with a text."""
    return counts.select(F.format_string("Skill tagging: %d of %d people have a category; %d submissions; %d issues logged", "tagged", "people",
        "submissions", "issues").alias("text"), "*")


def put_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """D3: table with those rows whose key it lacks; of equal new keys one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti").select(*table.columns))
