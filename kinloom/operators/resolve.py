"""Who is the same person.

Three tiers. Records of one email are one cluster; clusters that share a phone are joined; a cluster
with emails only and one with phones only are joined if they share name and city and nothing speaks
against it. Edges are stars from the first record of a key, so their number is linear in records.

What a reason says depends on the order in which keys were seen, as a union that joins nothing
leaves no trace. The edges that do join are the minimum spanning forest by that order, which is
found by Boruvka's rounds: every component takes its least edge, all at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components
from kinloom.operators.ranking import numbered
from kinloom.shared import written


def star_edges(records: DataFrame, key: str) -> DataFrame:
    """(src, dst, value): from the first record of each key to its others; null and '' match nothing.

    A minimum and an equi-join rather than a window: a key that many records share stays divisible.
    """
    keyed = records.where(F.col(key).isNotNull() & (F.col(key) != "")).select("record_id", F.col(key).alias("value"))
    first = keyed.groupBy("value").agg(F.min("record_id").alias("src"))
    return keyed.join(first.hint("merge"), "value").where("record_id > src").select("src", F.col("record_id").alias("dst"), "value")


def labelled(records: DataFrame, parts: DataFrame, node: str = "record_id", name: str = "cluster") -> DataFrame:
    """(node, name): each record's component by parts (node, component), itself if it has none."""
    parts = parts.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return records.select(node).join(parts.hint("merge"), node, "left").select(node, F.coalesce("_c", node).alias(name))


def forest(edges: DataFrame, rank: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the edges (a, b, ..., rank columns) that a union in the order of `rank` would make, components).

    Ranks do not repeat. A component with one edge less than nodes has no edge to spare, so all of
    its edges join; only the others go through Boruvka's rounds.
    """
    edges = written(edges.where("a <> b"), "forest-edges")
    parts = written(connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "forest-parts")
    per_node = parts.groupBy("component").agg((F.count("*") - 1).alias("n"))
    mine = edges.join(parts.select(F.col("node").alias("a"), "component"), "a")
    spare = mine.groupBy("component").agg(F.count("*").alias("m")).join(per_node, "component").where("m > n").select("component")
    spare = written(spare, "forest-spare")
    if spare.isEmpty():
        return edges, parts
    tree = mine.join(spare, "component", "left_anti").select(*edges.columns)
    rest = mine.join(spare, "component", "left_semi").select(*edges.columns)
    return tree.unionByName(spanning_forest(rest, rank)), parts


def spanning_forest(edges: DataFrame, rank: list[str], max_rounds: int = 40) -> DataFrame:
    """The minimum spanning forest by rank: every component takes its least edge, all at once, until none is left."""
    left = written(edges.where("a <> b").withColumn("_a", F.col("a")).withColumn("_b", F.col("b")), "forest")
    taken = None
    key = F.struct(*rank)
    for _ in range(max_rounds):
        if left.isEmpty():
            return (taken if taken is not None else left).drop("_a", "_b")
        ends = left.select(F.col("_a").alias("c"), key.alias("r")).unionByName(left.select(F.col("_b").alias("c"), key.alias("r")))
        least = ends.groupBy("c").agg(F.min("r").alias("r")).select("r.*").distinct()
        picked = written(left.join(least, rank), "picked")
        taken = picked if taken is None else taken.unionByName(picked)
        parts = written(connected_components(picked.select(F.col("_a").alias("src"), F.col("_b").alias("dst"))), "parts")
        for end in ("_a", "_b"):
            left = left.join(parts.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        left = written(left.where("_a <> _b"), "forest")
    raise RuntimeError(f"forest not complete after {max_rounds} rounds")


def joined_before(asked: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """M7: those of asked (id, e, p, seen) whose e and p edges (a, b, seen) of lesser rank connect, directly or by a chain.

    A search from every e at once, along edges that its rank allows; ends of rows that are asked
    about lie in small components, of clusters that names and cities link.
    """
    step = edges.select(F.col("a").alias("at"), F.col("b").alias("to"), F.col("seen").alias("by"))
    step = step.unionByName(edges.select(F.col("b").alias("at"), F.col("a").alias("to"), F.col("seen").alias("by")))
    front = asked.select("id", "p", "seen", F.col("e").alias("at"))
    been = front
    for _ in range(max_rounds):
        front = front.join(step, "at").where("by < seen").select("id", "p", "seen", F.col("to").alias("at")).distinct().join(been, ["id", "at"],
            "left_anti").select("id", "p", "seen", "at")
        front = written(front, "front")
        if front.isEmpty():
            return been.where("at = p").select("id")
        been = been.unionByName(front)
    raise RuntimeError(f"chains of bridges not walked through after {max_rounds} rounds")


def _where(r: str = "") -> Column:
    return F.concat_ws(":", F.col(f"{r}source_file"), F.col(f"{r}source_row").cast("string"))


def _issues(df: DataFrame, kind: str, severity: str, raw: Column, action: str, detail: Column) -> DataFrame:
    return df.select("source_file", "source_row", F.lit(None).cast("string").alias("column_name"), F.lit(kind).alias("issue_type"),
        F.lit(severity).alias("severity"), raw.alias("raw_value"), F.lit(action).alias("action_taken"), detail.alias("detail"))


@dataclass
class Resolution:
    """members: record_id, person_id, cluster; clusters: person_id, size, match_confidence, match_reason;
    issues; review: reason, name_city, n (clusters to choose from), detail; candidates: reason,
    name_city, cluster, source_file, source_row, a row for each record of these clusters."""

    members: DataFrame
    clusters: DataFrame
    issues: DataFrame
    review: DataFrame
    candidates: DataFrame


def describe(records: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: (clusters, names, cities) as they stand after tier 2.

    clusters: cluster, first_record, n, side (which identifiers it has), signature (of its set of
    skills, '' for none); names and cities: cluster and one of its values. Names with initials and
    unknown cities do not count. A cluster's values stay rows, however many share a phone.
    """
    rows = records.join(labels.hint("merge"), "record_id")
    email, phone = (F.max(F.col(c).isNotNull() & (F.col(c) != "")) for c in ("email", "phone"))
    side = F.when(F.col("_e") & F.col("_p"), "both").when(F.col("_e"), "email").when(F.col("_p"), "phone").otherwise("none")
    skills = rows.select("cluster", F.explode(F.transform("skills", lambda s: s["match_key"])).alias("k")).distinct()
    skills = skills.groupBy("cluster").agg(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64(F.lit(7), "k"))).alias("signature"))
    clusters = rows.groupBy("cluster").agg(F.min("record_id").alias("first_record"), F.count("*").alias("n"), email.alias("_e"),
        phone.alias("_p")).join(skills.hint("merge"), "cluster", "left")
    clusters = clusters.select("cluster", "first_record", "n", side.alias("side"), F.coalesce("signature", F.lit("")).alias("signature"))
    names = rows.where("name_key IS NOT NULL AND NOT has_initial").select("cluster", "name_key").distinct()
    cities = rows.where("city IS NOT NULL AND city_canonical").select("cluster", "city").distinct()
    return clusters, names, cities


def bridge_candidates(clusters: DataFrame, names: DataFrame, cities: DataFrame) -> DataFrame:
    """M5 to M9: each (name_key, city) of two or more clusters, with its verdict.

    verdict: 'ambiguous' (guard 1), 'claimed' (guard 2: a complete cluster has the same skills), or
    'join'. e and p: the clusters with emails only and with phones only. seen: the key's rank. Only
    counts and minima are taken of a key's clusters.
    """
    keyed = clusters.join(names.hint("merge"), "cluster").join(cities.hint("merge"), "cluster")
    only = lambda side, c: F.min(F.when(F.col("side") == side, F.col(c)))
    groups = keyed.groupBy("name_key", "city").agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "email").alias("n_email"), F.count_if(F.col("side") == "phone").alias("n_phone"),
            F.count_if(F.col("side") == "both").alias("n_both"),
        only("email", "cluster").alias("e"), only("phone", "cluster").alias("p"), only("email", "signature").alias("e_signature"),
            F.min("first_record").alias("first_record"),
        only("both", "first_record").alias("other"),
    ).where("n >= 2")
    both = keyed.where("side = 'both'").select("name_key", "city", F.col("signature").alias("s"))
    claimed = groups.where("n_email = 1 AND n_phone = 1 AND e_signature <> ''").join(both.hint("merge"),
        ["name_key", "city"]).where("s = e_signature").select("name_key", "city").distinct().withColumn("claim", F.lit(True))
    verdict = F.when((F.col("n_email") != 1) | (F.col("n_phone") != 1), "ambiguous").when(F.col("claim"), "claimed").otherwise("join")
    return groups.join(claimed.hint("merge"), ["name_key", "city"], "left").select(
        "name_key", "city", F.concat_ws(" / ", "name_key", "city").alias("name_city"), "n", "n_email", "n_phone", "n_both", "e", "p", "other",
        F.struct("first_record", "name_key", "city").alias("seen"), "first_record", verdict.alias("verdict"),
    )


def near_misses(clusters: DataFrame, names: DataFrame, cities: DataFrame, final: DataFrame) -> DataFrame:
    """name_key, reason, name_city, n, detail of names of two or more people who show two or more
    cities. Of cities there are only the known ones, so they are listed."""
    named = names.join(final, "cluster").join(clusters.select("cluster", "first_record"), "cluster")
    people = named.groupBy("name_key").agg(F.count_distinct("person").alias("people"), F.count("*").alias("n")).where("people >= 2")
    shown = named.join(cities, "cluster").groupBy("name_key",
        "city").agg(F.min("first_record").alias("f")).groupBy("name_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "city"))),
        lambda x: x["city"]).alias("cities"))
    return people.join(shown.where(F.size("cities") >= 2), "name_key").select(
        "name_key", F.lit("same_name_different_city").alias("reason"), F.concat_ws(" / ", "name_key", F.array_join("cities", " vs ")).alias("name_city"), "n",
        F.format_string('%d people are called "%s", in different cities; a name alone joins no one', "people", "name_key").alias("detail"),
    )


def resolve(records: DataFrame) -> Resolution:
    """Staged records to persons. record_id fixes the order in which keys are seen."""
    records = records.drop("issues")
    at = records.select("record_id", "source_file", "source_row", "name", "email")
    mine = {end: at.select(*[F.col(c).alias(f"{end}_{c}") for c in at.columns]) for end in ("src", "dst")}

    def ends(edges: DataFrame) -> DataFrame:
        out = edges.join(mine["src"], edges["src"] == F.col("src_record_id")).join(mine["dst"], edges["dst"] == F.col("dst_record_id"))
        return out.withColumns({"source_file": F.col("dst_source_file"), "source_row": F.col("dst_source_row")})

    both_rows = F.concat_ws(", ", _where("src_"), _where("dst_"))
    # Tier 1: every edge joins, as a record has one email.
    by_email = written(star_edges(records, "email"), "email-edges")
    tier1 = records.select("record_id").join(by_email.select(F.col("dst").alias("record_id"), F.col("src").alias("_c")), "record_id",
        "left").select("record_id", F.coalesce("_c", "record_id").alias("c1"))
    renamed = ends(by_email).where(~F.col("src_name").eqNullSafe(F.col("dst_name")))
    issues = _issues(renamed, "duplicate_person_same_email", "high", F.concat_ws(" / ", "src_name", "dst_name"), "merged on the shared email",
        F.concat(F.lit("two names for "), F.col("value"), F.lit(": "), both_rows))
    # Tier 2: the edges that join something, in the order of phones as first seen.
    by_phone = star_edges(records, "phone")
    by_phone = by_phone.join(tier1.select(F.col("record_id").alias("src"), F.col("c1").alias("a")),
        "src").join(tier1.select(F.col("record_id").alias("dst"), F.col("c1").alias("b")), "dst")
    joined, parts = forest(by_phone, ["src", "dst"])
    tier2 = written(tier1.join(parts.select(F.col("node").alias("c1"), "component"), "c1", "left").select("record_id",
        F.coalesce("component", "c1").alias("cluster")), "tier2")
    two = ends(joined).where(F.col("src_email") != F.col("dst_email"))
    issues = issues.unionByName(_issues(two, "same_person_two_emails", "high", F.concat_ws(" / ", "src_email", "dst_email"),
        "merged on the shared phone, both emails kept", F.concat(F.lit("one person with two emails: "), both_rows)))
    # Tier 3: on the clusters as they stand now; they are not described anew as it goes on.
    clusters, names, cities = describe(records, tier2)
    clusters = written(clusters, "clusters")
    keys = written(bridge_candidates(clusters, names, cities), "bridges")
    bridges, parts = forest(keys.where("verdict = 'join'").select(F.col("e").alias("a"), F.col("p").alias("b"), "name_key", "city", "name_city",
        "seen", "other", "n_both"), ["seen"])
    final = written(labelled(clusters, parts, "cluster", "person"), "persons")
    # A claimed pair that earlier keys have joined already is passed over (M7); few are in one component at all.
    claimed = keys.where("verdict = 'claimed'")
    whose = lambda c: final.select(F.col("cluster").alias(c), F.col("person").alias(f"{c}_person"))
    doubtful = written(claimed.join(whose("e"), "e").join(whose("p"),
        "p").where("e_person = p_person").select(F.struct("name_key", "city").alias("id"), "e", "p", "seen"), "doubtful")
    if not doubtful.isEmpty():
        before = joined_before(doubtful, bridges).select("id.*")
        claimed = written(claimed.join(before, ["name_key", "city"], "left_anti"), "claimed")
    where_ = clusters.select(F.col("cluster").alias("w"), F.col("first_record").alias("record_id"),
        F.col("n").alias("w_n")).join(at.select("record_id", "source_file", "source_row"), "record_id")
    located = lambda df, c: df.join(where_, df[c] == F.col("w"))
    first = keys.where("verdict = 'ambiguous'").withColumn("record_id", F.col("first_record")).join(at.select("record_id", "source_file", "source_row"), "record_id")
    guard1 = F.format_string("%d clusters share name and city, %d with emails only and %d with phones only", "n", "n_email", "n_phone")
    guard2 = F.lit("a cluster with both identifiers shares name, city and skills with the row that has an email only")
    apart = "not merged, queued for review"
    issues = issues.unionByName(_issues(first, "ambiguous_name_match", "high", F.col("name_city"), apart, guard1))
    issues = issues.unionByName(_issues(located(claimed, "e"), "ambiguous_name_match", "high", F.col("name_city"), apart, guard2))
    other = at.select(F.col("record_id").alias("other"), _where().alias("other_at"))
    third = located(bridges.where("n_both > 0"), "b").join(other, "other")
    issues = issues.unionByName(_issues(third, "name_city_shared_with_third_person", "medium", F.col("name_city"),
        "merged, the cluster with both identifiers ruled out",
        F.format_string("%d clusters with both identifiers are called so, there; the first begins at %s", "n_both", "other_at")))
    a_rows = clusters.select(F.col("cluster").alias("a"), F.col("n").alias("a_n"),
        F.col("first_record").alias("a_first")).join(at.select(F.col("record_id").alias("a_first"), _where().alias("a_at")), "a_first")
    merged = located(bridges, "b").join(a_rows, "a")
    issues = issues.unionByName(_issues(merged, "matched_on_name_and_city", "medium", F.col("name_city"), "merged at medium confidence",
        F.format_string("no identifier links these rows: %d from %s on, %d from %s on", "a_n", "a_at", "w_n", _where())))
    missed = written(near_misses(clusters, names, cities, final), "near-misses")
    queued = keys.where("verdict = 'ambiguous'").select("name_key", "city", F.lit("ambiguous_name_match").alias("reason"), "name_city", "n", guard1.alias("detail"))
    queued = queued.unionByName(claimed.select("name_key", "city", F.lit("complete_cluster_may_own_row").alias("reason"), "name_city", "n", guard2.alias("detail")))
    review = queued.drop("name_key", "city").unionByName(missed.drop("name_key"))
    candidates = queued.join(names, "name_key").join(cities, ["cluster", "city"]).select("reason", "name_city", "cluster")
    candidates = candidates.unionByName(missed.join(names, "name_key").select("reason", "name_city", "cluster"))
    candidates = candidates.join(tier2, "cluster").join(at.select("record_id", "source_file", "source_row"), "record_id").drop("record_id")
    # M12 to M14. A cluster is called by its smallest record, so persons are numbered by first record.
    ids = numbered(final.groupBy("person").agg(F.min("cluster").alias("first_record")), "first_record", "person_id")
    members = written(tier2.join(final, "cluster").join(ids.select("person", "person_id"), "person").select("record_id", "cluster", "person_id"), "members")
    said = lambda df, a, b, text: df.select(F.explode(F.array(a, b)).alias("record_id"), text.alias("reason"))
    reasons = said(by_email, "src", "dst", F.concat(F.lit("tier1: same email "), F.col("value")))
    reasons = reasons.unionByName(said(joined, "src", "dst", F.concat(F.lit("tier2: same phone "), F.col("value"))))
    reasons = reasons.unionByName(said(bridges, "a", "b", F.concat(F.lit('tier3: same name+city "'), F.col("name_city"), F.lit('" (no shared identifier)'))))
    per = members.join(reasons, "record_id", "left").groupBy("person_id").agg(F.count_distinct("record_id").alias("size"),
        F.array_sort(F.collect_set("reason")).alias("why"))
    sure = F.exists("why", lambda r: r.startswith("tier1") | r.startswith("tier2"))
    confidence = F.when(F.col("size") == 1, "single-source").when(sure, "high").when(F.size("why") > 0, "medium").otherwise("single-source")
    text = F.when(F.size("why") > 0, F.array_join("why", "; ")).otherwise("only appears in one source")
    clusters = per.select("person_id", "size", confidence.alias("match_confidence"), text.alias("match_reason"))
    return Resolution(members, written(clusters, "reasons"), written(issues, "match-issues"), review, candidates)
