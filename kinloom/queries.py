"""Registered queries of the engine's own operators, and the SQL that says the same.

The driver's tables hold no messy people, so they are derived from `customer` by SQL that Spark and
DuckDB read alike: MESSY has one column for each normaliser, RECORDS three sources of people with
known truth. The SQL of each query states results by rules of its own or by that truth; it does not
repeat the Column expressions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import normalise as N
from kinloom.operators import audio, linkage, quantile, resolve, samples, structural
from kinloom.operators.components import connected_components
from kinloom.operators.staging import stage_all
from kinloom.plans import merge, report, store
from kinloom.shared import dealt, sorted_joins, written
from kinloom.sources.specs import APPLICANTS, CONTACTS, GIG_WORKERS

_S = "CAST({} AS STRING)"
_ABC = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"
_CORE = "concat(CAST(6 + {0} % 4 AS STRING), lpad(CAST(({0} * 7919) % 1000000000 AS STRING), 9, '0'))"

MESSY = f"""
SELECT c_custkey AS k, {_CORE.format('c_custkey')} AS core, {_ABC.format('c_custkey')} AS abc, c_acctbal AS amount,
  CASE c_custkey % 9 WHEN 0 THEN concat('+91', {_CORE.format('c_custkey')}) WHEN 1 THEN {_CORE.format('c_custkey')} WHEN 2 THEN concat('0', {_CORE.format('c_custkey')})
    WHEN 3 THEN concat('91', {_CORE.format('c_custkey')}) WHEN 4 THEN concat('+91-', {_CORE.format('c_custkey')})
    WHEN 5 THEN concat('+91 ', substr({_CORE.format('c_custkey')}, 1, 5), ' ', substr({_CORE.format('c_custkey')}, 6, 5)) WHEN 6 THEN '12345' WHEN 7 THEN '  '
    ELSE concat('1', substr({_CORE.format('c_custkey')}, 2, 9)) END AS raw_phone,
  CASE c_custkey % 6 WHEN 0 THEN concat('u', {_S.format('c_custkey')}, '@mail.example.org') WHEN 1 THEN concat('U', {_S.format('c_custkey')}, '@MAIL.EXAMPLE.ORG')
    WHEN 2 THEN concat(' User', {_S.format('c_custkey')}, '@mail.example.org ') WHEN 3 THEN 'broken.example.org' WHEN 4 THEN NULL ELSE concat('a b', {_S.format('c_custkey')}, '@x.y') END AS raw_email,
  CASE c_custkey % 6 WHEN 0 THEN concat('Asha N', {_ABC.format('c_custkey')}) WHEN 1 THEN upper(concat('Asha N', {_ABC.format('c_custkey')})) WHEN 2 THEN concat('  asha   n', {_ABC.format('c_custkey')}, ' ')
    WHEN 3 THEN concat('A. N', {_ABC.format('c_custkey')}) WHEN 4 THEN '' ELSE concat('N', {_ABC.format('c_custkey')}, ' Asha') END AS raw_name,
  CASE c_custkey % 8 WHEN 0 THEN 'GURGAON' WHEN 1 THEN 'gurugram ' WHEN 2 THEN 'Bangalore' WHEN 3 THEN 'Delhi NCR' WHEN 4 THEN 'PUNE' WHEN 5 THEN 'jaipur' WHEN 6 THEN NULL ELSE ' new  delhi' END AS raw_city,
  CASE c_custkey % 8 WHEN 0 THEN concat('2026-', lpad({_S.format('1 + c_custkey % 12')}, 2, '0'), '-', lpad({_S.format('1 + c_custkey % 28')}, 2, '0'))
    WHEN 1 THEN concat(lpad({_S.format('1 + c_custkey % 12')}, 2, '0'), '/', lpad({_S.format('1 + c_custkey % 28')}, 2, '0'), '/2026') WHEN 2 THEN concat(lpad({_S.format('1 + c_custkey % 28')}, 2, '0'), '-', lpad({_S.format('1 + c_custkey % 12')}, 2, '0'), '-2026')
    WHEN 3 THEN concat({_S.format('1 + c_custkey % 28')}, ' Jul 2026') WHEN 4 THEN '31/12/2026' WHEN 5 THEN '2026-02-30' WHEN 6 THEN '' ELSE '7/3/2026' END AS raw_date,
  CASE c_custkey % 6 WHEN 0 THEN {_S.format('100000 + c_custkey')} WHEN 1 THEN concat({_S.format('1 + c_custkey % 90')}, '.5') WHEN 2 THEN concat('4,', lpad({_S.format('c_custkey % 1000')}, 3, '0'), ',000') WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE '12d' END AS raw_ctc,
  CASE c_custkey % 6 WHEN 0 THEN concat({_S.format('100 + c_custkey % 900')}, '/hr') WHEN 1 THEN concat({_S.format('10 + c_custkey % 90')}, 'k/month') WHEN 2 THEN concat({_S.format('1 + c_custkey % 90')}, 'K / mo') WHEN 3 THEN 'on request' WHEN 4 THEN '' ELSE '1.2.3/hr' END AS raw_rate,
  CASE c_custkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN ' Paused ' WHEN 3 THEN 'gone' WHEN 4 THEN NULL ELSE 'Inactive' END AS raw_status,
  CASE c_custkey % 6 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' WHEN 2 THEN 'N' WHEN 3 THEN 'maybe' WHEN 4 THEN '' ELSE 'False' END AS raw_verified,
  CASE c_custkey % 6 WHEN 0 THEN {_S.format('c_custkey')} WHEN 1 THEN concat({_S.format('c_custkey')}, '.0') WHEN 2 THEN '2.5' WHEN 3 THEN 'NaN' WHEN 4 THEN NULL ELSE '1e3' END AS raw_int,
  CASE c_custkey % 6 WHEN 0 THEN concat({_S.format('c_custkey % 40')}, '.5') WHEN 1 THEN {_S.format('c_custkey % 40')} WHEN 2 THEN 'Infinity' WHEN 3 THEN '12d' WHEN 4 THEN ' ' ELSE '-1.25' END AS raw_real,
  CASE c_custkey % 6 WHEN 0 THEN 'Python, pandas' WHEN 1 THEN 'rest  apis,REST APIs,docker' WHEN 2 THEN 'Cobol, n8n' WHEN 3 THEN ' , ,sql' WHEN 4 THEN '' ELSE 'React' END AS raw_skills
FROM customer
"""

#: The rule of each normaliser: value as text, then its issue types in order, in DuckDB's SQL.
_K6 = "k % 6"
_RULES = {
    "phone": (
        "CASE k % 9 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN concat('+911', substr(core, 2, 9)) ELSE concat('+91', core) END",
        "CASE WHEN k % 9 = 6 THEN 'phone_invalid:high' END, CASE WHEN k % 9 = 8 THEN 'phone_suspicious:medium' END, CASE WHEN k % 9 NOT IN (0, 6, 7) THEN 'phone_format:low' END",
    ),
    "email": (
        "CASE WHEN regexp_full_match(lower(trim(raw_email)), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(trim(raw_email)) END",
        "CASE WHEN trim(raw_email) <> lower(raw_email) AND k % 6 IN (1, 2) THEN 'email_case:medium' END, CASE WHEN k % 6 IN (3, 5) THEN 'email_invalid:high' END",
    ),
    "name": (
        "CASE k % 6 WHEN 4 THEN NULL WHEN 3 THEN concat('A. N', abc) WHEN 5 THEN concat('N', abc, ' Asha') ELSE concat('Asha N', abc) END",
        "CASE WHEN k % 6 = 2 THEN 'name_whitespace:low' END, CASE WHEN k % 6 = 1 THEN 'name_case:low' END, CASE WHEN k % 6 = 3 THEN 'name_abbreviated:medium' END",
    ),
    "city": (
        "CASE k % 8 WHEN 0 THEN 'Gurugram' WHEN 1 THEN 'Gurugram' WHEN 2 THEN 'Bengaluru' WHEN 3 THEN 'Delhi' WHEN 4 THEN 'Pune' WHEN 5 THEN 'Jaipur' WHEN 7 THEN 'Delhi' END",
        "CASE WHEN k % 8 IN (1, 7) THEN 'city_whitespace:low' END, CASE WHEN k % 8 = 5 THEN 'city_unknown:medium' END, CASE WHEN k % 8 IN (0, 2, 3, 7) THEN 'city_variant:low' END",
    ),
    "date": (
        "CAST(CASE WHEN k % 8 IN (0, 1, 2) THEN make_date(2026, 1 + k % 12, 1 + k % 28) WHEN k % 8 = 3 THEN make_date(2026, 7, 1 + k % 28) END AS VARCHAR)",
        "CASE WHEN (k % 8 IN (1, 2) AND 1 + k % 28 <= 12) OR k % 8 = 7 THEN 'date_ambiguous:high' END, CASE WHEN k % 8 IN (4, 5, 7) THEN 'date_unparseable:high' END, CASE WHEN k % 8 IN (1, 2, 3) THEN 'date_format:low' END",
    ),
    "ctc": (
        "CAST(CASE k % 6 WHEN 0 THEN 100000 + k WHEN 1 THEN (1 + k % 90) * 100000 + 50000 WHEN 2 THEN 4000000 + (k % 1000) * 1000 END AS VARCHAR)",
        "CASE WHEN k % 6 IN (3, 5) THEN 'ctc_unparseable:high' END, CASE WHEN k % 6 = 1 THEN 'ctc_mixed_units:high' END",
    ),
    "rate": (
        "CAST(CAST(round(100 * CASE k % 6 WHEN 0 THEN 100 + k % 900 WHEN 1 THEN round((10 + k % 90) * 1000 / 176.0, 2) WHEN 2 THEN round((1 + k % 90) * 1000 / 176.0, 2) END) AS BIGINT) AS VARCHAR)",
        "CASE WHEN k % 6 IN (3, 5) THEN 'rate_unparseable:high' END, CASE WHEN k % 6 IN (1, 2) THEN 'rate_mixed_units:medium' END",
    ),
    "status": (
        "CASE k % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'paused' WHEN 5 THEN 'inactive' ELSE 'unknown' END",
        "CASE WHEN k % 6 = 3 THEN 'status_unknown:medium' END, CASE WHEN k % 6 IN (1, 2, 5) THEN 'status_case:low' END",
    ),
    "verified": (
        "CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 5 THEN '0' END",
        "CASE WHEN k % 6 = 3 THEN 'verified_unparseable:medium' END, CASE WHEN k % 6 IN (0, 1, 2, 5) THEN 'boolean_inconsistent:low' END",
    ),
    "integer": ("CASE WHEN k % 6 IN (0, 1) THEN CAST(k AS VARCHAR) WHEN k % 6 = 5 THEN '1000' END", "CASE WHEN k % 6 IN (2, 3) THEN 'integer_unparseable:medium' END"),
    "real": ("CAST(CAST(100 * CASE k % 6 WHEN 0 THEN k % 40 + 0.5 WHEN 1 THEN k % 40 WHEN 5 THEN -1.25 END AS BIGINT) AS VARCHAR)",
        "CASE WHEN k % 6 IN (2, 3) THEN 'float_unparseable:medium' END"),
    "skills": (
        "CASE k % 6 WHEN 0 THEN 'Python/python|Pandas/pandas' WHEN 1 THEN 'REST APIs/rest apis|Docker/docker' WHEN 2 THEN 'Cobol/cobol|n8n/n8n' WHEN 3 THEN 'SQL/sql' WHEN 4 THEN '' ELSE 'React/react' END",
        "CASE WHEN k % 6 = 1 THEN 'skill_duplicate:low' END, CASE WHEN k % 6 = 2 THEN 'skill_unknown:low' END",
    ),
}
_BUILDERS = {
    "phone": N.phone, "email": N.email, "name": N.name, "city": N.city, "date": N.applied_date, "ctc": N.ctc, "rate": N.rate, "status": N.status, "verified": N.verified,
    "integer": lambda c: N.integer(c, "n"), "real": lambda c: N.real(c, "x"), "skills": N.skills,
}
_RAW = {"integer": "raw_int", "real": "raw_real"}


def _sql(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...], deal: bool = False) -> DataFrame:
    """`deal`: rows are dealt out before the columns are made of them, for costly ones."""
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (dealt(df) if deal else df).createOrReplaceTempView(f"kinloom_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM kinloom_{t}").replace(f"JOIN {t}", f"JOIN kinloom_{t}")
    made = spark.sql(sql)
    for t in tables:  # the views are in the plan by now
        spark.catalog.dropTempView(f"kinloom_{t}")
    return made


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MESSY, ("customer",), deal=True)


def _normaliser(field: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _messy(spark, sf_dir).select("k", _BUILDERS[field](F.col(_RAW.get(field, f"raw_{field}"))).alias("r"))
        value = F.col("r.value")
        if field == "skills":
            value = F.array_join(F.transform(value, lambda s: F.concat(s["canonical_name"], F.lit("/"), s["match_key"])), "|")
        elif field in ("rate", "real"):
            value = F.round(value * 100).cast("long").cast("string")
        issues = F.array_join(F.transform("r.issues", lambda i: F.concat(i["issue_type"], F.lit(":"), i["severity"])), ",")
        return out.select("k", value.cast("string").alias("value"), issues.alias("issues"))

    return query


def _normaliser_sql(field: str) -> str:
    value, issues = _RULES[field]
    return f"WITH messy AS ({MESSY}) SELECT k, {value} AS value, concat_ws(',', {issues}) AS issues FROM messy"


# --- the issue log of all normalisers over MESSY ---

def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue a row."""
    each = [F.struct(F.lit(f).alias("column_name"), b(F.col(_RAW.get(f, f"raw_{f}")))["issues"].alias("issues")) for f, b in _BUILDERS.items()]
    fields = _messy(spark, sf_dir).select("k", F.explode(F.array(*each)).alias("f"))
    return fields.select("k", "f.column_name", F.explode("f.issues").alias("i")).select("k", "column_name", "i.issue_type", "i.severity")


_LOG = "WITH messy AS (" + MESSY + "), log AS (" + " UNION ALL ".join(f"SELECT k, '{f}' AS column_name, split_part(x, ':', 1) AS issue_type, split_part(x, ':', 2) AS severity FROM (SELECT k, unnest(string_split(concat_ws(',', {i}), ',')) AS x FROM messy) WHERE x <> ''" for f,
    (_, i) in _RULES.items()) + ") "


def _log_as_issues(spark, sf_dir) -> DataFrame:
    return issue_log(spark, sf_dir).select(F.lit("customer").alias("source_file"), F.col("k").cast("int").alias("source_row"), "column_name",
        "issue_type", "severity", F.lit(None).cast("string").alias("raw_value"), F.lit("").alias("action_taken"))


def issue_counts(spark, sf_dir):
    return report.by_type(_log_as_issues(spark, sf_dir))


def issue_topk(spark, sf_dir):
    return report.examples(_log_as_issues(spark, sf_dir)).select("issue_type", "rank", "place")


def severity_pivot(spark, sf_dir):
    return report.by_severity(_log_as_issues(spark, sf_dir))


def issue_severity_sort(spark, sf_dir):
    """A7 with the place that each row has in the order."""
    from kinloom.operators.ranking import numbered

    log = issue_log(spark, sf_dir).withColumn("o", F.struct(report.severity_rank(F.col("severity")).alias("s"), "issue_type", "k", "column_name"))
    return numbered(log, "o", "place").select("k", "column_name", "issue_type", "severity", "place")


# --- structural cleaning of rows rendered from customer ---

_CELLS = """
SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 9 AND c_custkey % 20 = 19 THEN c_custkey - 1 ELSE c_custkey END AS d FROM customer
"""


def _raw_cells(spark, sf_dir) -> DataFrame:
    d, kind = F.col("d").cast("string"), F.col("k") % 10
    cells = [F.concat(F.lit("Name "), d), F.concat(F.lit("m"), d, F.lit("@ex.org")), F.concat(F.lit("p"), d), F.lit("Pune"), F.lit("2"), F.lit("5"),
        F.lit("2026-01-01"), F.lit("sql")]
    head = F.array(*map(F.lit, APPLICANTS.header))
    rotated = [cells[-1], *cells[:-1]]
    upper = [F.upper(c) for c in cells]
    made = (
        F.when(kind == 0, F.array(*[F.lit(" ")] * 8)).when(kind == 1, F.transform(head, lambda h: F.concat(F.lit(" "), F.upper(h)))).when(kind == 2,
            F.array(*rotated)).when(kind == 3, F.array(*cells[:1], *cells[2:], F.lit("x")))
        .when(kind == 4, F.array(*cells[:5])).when(kind == 5,
            F.array(*cells, F.lit("more"), F.lit("yet"))).when((kind == 9) & (F.col("k") % 20 == 19), F.array(*upper)).otherwise(F.array(*cells))
    )
    return _sql(spark, sf_dir, _CELLS, ("customer",)).select(F.lit(APPLICANTS.name).alias("source_file"),
        (F.col("k") + 2).cast("int").alias("source_row"), made.alias("cells"))


def clean_rows(spark, sf_dir):
    """What is left, with repaired and padded columns."""
    rows, _ = structural.clean_source(_raw_cells(spark, sf_dir), APPLICANTS)
    return rows.select("source_row", F.col("data")["Full Name"].alias("full_name"), F.col("data")["Email"].alias("email"), F.col("data")["Current CTC"].alias("ctc"))


_CLEAN_SQL = f"""WITH c AS ({_CELLS}) SELECT CAST(k + 2 AS INTEGER) AS source_row, concat('Name ', d) AS full_name, concat('m', d, '@ex.org') AS email,
CASE WHEN k % 10 = 4 THEN NULL ELSE '5' END AS ctc FROM c WHERE k % 10 NOT IN (0, 1, 3) AND NOT (k % 20 = 19)"""


def structural_issues(spark, sf_dir):
    """What was found."""
    _, issues = structural.clean_source(_raw_cells(spark, sf_dir), APPLICANTS)
    return issues.select("source_row", "issue_type", "severity")


_STRUCT_SQL = f"""WITH c AS ({_CELLS}), i AS (SELECT k, unnest(CASE k % 10 WHEN 0 THEN ['blank_row:medium'] WHEN 1 THEN ['repeated_header:high'] WHEN 2 THEN ['column_shift:high'] WHEN 3 THEN ['column_shift_unrepairable:high']
WHEN 4 THEN ['column_count_mismatch:high'] WHEN 5 THEN ['column_count_mismatch:high', 'extra_fields:medium'] ELSE [] END || CASE WHEN k % 20 = 19 THEN ['duplicate_row_in_source:high'] ELSE [] END) AS x FROM c)
SELECT CAST(k + 2 AS INTEGER) AS source_row, split_part(x, ':', 1) AS issue_type, split_part(x, ':', 2) AS severity FROM i"""


def dup_first_wins(spark, sf_dir):
    """C6 on orders: the first order of each customer and day."""
    o = _table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return structural.first_wins(o, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority")


# --- three sources of people with known truth ---

#: k: record, p: person, r: source (0 applicants, 1 gig workers, 2 contacts), t: what befalls the person; applicants
#: that would bridge the other two where they shall not meet are people of their own (t = 8).
_TRUTH = f"""
SELECT k, p, r, t, base, concat('Asha N', {_ABC.format('base')}) AS full_name, concat('asha n', {_ABC.format('base')}) AS name_key,
  CASE WHEN t = 1 AND r = 1 THEN 'Noida' WHEN base % 3 = 0 THEN 'Pune' WHEN base % 3 = 1 THEN 'Gurugram' ELSE 'Bengaluru' END AS city,
  CASE WHEN r = 2 THEN NULL WHEN t IN (1, 5) AND r = 1 THEN concat('alt.u', CAST(p AS STRING), '@ex.org') ELSE concat('u', CAST(p AS STRING), '@ex.org') END AS email,
  CASE WHEN r = 1 THEN NULL WHEN t = 1 AND r = 2 THEN concat('+91', {_CORE.format('(p + 500000)')}) ELSE concat('+91', {_CORE.format('p')}) END AS phone,
  CASE WHEN r = 2 THEN '' WHEN t = 7 AND p % 16 >= 8 THEN 'react' WHEN t IN (6, 7) THEN 'docker,sql' ELSE 'python,sql' END AS skill_keys
FROM (SELECT k, CASE WHEN lone THEN 1000000 + p ELSE p END AS p, r, CASE WHEN lone THEN 8 ELSE t END AS t,
  CASE WHEN lone THEN 1000000 + p WHEN t IN (4, 7) THEN p - 1 ELSE p END AS base FROM
  (SELECT k, p, r, p % 8 AS t, r = 0 AND p % 8 IN (2, 3, 4, 6) AS lone FROM
    (SELECT c_custkey AS k, CAST(floor(c_custkey / 3) AS BIGINT) AS p, c_custkey % 3 AS r FROM customer) AS c) AS a) AS b
"""
_RECORDS_RAW = f"""
SELECT r, CAST(k + 2 AS INT) AS source_row,
  CASE WHEN r = 2 THEN upper(full_name) WHEN k % 5 = 0 THEN concat(' ', full_name, '  ') ELSE full_name END AS raw_name,
  CASE WHEN k % 4 = 1 THEN upper(email) ELSE email END AS raw_email,
  CASE k % 5 WHEN 0 THEN phone WHEN 1 THEN substr(phone, 4, 10) WHEN 2 THEN concat('0', substr(phone, 4, 10)) WHEN 3 THEN concat('+91-', substr(phone, 4, 10)) ELSE substr(phone, 2, 12) END AS raw_phone,
  CASE WHEN city = 'Gurugram' AND k % 2 = 0 THEN 'GURGAON' WHEN city = 'Bengaluru' AND k % 2 = 1 THEN 'bangalore ' ELSE city END AS raw_city,
  CAST(1 + p % 20 AS STRING) AS raw_years, CAST(300000 + p AS STRING) AS raw_ctc, '2026-07-01' AS raw_date, concat(CAST(100 + p % 900 AS STRING), '/hr') AS raw_rate,
  CASE WHEN p % 2 = 0 THEN 'Active' ELSE 'paused' END AS raw_status, CASE WHEN p % 2 = 0 THEN 'Y' ELSE 'no' END AS raw_verified, CAST(p % 7 AS STRING) AS raw_projects, skill_keys AS raw_skills
FROM ({_TRUTH}) AS truth
"""
_RECORD_ID = "(r * 1099511627776 + k + 2)"
#: Truth with record ids and the clusters after tiers 1 and 2, found by recursion over the stars.
_GRAPH = f"""
WITH RECURSIVE truth AS ({_TRUTH}), rec AS (SELECT *, {_RECORD_ID} AS rid FROM truth),
e1 AS (SELECT min(rid) OVER (PARTITION BY email) AS src, rid AS dst, email AS value FROM rec WHERE email IS NOT NULL),
e2 AS (SELECT min(rid) OVER (PARTITION BY phone) AS src, rid AS dst, phone AS value FROM rec WHERE phone IS NOT NULL),
links AS (SELECT src, dst FROM e1 WHERE src < dst UNION SELECT src, dst FROM e2 WHERE src < dst),
both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
reach(a, b) AS (SELECT rid, rid FROM rec UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON r.b = e.src),
c2 AS (SELECT a AS rid, min(b) AS cluster FROM reach GROUP BY a),
cl AS (SELECT cluster, min(name_key) AS name_key, min(city) AS city, count(email) > 0 AS has_email, count(phone) > 0 AS has_phone,
  (SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM (SELECT unnest(string_split(string_agg(skill_keys, ','), ',')) AS s) WHERE s <> '') AS sig FROM rec JOIN c2 USING (rid) GROUP BY cluster),
keys AS (SELECT name_key, city, count(*) AS n, count(*) FILTER (has_email AND NOT has_phone) AS n_email, count(*) FILTER (has_phone AND NOT has_email) AS n_phone, count(*) FILTER (has_phone AND has_email) AS n_both,
  min(cluster) FILTER (has_email AND NOT has_phone) AS e, min(cluster) FILTER (has_phone AND NOT has_email) AS p, min(sig) FILTER (has_email AND NOT has_phone) AS e_sig,
  list(sig) FILTER (has_phone AND has_email) AS sigs FROM cl GROUP BY name_key, city HAVING count(*) >= 2),
verdicts AS (SELECT *, CASE WHEN n_email <> 1 OR n_phone <> 1 THEN 'ambiguous' WHEN list_contains(sigs, e_sig) THEN 'claimed' ELSE 'join' END AS verdict FROM keys),
fin AS (SELECT c2.rid, coalesce(least(v.e, v.p), c2.cluster) AS person, c2.cluster FROM c2 LEFT JOIN verdicts v ON v.verdict = 'join' AND c2.cluster IN (v.e, v.p)),
ids AS (SELECT rid, cluster, person, dense_rank() OVER (ORDER BY person) AS person_id FROM fin),
reasons AS (SELECT x.rid, 'tier1: same email ' || value AS reason FROM (SELECT src, dst, value FROM e1 WHERE src < dst) q, LATERAL (SELECT unnest([q.src, q.dst]) AS rid) x
  UNION SELECT x.rid, 'tier2: same phone ' || value FROM (SELECT src, dst, value FROM e2 WHERE src < dst) q, LATERAL (SELECT unnest([q.src, q.dst]) AS rid) x
  UNION SELECT x.rid, 'tier3: same name+city "' || name_key || ' / ' || city || '" (no shared identifier)' FROM (SELECT * FROM verdicts WHERE verdict = 'join') q, LATERAL (SELECT unnest([q.e, q.p]) AS rid) x),
people AS (SELECT person_id, count(DISTINCT i.rid) AS size, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS why FROM ids i LEFT JOIN reasons USING (rid) GROUP BY person_id),
named AS (SELECT person_id, size, CASE WHEN size = 1 THEN 'single-source' WHEN why LIKE '%tier1%' OR why LIKE '%tier2%' THEN 'high' ELSE 'medium' END AS match_confidence, coalesce(why, 'only appears in one source') AS match_reason FROM people)
"""


def _source_rows(spark, sf_dir) -> dict[str, DataFrame]:
    raw = _sql(spark, sf_dir, _RECORDS_RAW, ("customer",), deal=True)
    columns = {
        APPLICANTS: ("raw_name", "raw_email", "raw_phone", "raw_city", "raw_years", "raw_ctc", "raw_date", "raw_skills"),
        GIG_WORKERS: ("raw_email", "raw_name", "raw_rate", "raw_city", "raw_status", "raw_skills"),
            CONTACTS: ("raw_name", "raw_phone", "raw_city", "raw_verified", "raw_projects"),
    }
    return {
        s.name: raw.where(F.col("r") == i).select(F.lit(s.name).alias("source_file"), "source_row",
            F.map_from_arrays(F.array(*map(F.lit, s.header)), F.array(*cols)).alias("data"))
        for i, (s, cols) in enumerate(columns.items())
    }


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of customer: what is kept for them does not outlive them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/customer.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [path] if fs.getFileStatus(path).isFile() else [f.getPath() for f in fs.listStatus(path)]
    return tuple((str(f), (x := fs.getFileStatus(f)).getLen(), x.getModificationTime()) for f in listed)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged records, written to the shared folder once for all queries of a session."""
    return _staged(spark, sf_dir, _files(spark, sf_dir))


@lru_cache(maxsize=1)
def _staged(spark: SparkSession, sf_dir: str, files: tuple) -> DataFrame:
    return written(stage_all(_source_rows(spark, sf_dir)), "staged")


def union_staged(spark, sf_dir):
    """Three sources in one shape."""
    return staged(spark, sf_dir).select("record_id", F.col("name").alias("full_name"), "name_key", "email", "phone", "city",
        F.array_join(F.transform("skills", lambda s: s["match_key"]), ",").alias("skill_keys"))


def _merge(spark: SparkSession, sf_dir: str) -> merge.Merged:
    """The merge, written to the shared folder once for all queries of a session."""
    return _merged(spark, sf_dir, _files(spark, sf_dir))


@lru_cache(maxsize=1)
def _merged(spark: SparkSession, sf_dir: str, files: tuple) -> merge.Merged:
    return merge.merge_staged(staged(spark, sf_dir))


def tier1_edges(spark, sf_dir):
    return resolve.star_edges(staged(spark, sf_dir), "email")


def tier2_edges(spark, sf_dir):
    return resolve.star_edges(staged(spark, sf_dir), "phone")


def components(spark, sf_dir):
    """M1 over the edges of both tiers."""
    records = staged(spark, sf_dir)
    edges = tier1_edges(spark, sf_dir).unionByName(tier2_edges(spark, sf_dir))
    with sorted_joins(spark):
        return resolve.labelled(records, connected_components(edges))


def person_ids(spark, sf_dir):
    return _merge(spark, sf_dir).resolution.members.select("record_id", "person_id")


def match_reasons(spark, sf_dir):
    return _merge(spark, sf_dir).resolution.clusters


def confidence_counts(spark, sf_dir):
    """The flagship: three messy sources to people, counted by confidence."""
    return report.by_confidence(_merge(spark, sf_dir).tables["people"])


def bridge_guards(spark, sf_dir):
    """M5 to M9."""
    records = staged(spark, sf_dir)
    keys = resolve.bridge_candidates(*resolve.describe(records, components(spark, sf_dir)))
    return keys.select("name_key", "city", "n", "n_email", "n_phone", "n_both", "verdict")


def near_miss(spark, sf_dir):
    return _merge(spark, sf_dir).review.where("reason = 'same_name_different_city'").select("name_city", "n")


def match_issues(spark, sf_dir):
    return _merge(spark, sf_dir).resolution.issues.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def golden_people(spark, sf_dir):
    """V2 to V8."""
    return _merge(spark, sf_dir).tables["people"].select("person_id", "full_name", "primary_email", "primary_phone", "city", "current_ctc_inr",
        "rate_raw", "gig_status", "is_verified", "projects_completed")


def golden_identifiers(spark, sf_dir):
    """V10."""
    return _merge(spark, sf_dir).tables["person_identifiers"]


def golden_skills(spark, sf_dir):
    """Links by key, as ids follow the order of appearance."""
    t = _merge(spark, sf_dir).tables
    return t["person_skills"].join(t["skills"], "skill_id").select("person_id", "match_key", "canonical_name")


def lineage(spark, sf_dir):
    """V12."""
    return _merge(spark, sf_dir).tables["person_sources"].select("person_id", "source_file", "source_row", F.get_json_object("raw_json", "$.City").alias("json_city"))


def constraint_violations(spark, sf_dir):
    return store.violations(_merge(spark, sf_dir).tables)


_FILE = "CASE r WHEN 0 THEN 'applicants.csv' WHEN 1 THEN 'gig_workers.csv' ELSE 'contacts.csv' END"
_PRIO = "CASE r WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"
_GOLDEN_SQL = {
    "golden_people": f"""{_GRAPH} SELECT person_id, min(full_name) AS full_name,
arg_min(email, (CASE WHEN email LIKE 'alt.%' THEN 1 ELSE 0 END) * 1000 + length(email)) FILTER (email IS NOT NULL) AS primary_email, min(phone) AS primary_phone, min(city) AS city,
min(CASE WHEN r = 0 THEN 300000 + p END) AS current_ctc_inr, min(CASE WHEN r = 1 THEN concat(CAST(100 + p % 900 AS VARCHAR), '/hr') END) AS rate_raw,
coalesce(min(CASE WHEN r = 1 THEN CASE WHEN p % 2 = 0 THEN 'active' ELSE 'paused' END END), 'unknown') AS gig_status, CAST(min(CASE WHEN r = 2 THEN 1 - p % 2 END) AS INTEGER) AS is_verified,
CAST(min(CASE WHEN r = 2 THEN p % 7 END) AS INTEGER) AS projects_completed FROM ids JOIN rec USING (rid) GROUP BY person_id""",
    "golden_identifiers": f"""{_GRAPH}, v AS (SELECT person_id, 'email' AS id_type, email AS value, r FROM ids JOIN rec USING (rid) WHERE email IS NOT NULL UNION ALL SELECT person_id, 'phone', phone, r FROM ids JOIN rec USING (rid) WHERE phone IS NOT NULL)
SELECT person_id, id_type, value, arg_min({_FILE}, {_PRIO}) AS source_file, CAST(1 AS INTEGER) AS is_primary FROM v GROUP BY person_id, id_type, value""",
    "golden_skills": f"""{_GRAPH} SELECT DISTINCT person_id, s AS match_key, CASE s WHEN 'sql' THEN 'SQL' WHEN 'docker' THEN 'Docker' WHEN 'react' THEN 'React' ELSE 'Python' END AS canonical_name
FROM (SELECT person_id, unnest(string_split(skill_keys, ',')) AS s FROM ids JOIN rec USING (rid)) WHERE s <> ''""",
    "lineage": f"""{_GRAPH} SELECT person_id, {_FILE} AS source_file, CAST(k + 2 AS INTEGER) AS source_row, CASE WHEN r = 1 THEN NULL WHEN city = 'Gurugram' AND k % 2 = 0 THEN 'GURGAON' WHEN city = 'Bengaluru' AND k % 2 = 1 THEN 'bangalore ' ELSE city END AS json_city
FROM ids JOIN rec USING (rid)""",
}


# --- submissions, tags, listings ---

_PEOPLE = "SELECT c_custkey AS person_id, c_name AS full_name, c_mktsegment AS city, CASE WHEN c_custkey % 4 = 0 THEN 'data' END AS skill_category FROM customer"


#: The person that an order names: of every third order one who is not among the customers.
_NAMED = "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 100000000 ELSE o_custkey END"


def _people(spark, sf_dir):
    return _sql(spark, sf_dir, _PEOPLE, ("customer",))


def submissions_left_join(spark, sf_dir):
    subs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"), F.expr(_NAMED).alias("person_id"))
    return linkage.list_submissions(subs, _people(spark, sf_dir).withColumn("match_confidence", F.lit("high"))).select("submission_id", "person_id",
        "matched_name", "city", "match_confidence")


_CALLED = _CORE.format(f"({_NAMED})")
_SUBS = f"SELECT o_orderkey AS submission_id, concat('worker ', CAST(o_custkey AS STRING)) AS name, CASE WHEN o_orderkey % 50 = 0 THEN 'none' WHEN o_orderkey % 2 = 0 THEN concat('0', {_CALLED}) ELSE concat('+91 ', {_CALLED}) END AS phone FROM orders"


def find_or_create(spark, sf_dir):
    ids = _sql(spark, sf_dir, f"SELECT c_custkey AS person_id, 'phone' AS id_type, concat('+91', {_CORE.format('c_custkey')}) AS value FROM customer", ("customer",))
    linked, _, _ = linkage.link_submissions(_sql(spark, sf_dir, _SUBS, ("orders",)), _people(spark, sf_dir), ids)
    return linked.select("submission_id", "normalised_phone", "person_id", "created")


_FIND_SQL = f"""WITH s AS (SELECT o_orderkey AS submission_id, o_custkey AS c, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('+91', {_CALLED}) END AS ph FROM orders),
known AS (SELECT concat('+91', {_CORE.format('c_custkey')}) AS ph, min(c_custkey) AS id FROM customer GROUP BY 1),
f AS (SELECT s.*, known.id, coalesce(s.ph, 'x' || submission_id) AS key FROM s LEFT JOIN known USING (ph)),
n AS (SELECT key, min(submission_id) AS first, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY min(submission_id)) AS new_id FROM f WHERE id IS NULL GROUP BY key)
SELECT submission_id, ph AS normalised_phone, coalesce(id, new_id) AS person_id, id IS NULL AND submission_id = first AS created FROM f LEFT JOIN n USING (key)"""


def _skill_links(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT DISTINCT o_custkey AS person_id, l_suppkey % 10 AS skill_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
        ("orders", "lineitem"))


def _skill_table(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("skill_id"), F.col("s_name").alias("canonical_name"))


_SKILL_SQL = """WITH people AS (SELECT c_custkey AS person_id, c_name AS full_name, c_mktsegment AS city, CASE WHEN c_custkey % 4 = 0 THEN 'data' END AS skill_category FROM customer),
ps AS (SELECT DISTINCT o_custkey AS person_id, l_suppkey % 10 AS skill_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
s AS (SELECT person_id, coalesce(string_agg(s_name, ', ' ORDER BY skill_id), '') AS skills FROM people LEFT JOIN ps USING (person_id) LEFT JOIN supplier ON s_suppkey = skill_id GROUP BY person_id)
SELECT person_id, full_name, city, skill_category, skills FROM people JOIN s USING (person_id)"""


def people_skills_agg(spark, sf_dir):
    return linkage.list_people(_people(spark, sf_dir), _skill_links(spark, sf_dir), _skill_table(spark, sf_dir), limit=-1)


def untagged_people(spark, sf_dir):
    """The feature is a page of at most 100."""
    return linkage.list_people(_people(spark, sf_dir), _skill_links(spark, sf_dir), _skill_table(spark, sf_dir), untagged=True)


_UPDATES = "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN user_id + 100000000 ELSE user_id END AS person_id, CASE event_id % 7 WHEN 0 THEN 'web-dev' WHEN 1 THEN ' data ' WHEN 2 THEN 'Backend' WHEN 3 THEN 'backend' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'qa-automation' END AS skill_category FROM events"
_OUTCOMES_SQL = f"""u AS ({_UPDATES}), out AS (SELECT event_id, person_id, trim(coalesce(u.skill_category, '')) AS skill_category,
CASE WHEN trim(coalesce(u.skill_category, '')) NOT IN ('automation-heavy', 'web-dev', 'data', 'qa-automation', 'backend') THEN 'invalid' WHEN full_name IS NULL THEN 'missing' ELSE 'updated' END AS outcome FROM u LEFT JOIN people USING (person_id))"""


def tag_outcome(spark, sf_dir):
    out = linkage.tag_outcomes(_sql(spark, sf_dir, _UPDATES, ("events",)), _people(spark, sf_dir))
    return out.groupBy("person_id", "skill_category", "outcome").agg(F.count("*").alias("n"))


def tag_update(spark, sf_dir):
    """Of several updates of a person the greatest category."""
    people = _people(spark, sf_dir)
    return linkage.apply_tags(people, linkage.tag_outcomes(_sql(spark, sf_dir, _UPDATES, ("events",)), people)).select("person_id", "full_name", "city", "skill_category")


def reply_sanitise(spark, sf_dir):
    """L5 on whole conversation turns with a category worked in."""
    mixed = F.concat(F.element_at(F.array(*map(F.lit, ("I say: BACKEND.", "database!", "qa-automation, surely", "", "it is web-dev and data"))),
        ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", linkage.sanitise_reply(mixed).alias("category"))


_REPLY_SQL = """WITH m AS (SELECT conv_id, turn, lower(concat(CASE (conv_id + turn) % 5 WHEN 0 THEN 'I say: BACKEND.' WHEN 1 THEN 'database!' WHEN 2 THEN 'qa-automation, surely' WHEN 3 THEN '' ELSE 'it is web-dev and data' END, ' ', coalesce(text, ''))) AS x FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(x, '[^a-z-]', ' ', 'g') AS x FROM m), w AS (SELECT *, string_split_regex(trim(x), '\\s+') AS t FROM c)
SELECT conv_id, turn, CASE WHEN list_contains(t, 'automation-heavy') THEN 'automation-heavy' WHEN list_contains(t, 'web-dev') THEN 'web-dev' WHEN list_contains(t, 'data') THEN 'data' WHEN list_contains(t, 'qa-automation') THEN 'qa-automation' WHEN list_contains(t, 'backend') THEN 'backend'
WHEN contains(x, 'automation-heavy') THEN 'automation-heavy' WHEN contains(x, 'web-dev') THEN 'web-dev' WHEN contains(x, 'data') THEN 'data' WHEN contains(x, 'qa-automation') THEN 'qa-automation' WHEN contains(x, 'backend') THEN 'backend' END AS category FROM w"""


def stats_row(spark, sf_dir):
    return linkage.stats(_people(spark, sf_dir), _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "events"))


def summary_text(spark, sf_dir):
    return linkage.summary_text(stats_row(spark, sf_dir)).select("text")


_STATS_SQL = "(SELECT count(*) AS people, count(CASE WHEN c_custkey % 4 = 0 THEN 1 END) AS tagged FROM customer), (SELECT count(*) AS submissions FROM orders), (SELECT count(*) AS issues FROM events)"


def upload_checks(spark, sf_dir):
    """P7."""
    raw = _sql(spark, sf_dir, _UPLOADS, ("events",))
    return raw.select("event_id", linkage.reject_reason(F.col("mime"), F.col("size"), F.col("name"), F.col("phone")).alias("reason"))


_UPLOADS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'video/webm' WHEN 2 THEN 'image/png' WHEN 3 THEN NULL ELSE 'audio/flac' END AS mime, CAST(event_id % 31 * 1000000 AS BIGINT) AS size, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'Asha' END AS name, CASE WHEN event_id % 13 = 0 THEN NULL ELSE '1' END AS phone FROM events"


_SHOWN = f"""SELECT o_orderkey AS submission_id, {_NAMED} AS person_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 44100 ELSE 16000 END AS sample_rate_hz, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 80) / 2.0 END AS snr_db,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3000 * 100 END AS size_bytes, CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'poor (clipped)' WHEN 2 THEN 'unknown (x)' WHEN 3 THEN NULL ELSE 'fair' END AS quality_label FROM orders"""


def submissions_display(spark, sf_dir):
    """P10."""
    subs = _sql(spark, sf_dir, _SHOWN, ("orders",))
    return linkage.display_submissions(linkage.list_submissions(subs, _people(spark, sf_dir).withColumn("match_confidence", F.lit("high"))))


_DISPLAY_SQL = f"""WITH s AS ({_SHOWN}), people AS ({_PEOPLE}) SELECT submission_id, CASE WHEN full_name IS NULL THEN 'unlinked' ELSE full_name || ' #' || s.person_id END AS person,
CASE sample_rate_hz WHEN 44100 THEN '44.1 kHz' WHEN 16000 THEN '16 kHz' ELSE '—' END AS rate, CASE WHEN snr_db IS NULL THEN '—' WHEN snr_db = floor(snr_db) THEN CAST(CAST(snr_db AS BIGINT) AS VARCHAR) ELSE CAST(CAST(snr_db AS DECIMAL(9, 1)) AS VARCHAR) END AS snr,
CASE WHEN coalesce(size_bytes, 0) = 0 THEN '—' ELSE CAST(CAST(floor(size_bytes / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' END AS size,
CASE WHEN quality_label LIKE 'good%' THEN 'good' WHEN quality_label LIKE 'poor%' THEN 'poor' WHEN quality_label LIKE 'unknown%' THEN 'unk' ELSE 'fair' END AS pill FROM s LEFT JOIN people USING (person_id)"""


#: People and identifiers that break their constraints: shared addresses, unknown states, kinds and people.
_BROKEN = {
    "people": """SELECT c_custkey AS person_id, concat('u', CAST(CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS STRING), '@ex.org') AS primary_email,
CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 1000 AS STRING) END AS primary_phone, CASE WHEN c_custkey % 11 = 0 THEN 'gone' WHEN c_custkey % 2 = 0 THEN 'active' END AS gig_status,
c_custkey % 3 AS is_verified, CASE WHEN c_custkey % 5 = 0 THEN 'low' ELSE 'high' END AS match_confidence FROM customer""",
    "person_identifiers": f"""SELECT {_NAMED} AS person_id, CASE WHEN o_orderkey % 13 = 0 THEN 'fax' ELSE 'phone' END AS id_type,
CAST(CASE WHEN o_orderkey % 17 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS value FROM orders""",
}


def planted_violations(spark, sf_dir):
    """D2 and the constraints on tables that break them."""
    return store.violations({"people": _sql(spark, sf_dir, _BROKEN["people"], ("customer",)),
        "person_identifiers": _sql(spark, sf_dir, _BROKEN["person_identifiers"], ("orders",))})


def _broken_sql() -> str:
    def row(kind: str, table: str, key: str, rows: str) -> str:
        return f"SELECT '{kind}' AS kind, '{table}' AS table_name, '{key}' AS key, count(*) AS n FROM {rows}"

    def twice(table: str, keys: str) -> str:
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(","))
        return f"(SELECT {keys} FROM {table} WHERE {known} GROUP BY {keys} HAVING count(*) > 1)"

    rows = [
        row("check", "people", "gig_status", "people WHERE gig_status NOT IN ('active', 'inactive', 'paused', 'unknown')"),
            row("check", "people", "is_verified", "people WHERE is_verified NOT IN (0, 1)"),
        row("check", "people", "match_confidence", "people WHERE match_confidence NOT IN ('high', 'medium', 'single-source')"),
            row("check", "person_identifiers", "id_type", "ids WHERE id_type NOT IN ('email', 'phone')"),
        *[row("unique", "people", k, twice("people", k)) for k in ("person_id", "primary_email", "primary_phone")],
            row("unique", "person_identifiers", "id_type,value", twice("ids", "id_type,value")),
        row("foreign", "person_identifiers", "person_id", "ids WHERE person_id NOT IN (SELECT c_custkey FROM customer)"),
    ]
    return f"WITH people AS ({_BROKEN['people']}), ids AS ({_BROKEN['person_identifiers']}) " + " UNION ALL ".join(rows)


def unique_violations(spark, sf_dir):
    return store.repeated_keys(_table(spark, sf_dir, "orders"), ("o_custkey", "o_orderpriority"))


def foreign_orphans(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NAMED).alias("named"))
    return store.orphans(orders, "named", _people(spark, sf_dir), "person_id")


def check_violations(spark, sf_dir):
    return store.out_of_range(_table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O")).select("o_orderkey", "o_orderstatus")


# --- signals ---

def sample_measures(spark, sf_dir):
    """Vectors as samples, in frames of eight."""
    m = _table(spark, sf_dir, "embeddings").select("vec_id", audio.sample_measures(F.col("embedding"), 8).alias("m")).select("vec_id", "m.*")
    return m.select("vec_id", *[F.round(c, 4).alias(c) for c in m.columns[1:]])


_SAMPLES_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
f AS (SELECT vec_id, x, len(x) // 8 AS n, list_sort(list_transform(range(len(x) // 8), lambda i: greatest(-120.0, 20 * log10(sqrt(list_sum(list_transform(x[i * 8 + 1 : i * 8 + 8], lambda v: v * v)) / 8))))) AS l FROM e)
SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))), 4) AS rms_db, round(20 * log10(list_max(list_transform(x, lambda v: abs(v)))), 4) AS peak_db, round(100.0 * len(list_filter(x, lambda v: abs(v) >= 0.99)) / len(x), 4) AS clip_pct,
CASE WHEN n >= 5 THEN round(l[least(n - 1, CAST(floor(0.1 * n) AS BIGINT)) + 1], 4) END AS noise_db, CASE WHEN n >= 5 THEN round(l[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] - l[least(n - 1, CAST(floor(0.1 * n) AS BIGINT)) + 1], 4) END AS snr_db FROM f"""


def quality_labels(spark, sf_dir):
    """G9."""
    m = _sql(spark, sf_dir, _LEVELS, ("lineitem",))
    return m.select("l_orderkey", "l_linenumber", audio.quality_label(F.col("snr"), F.col("clip"), F.col("loud")).alias("label"))


_LEVELS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN NULL ELSE l_quantity - 2 END AS snr, l_discount * 20 AS clip, -l_tax * 700 AS loud FROM lineitem"
_LABEL_SQL = f"""WITH m AS ({_LEVELS}), r AS (SELECT *, concat_ws(', ', CASE WHEN clip > 1 THEN 'clipped' END, CASE WHEN loud < -45 THEN 'very quiet' END) AS w, concat_ws(', ', CASE WHEN clip > 1 THEN 'clipped' END, CASE WHEN loud < -45 THEN 'very quiet' END, CASE WHEN snr < 10 THEN 'noisy' END) AS a FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN snr IS NULL OR snr < 3 THEN CASE WHEN w <> '' THEN concat('poor (', w, ')') ELSE 'unknown (SNR not measurable - continuous audio with no pauses)' END WHEN a = '' THEN CASE WHEN snr >= 25 THEN 'good' ELSE 'fair' END
WHEN NOT contains(a, ', ') THEN concat('fair (', a, ')') ELSE concat('poor (', a, ')') END AS label FROM r"""


def price_ranks(spark, sf_dir):
    """A13 over rows: the tenth, half and nine tenths of prices by return flag, of which one has half of all rows."""
    return quantile.nearest_ranks(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", (0.1, 0.5, 0.9))


_RANKS_SQL = """
WITH s AS (
  SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS value, count(*) OVER (PARTITION BY l_returnflag) AS n,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS place
  FROM lineitem WHERE l_extendedprice IS NOT NULL
)
SELECT l_returnflag, share, n, value FROM s, (VALUES (0.1), (0.5), (0.9)) AS p (share)
WHERE place = least(n - 1, CAST(floor(CAST(share AS DOUBLE) * n) AS BIGINT))"""


#: Events as samples, 3,000 to a recording.
_TAKE, _TAKE_FRAME = 3000, 20


def _takes(spark, sf_dir):
    place = F.col("event_id")
    return _table(spark, sf_dir, "events").select(F.floor(place / _TAKE).alias("take"), (place % _TAKE).alias("i"), (F.col("value") / 50 - 1).alias("v"))


def take_measures(spark, sf_dir):
    """G3 to G7 over rows of samples."""
    m = samples.measures(_takes(spark, sf_dir), "take", "i", "v", _TAKE_FRAME)
    return m.select("recording", "samples", "frames", *[F.round(c, 4).alias(c) for c in ("rms_db", "peak_db", "clip_pct", "noise_db", "snr_db")])


def _db_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN greatest(-120.0, 20 * log10({x})) ELSE -120.0 END"


_TAKES_SQL = f"""
WITH v AS (SELECT event_id // {_TAKE} AS recording, event_id % {_TAKE} AS i, value / 50 - 1 AS v FROM events WHERE value IS NOT NULL),
f AS (SELECT recording, i // {_TAKE_FRAME} AS frame, {_db_sql("sqrt(sum(v * v) / count(*))")} AS level FROM v GROUP BY ALL HAVING count(*) = {_TAKE_FRAME}),
l AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY level) - 1 AS place, count(*) OVER (PARTITION BY recording) AS n FROM f),
r AS (
  SELECT recording, max(level) FILTER (place = least(n - 1, n // 10)) AS noise, max(level) FILTER (place = least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT))) AS signal
  FROM l WHERE n >= 5 GROUP BY recording
),
c AS (SELECT recording, count(*) AS frames FROM f GROUP BY recording),
t AS (
  SELECT recording, count(*) AS samples, {_db_sql("sqrt(sum(v * v) / count(*))")} AS rms, {_db_sql("max(abs(v))")} AS peak, 100.0 * count(*) FILTER (abs(v) >= 0.99) / count(*) AS clip
  FROM v GROUP BY recording
)
SELECT recording, samples, coalesce(frames, 0) AS frames, round(rms, 4) AS rms_db, round(peak, 4) AS peak_db, round(clip, 4) AS clip_pct,
  round(noise, 4) AS noise_db, round(signal - noise, 4) AS snr_db
FROM t LEFT JOIN c USING (recording) LEFT JOIN r USING (recording)"""


def event_loudness(spark, sf_dir):
    """G8 over rows of samples: events at 8 kHz, 20,000 to a recording. No SQL: the filter is recursive."""
    place, size = F.col("event_id"), 20_000
    takes = _table(spark, sf_dir, "events").select(F.floor(place / size).alias("take"), F.lit(0).alias("c"), (place % size).alias("i"), (F.col("value") / 50 - 1).alias("v"))
    return samples.loudness(takes, "take", "c", "i", "v", 8000)


#: Customers are linked to the first who got the same part shipped on the same day.
_PARTNERS = """k AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, CAST(l_shipdate AS DATE) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
f AS (SELECT p, d, min(c) AS src FROM k GROUP BY p, d), e AS (SELECT DISTINCT src, c AS dst FROM k JOIN f USING (p, d) WHERE c > src)"""


def customer_components(spark, sf_dir):
    """M1 at length: components of customers who share part and day of a shipment, over all lines."""
    edges = _sql(spark, sf_dir, f"WITH {_PARTNERS} SELECT src, dst FROM e", ("orders", "lineitem"))
    with sorted_joins(spark):
        parts = connected_components(edges)
    return parts.groupBy("component").agg(F.count("*").alias("customers"))


_COMPONENT_SQL = f"""WITH RECURSIVE {_PARTNERS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach(a, b) AS (SELECT src, src FROM b UNION SELECT r.a, b.dst FROM reach r JOIN b ON r.b = b.src), c AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT component, count(*) AS customers FROM c GROUP BY component"""


def queries() -> dict:
    own = {f"{f}_normalize": _normaliser(f) for f in _BUILDERS}
    for f in (
        confidence_counts, issue_log, issue_counts, issue_topk, severity_pivot, issue_severity_sort, clean_rows, structural_issues, dup_first_wins,
            union_staged, tier1_edges, tier2_edges, components,
        person_ids, match_reasons, bridge_guards, near_miss, match_issues, golden_people, golden_identifiers, golden_skills, lineage,
            constraint_violations, planted_violations, submissions_left_join, find_or_create,
        people_skills_agg, untagged_people, tag_outcome, tag_update, reply_sanitise, stats_row, summary_text, upload_checks, submissions_display,
            unique_violations, foreign_orphans, check_violations, sample_measures,
        quality_labels, customer_components, price_ranks, take_measures, event_loudness,
    ):
        own[f.__name__] = f
    return own


def oracle_sql() -> dict[str, str]:
    rank = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
    return {f"{f}_normalize": _normaliser_sql(f) for f in _RULES} | _GOLDEN_SQL | {
        "issue_log": _LOG + "SELECT * FROM log",
        "issue_counts": _LOG + "SELECT issue_type, severity, count(*) AS n FROM log GROUP BY ALL",
        "issue_topk": _LOG + "SELECT issue_type, CAST(rank AS INTEGER) AS rank, concat('customer:', CAST(k AS VARCHAR), ' · ', column_name) AS place FROM (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY k, column_name) AS rank FROM log) WHERE rank <= 3",
        "severity_pivot": _LOG + "SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM log",
        "issue_severity_sort": _LOG + f"SELECT k, column_name, issue_type, severity, row_number() OVER (ORDER BY {rank}, issue_type, k, column_name) AS place FROM log",
        "clean_rows": _CLEAN_SQL, "structural_issues": _STRUCT_SQL,
        "dup_first_wins": "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority",
        "union_staged": f"WITH truth AS ({_TRUTH}) SELECT {_RECORD_ID} AS record_id, full_name, name_key, email, phone, city, skill_keys FROM truth",
        "tier1_edges": _GRAPH + "SELECT src, dst, value FROM e1 WHERE src < dst",
        "tier2_edges": _GRAPH + "SELECT src, dst, value FROM e2 WHERE src < dst",
        "components": _GRAPH + "SELECT rid AS record_id, cluster FROM c2",
        "person_ids": _GRAPH + "SELECT rid AS record_id, person_id FROM ids",
        "match_reasons": _GRAPH + "SELECT * FROM named",
        "confidence_counts": _GRAPH + "SELECT match_confidence, count(*) AS n FROM named GROUP BY match_confidence",
        "bridge_guards": _GRAPH + "SELECT name_key, city, n, n_email, n_phone, n_both, verdict FROM verdicts",
        "near_miss": _GRAPH + "SELECT name_key || ' / ' || string_agg(city, ' vs ' ORDER BY f) AS name_city, CAST(sum(n) AS BIGINT) AS n FROM (SELECT name_key, city, min(cl.cluster) AS f, count(*) AS n FROM cl GROUP BY name_key, city) GROUP BY name_key HAVING count(*) >= 2",
        "match_issues": _GRAPH + """SELECT issue_type, severity, count(*) AS n FROM (SELECT 'ambiguous_name_match' AS issue_type, 'high' AS severity FROM verdicts WHERE verdict <> 'join' UNION ALL SELECT 'matched_on_name_and_city', 'medium' FROM verdicts WHERE verdict = 'join'
UNION ALL SELECT 'name_city_shared_with_third_person', 'medium' FROM verdicts WHERE verdict = 'join' AND n_both > 0) GROUP BY ALL""",
        "submissions_left_join": f"WITH people AS ({_PEOPLE}) SELECT o_orderkey AS submission_id, {_NAMED} AS person_id, full_name AS matched_name, city, CASE WHEN full_name IS NOT NULL THEN 'high' END AS match_confidence FROM orders LEFT JOIN people ON person_id = {_NAMED}",
        "find_or_create": _FIND_SQL, "people_skills_agg": _SKILL_SQL,
            "untagged_people": _SKILL_SQL + " WHERE skill_category IS NULL AND skills <> '' ORDER BY person_id LIMIT 100",
        "tag_outcome": f"WITH people AS ({_PEOPLE}), {_OUTCOMES_SQL} SELECT person_id, skill_category, outcome, count(*) AS n FROM out GROUP BY ALL",
        "tag_update": f"WITH people AS ({_PEOPLE}), {_OUTCOMES_SQL} SELECT person_id, full_name, city, coalesce(m, skill_category) AS skill_category FROM people LEFT JOIN (SELECT person_id, max(skill_category) AS m FROM out WHERE outcome = 'updated' GROUP BY person_id) USING (person_id)",
        "reply_sanitise": _REPLY_SQL, "stats_row": f"SELECT people, submissions, tagged, issues FROM {_STATS_SQL}",
        "summary_text": f"SELECT concat('Skill tagging: ', tagged, ' of ', people, ' people have a category; ', submissions, ' submissions; ', issues, ' issues logged') AS text FROM {_STATS_SQL}",
        "upload_checks": f"""WITH u AS ({_UPLOADS}) SELECT event_id, CASE WHEN mime = 'image/png' THEN 'unsupported type' WHEN size > 26214400 THEN 'too large' WHEN trim(name) = '' THEN 'name is required' WHEN phone IS NULL THEN 'phone is required' WHEN mime IS NULL THEN 'file is required' END AS reason FROM u""",
        "submissions_display": _DISPLAY_SQL,
        "unique_violations": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
        "foreign_orphans": f"SELECT o_orderkey, named FROM (SELECT o_orderkey, {_NAMED} AS named FROM orders) WHERE named NOT IN (SELECT c_custkey FROM customer)",
        "check_violations": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
        "constraint_violations": " UNION ALL ".join(f"SELECT '{k}' AS kind, '{t}' AS table_name, '{c}' AS key, CAST(0 AS BIGINT) AS n" for k, t,
            c in store.constraints()),
        "planted_violations": _broken_sql(), "sample_measures": _SAMPLES_SQL, "quality_labels": _LABEL_SQL, "price_ranks": _RANKS_SQL, "take_measures": _TAKES_SQL, "customer_components": _COMPONENT_SQL,
    }
