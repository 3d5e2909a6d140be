"""Field normalisers N1 to N12 as Column expressions.

Each takes a string column and returns struct<value, issues, ...>. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.values import half_up, is_blank, issue, number, number_text, result, ws_collapse, ws_trim

EMAIL = r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$"

# Canonical cities and skill spellings by their lower-cased form.
CITIES = {
    "gurgaon": "Gurugram", "gurugram": "Gurugram", "bangalore": "Bengaluru", "bengaluru": "Bengaluru",
    "delhi": "Delhi", "new delhi": "Delhi", "delhi ncr": "Delhi", "noida": "Noida", "pune": "Pune",
}
SKILLS = {
    "n8n": "n8n", "langchain": "LangChain", "rest apis": "REST APIs", "mongodb": "MongoDB", "mysql": "MySQL", "sql": "SQL",
    "fastapi": "FastAPI", "web scraping": "Web Scraping", "javascript": "JavaScript", "react": "React", "docker": "Docker",
    "zapier": "Zapier", "python": "Python", "pandas": "Pandas", "selenium": "Selenium",
}
STATUSES = ("active", "inactive", "paused")
YES, NO = ("y", "yes", "true", "1"), ("n", "no", "false", "0")
HOURS_PER_MONTH = 176
LAKH_BELOW = 100


def lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed map as a literal (J6); null if the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def looks_like_email(x: Column) -> Column:
    """C8."""
    return F.coalesce(ws_trim(x).rlike(EMAIL), F.lit(False))


def phone(raw: Column) -> Column:
    """+91 and ten digits."""
    text = ws_trim(raw)
    digits = F.regexp_replace(text, r"\D", "")
    size = F.length(digits)
    core = (
        F.when((size == 12) & digits.startswith("91"), F.substring(digits, 3, 10))
        .when((size == 11) & digits.startswith("0"), F.substring(digits, 2, 10))
        .when((size == 13) & digits.startswith("091"), F.substring(digits, 4, 10))
        .otherwise(digits)
    )
    valid = F.length(core) == 10
    canonical = F.concat(F.lit("+91"), core)
    separated = text.rlike(r"(?U)[\s\-()]")
    return result(
        is_blank(raw), F.when(valid, canonical),
        issue(~valid, "phone_invalid", "high", text, "not used for matching", F.format_string("%d digits remain, 10 are needed", F.length(core))),
        issue(valid & ~core.rlike("^[6-9]"), "phone_suspicious", "medium", text, "used for matching as it is",
            F.concat(F.lit("mobile numbers begin with 6 to 9, this one with "), F.substring(core, 1, 1))),
        issue(valid & (text != canonical), "phone_format", "low", text, F.concat(F.lit("rewritten as "), canonical),
            F.when(separated, "separators and another prefix").otherwise("another prefix")),
        last10=F.when(valid, core),
    )


def email(raw: Column) -> Column:
    """N2."""
    text, low = ws_trim(raw), F.lower(ws_trim(raw))
    valid = low.rlike(EMAIL)
    return result(
        is_blank(raw), F.when(valid, low),
        issue(text != low, "email_case", "medium", text, F.concat(F.lit("rewritten as "), low), "case would keep equal addresses apart"),
        issue(~valid, "email_invalid", "high", text, "not used for matching", "not of the shape of an address"),
    )


def name(raw: Column) -> Column:
    """Display form; `key`: sorted whole tokens; `has_initial`: a one-letter token was left out."""
    tidy = ws_collapse(raw)
    display = F.initcap(tidy)
    tokens = F.filter(F.split(F.replace(F.lower(display), F.lit("."), F.lit("")), " "), lambda t: t != "")
    whole = F.filter(tokens, lambda t: F.length(t) > 1)
    initial = F.size(whole) != F.size(tokens)
    key = F.array_join(F.array_sort(whole), " ")
    shouted = (tidy == F.upper(tidy)) & tidy.rlike("[A-Z]{2}")
    return result(
        is_blank(raw), display,
        issue(raw != tidy, "name_whitespace", "low", raw, F.concat(F.lit("rewritten as "), tidy), "outer or repeated white space"),
        issue(shouted, "name_case", "low", raw, F.concat(F.lit("rewritten as "), display), "written in capitals"),
        issue(initial, "name_abbreviated", "medium", raw, "initials left out of the key", "an initial cannot tell people apart"),
        key=F.when(key != "", key), has_initial=initial,
    )


def city(raw: Column) -> Column:
    """N4; `canonical`: whether the city is a known one."""
    key = F.lower(ws_collapse(raw))
    known = lookup(CITIES, key)
    return result(
        is_blank(raw), F.coalesce(known, F.initcap(key)),
        issue(raw != ws_trim(raw), "city_whitespace", "low", raw, F.concat(F.lit("rewritten as "), ws_trim(raw)), "outer white space would split groups"),
        issue(known.isNull(), "city_unknown", "medium", raw, "kept, not used for matching", "not a known city"),
        issue(known.isNotNull() & (key != F.lower(known)), "city_variant", "low", raw, F.concat(F.lit("read as "), known),
            F.when(key == "delhi ncr", "a region that holds other cities too").otherwise("another name of the city")),
        canonical=known.isNotNull(),
    )


def applied_date(raw: Column) -> Column:
    """Slashes mean month first, dashes day first; both at most 12 is ambiguous."""
    text = ws_trim(raw)
    shapes = (  # pattern of the shape, pattern that is also padded as it must be, format, date format of the issue
        (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^[1-9]\d? [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    )
    value = F.coalesce(*[F.when(text.rlike(strict), F.try_to_date(F.when(text.rlike(strict), text), fmt)) for _, strict, fmt in shapes])
    parts = F.split(text, "[/-]")
    small = lambda i: F.get(parts, F.lit(i)).try_cast("int") <= 12
    ambiguous = text.rlike(r"^\d{1,2}([/-])\d{1,2}\1\d{4}$") & small(0) & small(1)
    read = F.concat(F.lit("read as "), F.coalesce(value.cast("string"), F.lit("no date")))
    return result(
        is_blank(raw), value,
        issue(ambiguous, "date_ambiguous", "high", text, read, "day and month could be exchanged"),
        issue(value.isNull(), "date_unparseable", "high", text, "stored as null", "no known shape"),
        issue(value.isNotNull() & ~text.rlike(shapes[0][0]), "date_format", "low", text, read, "the column mixes shapes"),
    )


def ctc(raw: Column) -> Column:
    """Rupees a year; figures under 100 are lakhs."""
    text = ws_trim(raw)
    value = number(F.regexp_replace(text, r"(?U)[,\s₹]", ""))
    lakhs = value < LAKH_BELOW
    rupees = F.when(lakhs, half_up(value * 100000)).otherwise(half_up(value))
    return result(
        is_blank(raw), rupees,
        issue(value.isNull(), "ctc_unparseable", "high", text, "stored as null", "not a number"),
        issue(lakhs, "ctc_mixed_units", "high", text, F.concat(F.lit("read as "), number_text(value), F.lit(" lakhs, "), rupees.cast("string"),
            F.lit(" a year")), "the column mixes rupees and lakhs"),
        unit=F.when(lakhs, "lpa").when(value.isNotNull(), "inr"),
    )


def rate(raw: Column) -> Column:
    """Rupees an hour; months have 176 hours; `raw`: the text as it was."""
    text = ws_trim(raw)
    shape = r"(?i)^([\d.]+)\s*(k?)\s*/\s*(hr|hour|month|mo)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    amount = F.when(part(1) != "", number(part(1))) * F.when(F.lower(part(2)) == "k", 1000.0).otherwise(1.0)
    monthly = F.lower(part(3)).isin("month", "mo")
    value = F.when(monthly, F.round(amount / HOURS_PER_MONTH, 2)).otherwise(amount)
    return result(
        is_blank(raw), value,
        issue(amount.isNull(), "rate_unparseable", "high", text, "stored as null, text kept", "not an amount by hour or month"),
        issue(amount.isNotNull() & monthly, "rate_mixed_units", "medium", text, F.concat(F.lit("read as "), number_text(value), F.lit(" an hour")),
            "the column mixes hours and months"),
        basis=F.when(amount.isNotNull(), F.when(monthly, "month").otherwise("hour")), raw=text,
    )


def status(raw: Column) -> Column:
    """Blank is unknown without an issue."""
    text, low = ws_trim(raw), F.lower(ws_trim(raw))
    known = low.isin(*STATUSES)
    return result(
        is_blank(raw), F.when(known, low).otherwise("unknown"),
        issue(~known, "status_unknown", "medium", text, "stored as unknown", "not one of the states"),
        issue(known & (text != low), "status_case", "low", text, F.concat(F.lit("rewritten as "), low), "the column mixes cases"),
        blank_value=F.lit("unknown"),
    )


def verified(raw: Column) -> Column:
    """1, 0 or null; every value that can be read is logged."""
    text, low = ws_trim(raw), F.lower(ws_trim(raw))
    value = F.when(low.isin(*YES), 1).when(low.isin(*NO), 0)
    return result(
        is_blank(raw), value,
        issue(value.isNull(), "verified_unparseable", "medium", text, "stored as null", "neither yes nor no"),
        issue(value.isNotNull(), "boolean_inconsistent", "low", text, F.concat(F.lit("read as "), value.cast("string")), "the column mixes spellings"),
    )


def integer(raw: Column, column: str) -> Column:
    """5.0 is whole."""
    text = ws_trim(raw)
    value = number(text)
    whole = F.when(value == F.floor(value), value.try_cast("long"))
    return result(is_blank(raw), whole, issue(whole.isNull(), "integer_unparseable", "medium", text, "stored as null", f"{column} is not whole"))


def real(raw: Column, column: str) -> Column:
    """N11."""
    text = ws_trim(raw)
    value = number(text)
    return result(is_blank(raw), value, issue(value.isNull(), "float_unparseable", "medium", text, "stored as null", f"{column} is no number"))


def skills(raw: Column) -> Column:
    """array<struct<canonical_name, match_key>>, first mentions in their order."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.struct(ws_trim(p).alias("text"), F.lower(ws_collapse(p)).alias("key"))), lambda s: s["key"] != "")
    keys = F.transform(parts, lambda s: s["key"])
    repeated = lambda s, i: F.array_position(keys, s["key"]) <= i
    first = F.filter(parts, lambda s, i: ~repeated(s, i))
    value = F.transform(first, lambda s: F.struct(F.coalesce(lookup(SKILLS, s["key"]), s["text"]).alias("canonical_name"), s["key"].alias("match_key")))
    note = lambda kind, s, action, detail: F.struct(F.lit(kind).alias("issue_type"), F.lit("low").alias("severity"), s["text"].alias("raw_value"),
        F.lit(action).alias("action_taken"), F.lit(detail).alias("detail"))
    found = F.transform(parts, lambda s, i: F.when(repeated(s, i),
        note("skill_duplicate", s, "left out", "named twice in a cell")).when(lookup(SKILLS, s["key"]).isNull(),
        note("skill_unknown", s, "kept as it is", "not a known skill")))
    blank, none = is_blank(raw), F.array().cast("array<struct<canonical_name:string,match_key:string>>")
    return F.struct(F.when(~blank, value).otherwise(none).alias("value"),
        F.when(~blank, F.array_compact(found)).otherwise(F.array()).cast("array<struct<issue_type:string,severity:string,raw_value:string,action_taken:string,detail:string>>").alias("issues"))
