"""White space, issues and numbers: what the normalisers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<issue_type:string,severity:string,raw_value:string,action_taken:string,detail:string>"
#: White space of Unicode, and the byte order mark.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def ws_trim(x: Column) -> Column:
    """Trim white space of all of Unicode, not spaces alone."""
    return F.btrim(x, F.lit(_SPACES))


def ws_collapse(x: Column) -> Column:
    return F.regexp_replace(ws_trim(x), r"(?U)[\s\x{FEFF}]+", " ")


def is_blank(x: Column) -> Column:
    """Null, empty or white space."""
    return x.isNull() | (ws_trim(x) == "")


def number(x: Column) -> Column:
    """The finite decimal number that the whole of x spells, or null; '' is 0, hexadecimal is not read."""
    value = F.when(x == "", F.lit(0.0)).when(x.rlike(_NUMBER), x.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def number_text(x: Column) -> Column:
    """A number as text, without .0 for whole ones."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def half_up(x: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def issue(when: Column, kind: str, severity: str, raw: Column, action: Column | str, detail: Column | str) -> Column:
    """An array with an issue if the condition holds, else an empty one. Arrays are joined by concat,
    which is compiled, where filtering nulls out of one array would be interpreted, with all in it."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    made = F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), raw.cast("string").alias("raw_value"),
        text(action).alias("action_taken"), text(detail).alias("detail"))
    return F.when(when, F.array(made).cast(f"array<{ISSUE}>")).otherwise(no_issues())


def result(blank: Column, value: Column, *issues: Column, blank_value: Column | None = None, **more: Column) -> Column:
    """struct<value, issues, ...>: a blank input has no issues and the blank value (default null)."""
    found = F.concat(*issues) if issues else no_issues()
    fields = [F.when(~blank, value).otherwise(F.lit(None) if blank_value is None else blank_value).alias("value")]
    fields.append(F.when(~blank, found).otherwise(no_issues()).alias("issues"))
    return F.struct(*fields, *[F.when(~blank, v).alias(k) for k, v in more.items()])
