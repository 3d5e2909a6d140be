"""Values as a listing shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.values import number_text

DASH = "—"


def or_dash(x: Column) -> Column:
    return F.coalesce(x, F.lit(DASH))


def measure(x: Column) -> Column:
    """A number without trailing .0, or a dash."""
    return or_dash(number_text(x.cast("double")))


def kilohertz(rate: Column) -> Column:
    return or_dash(F.when(rate != 0, F.concat(number_text(rate / 1000), F.lit(" kHz"))))


def kilobytes(size: Column) -> Column:
    return or_dash(F.when(size != 0, F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB"))))


def pill(label: Column) -> Column:
    """The class of a quality label."""
    q = F.coalesce(label, F.lit(""))
    return F.when(q.startswith("good"), "good").when(q.startswith("poor"), "poor").when(q.startswith("unknown"), "unk").otherwise("fair")


def short_file(name: Column) -> Column:
    """A source file's name without its ending."""
    return F.regexp_replace(name, r"\.csv$", "")
