"""Parsing of messy text into booleans, percentages, numbers and times; failures give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: words for true and false.
TRUE, FALSE = ("true", "yes", "1", "t", "y"), ("false", "no", "0", "f", "n")
#: Fixed: accepted times as (strptime, Spark) formats. Month-first comes before day-first.
FORMATS = [
    ("%Y-%m-%d", "yyyy-M-d"), ("%m-%d-%Y", "M-d-yyyy"), ("%d-%m-%Y", "d-M-yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"), ("%m/%d/%Y", "M/d/yyyy"), ("%d/%m/%Y", "d/M/yyyy"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"), ("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s"),
    ("%b %d, %Y", "MMM d, yyyy"), ("%B %d, %Y", "MMMM d, yyyy"), ("%d %b %Y", "d MMM yyyy"), ("%d %B %Y", "d MMMM yyyy"),
]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CURRENCY = "[$,€£¥]"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_boolean(c: Column) -> Column:
    v = F.lower(_bare(c))
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False)


def to_double(c: Column) -> Column:
    """A plain decimal number; ``try_cast`` alone would also take ``12d``."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def to_percentage(c: Column) -> Column:
    """Hundredths; values without a percent sign are divided too."""
    return to_double(_bare(F.replace(c, F.lit("%"), F.lit("")))) / F.lit(100.0)


def to_number(c: Column) -> Column:
    return to_double(_bare(F.regexp_replace(c, CURRENCY, "")))


def to_time(c: Column, formats: list[tuple[str, str]] = FORMATS) -> Column:
    v = _bare(c)
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for _, f in formats]).cast("timestamp_ntz")
