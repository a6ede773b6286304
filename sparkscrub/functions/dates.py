"""Parts of dates as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: features, in the order in which they are added, and the kind that reports give.
BASIC = {"year": F.year, "month": F.month, "day": F.day, "weekday": F.weekday, "quarter": F.quarter}


def is_weekend(c: Column) -> Column:
    return F.coalesce(F.weekday(c) >= 5, F.lit(False)).cast("int")


def is_month_start(c: Column) -> Column:
    return F.coalesce(F.day(c) == 1, F.lit(False)).cast("int")


def is_month_end(c: Column) -> Column:
    return F.coalesce(F.to_date(c) == F.last_day(c), F.lit(False)).cast("int")


def cycle(c: Column, period: int) -> tuple[Column, Column]:
    angle = c * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def season(c: Column) -> Column:
    m = F.month(c)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall")
