"""Statistics of many columns in one aggregation job."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.missing import col, is_missing, known


def collect_stats(df: DataFrame, wants: dict[Any, Column]) -> dict[Any, Any]:
    """Evaluate named aggregates in one pass and give them back by name."""
    if not wants:
        return {}
    names = list(wants)
    row = df.agg(*[wants[n].alias(f"s{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Missing values of each column, and the rows under the key ``""``."""
    columns = list(df.columns) if columns is None else columns
    wants = {c: F.count_if(is_missing(c, df.schema[c].dataType)) for c in columns}
    return collect_stats(df, wants | {"": F.count(F.lit(1))})


def value(df: DataFrame, name: str) -> Column:
    """The column as double with NaN as null: what numeric statistics are made of."""
    return known(name, df.schema[name].dataType).cast("double")


#: Rows whose values one aggregate may hold in a map, and the share on each side of a quantile that approximation leaves open.
MAP_ROWS, OPEN = 100_000, 2e-4


def quantiles(df: DataFrame, wants: dict[Any, tuple[Column, list[float]]], approx: bool = False) -> dict[Any, list[float] | None]:
    """Linear-interpolated quantiles (column, shares) by name, null where there are no values; or approximate ones.

    Exact ones are bracketed first: approximate quantiles on both sides, and a count of what lies below and
    between. Brackets are narrowed until few values are left between, and only those are ordered: no aggregate
    holds more than about MAP_ROWS values, whatever the table.
    """
    if approx:
        return collect_stats(df, {k: F.percentile_approx(c, shares, 10_000) for k, (c, shares) in wants.items()})
    sides = lambda p: [max(0.0, p - OPEN), min(1.0, p + OPEN)]
    s = collect_stats(df, {(k, "n"): F.count(c) for k, (c, _) in wants.items()} | {(k, "q"): F.percentile_approx(c, [x for p in shares for x in sides(p)], 10_000) for k, (c, shares) in wants.items()})
    out: dict[Any, list] = {k: [None] * len(shares) for k, (_, shares) in wants.items()}
    last: dict[tuple, Column] = {}
    open_: dict[tuple, list[float]] = {}
    for k, (c, shares) in wants.items():
        n = s[k, "n"]
        if 0 < n <= MAP_ROWS:
            last |= {(k, i): F.percentile(c, F.lit(float(p))) for i, p in enumerate(shares)}
        elif n:
            open_ |= {(k, i): s[k, "q"][2 * i : 2 * i + 2] for i in range(len(shares))}
    rank = lambda k, i: (s[k, "n"] - 1) * wants[k][1][i]
    while open_:
        inside = {x: F.when(wants[x[0]][0].between(F.lit(lo), F.lit(hi)), wants[x[0]][0]) for x, (lo, hi) in open_.items()}
        found = collect_stats(df, {(x, "below"): F.count_if(wants[x[0]][0] < F.lit(lo)) for x, (lo, _) in open_.items()} | {(x, "in"): F.count(v) for x, v in inside.items()})
        narrow: dict[tuple, Column] = {}
        for x, (lo, hi) in open_.items():
            at, n = rank(*x) - found[x, "below"], found[x, "in"]
            if at < 0 or math.ceil(at) > n - 1:
                last[x] = F.percentile(wants[x[0]][0], F.lit(float(wants[x[0]][1][x[1]])))  # an approximation out of its bounds
            elif lo == hi:
                out[x[0]][x[1]] = lo
            elif n <= MAP_ROWS:
                last[x] = F.percentile(inside[x], F.lit(at / max(1, n - 1)))
            else:
                narrow[x] = F.percentile_approx(inside[x], sides(at / (n - 1)), 10_000)
        new = collect_stats(df, narrow)
        # what does not get narrower holds few different values, which a map can hold
        last |= {x: F.percentile(inside[x], F.lit((rank(*x) - found[x, "below"]) / (found[x, "in"] - 1))) for x, b in new.items() if list(b) == list(open_[x])}
        open_ = {x: list(b) for x, b in new.items() if list(b) != list(open_[x])}
    for (k, i), v in collect_stats(df, last).items():
        out[k][i] = v
    return {k: None if None in v else v for k, v in out.items()}


def medians(df: DataFrame, wants: dict[Any, Column], approx: bool = False) -> dict[Any, float | None]:
    return {k: v and v[0] for k, v in quantiles(df, {k: (c, [0.5]) for k, c in wants.items()}, approx).items()}


def modes(df: DataFrame, wants: dict[Any, Column]) -> dict[Any, Any]:
    """Most frequent value of each column, the smallest of those tied, null without values.

    A grouping for each column, which reads that column only and combines before the shuffle: values are
    never held in one map.
    """
    out = {}
    for k, c in wants.items():
        per = df.select(c.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        out[k] = per.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).first()[0]
    return out


def corrected_skew(c: Column) -> Column:
    """Bias-corrected skewness; null under three values, 0 for constants."""
    n = F.count(c)
    g = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.min(c) == F.max(c), 0.0).otherwise(g)


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four values, 0 for constants."""
    n = F.count(c)
    d = F.when(n > 3, (n - 2) * (n - 3))
    g = ((n - 1) / d) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.min(c) == F.max(c), 0.0).otherwise(g)
