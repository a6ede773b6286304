"""Quality audit of a frame: completeness, duplicates, row scores and suspicious values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import col, is_missing, is_numeric, known
from sparkscrub.plans.stats import collect_stats

#: Fixed: parts of names of columns whose values should not be round.
MONEY = ("income", "salary", "price", "amount", "revenue")
WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def byte_size(name: str, t: T.DataType) -> Column:
    """Estimated bytes of a value in memory; memory has no exact size in a distributed frame."""
    if type(t) in WIDTHS:
        return F.lit(WIDTHS[type(t)])
    if isinstance(t, T.StringType):
        return F.coalesce(F.octet_length(col(name)), F.lit(0)) + 8
    return F.lit(16)


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal rows; map columns take part as entries."""
    keys = [F.sort_array(F.map_entries(col(f.name))).alias(f"k{i}") if isinstance(f.dataType, T.MapType) else known(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if keys else 0


def check_quality(df: DataFrame) -> dict[str, Any]:
    """Rows, columns, missing values, duplicate rows and completeness: one aggregation and one grouping, two jobs."""
    if not isinstance(df, DataFrame):
        raise TypeError("check_quality takes a Spark DataFrame")
    wants = {("", c): F.count_if(is_missing(c, df.schema[c].dataType)) for c in df.columns}
    s = collect_stats(df, wants | {"rows": F.count(F.lit(1)), "size": F.sum(sum((byte_size(f.name, f.dataType) for f in df.schema.fields), F.lit(0)))})
    counts, rows, size = {c: s["", c] for c in df.columns}, s["rows"], s["size"] or 0
    cells, missing = rows * len(df.columns), sum(counts.values())
    return {
        "total_rows": rows, "total_columns": len(df.columns), "missing_values": counts, "total_missing_values": missing,
        "duplicate_rows": duplicate_rows(df), "memory_usage_mb": round(size / 2**20, 2),
        "completeness_percentage": round((1 - missing / cells) * 100, 2) if cells else 0,
        "column_completeness": {c: round((1 - n / rows) * 100, 2) if rows else 0 for c, n in counts.items()},
        "dtypes": dict(df.dtypes),
    }


def quality_score(df: DataFrame) -> DataFrame:
    """``df`` with quality_score (share of known values, 0 to 10) and quality_category."""
    n = len(df.columns)
    full = sum((F.when(is_missing(f.name, f.dataType), 0).otherwise(1) for f in df.schema.fields), F.lit(0))
    score = full / F.lit(float(n)) * 10 if n else F.lit(0.0)
    return df.withColumns({"quality_score": score, "quality_category": F.when(score <= 4, "Poor").when(score <= 7, "Average").otherwise("Good")})


def detect_suspicious(
    df: DataFrame, round_modulus: float = 10000, age_range: tuple[float, float] = (0, 120), rating_range: tuple[float, float] = (1, 5), keys: list[str] | None = None,
) -> DataFrame:
    """0/1 columns for suspiciously round money and for ages and ratings out of range, after ``keys``.

    Columns are told by parts of their lower-case names; where both age and rating fit, rating counts.
    """
    flags: dict[str, Column] = {}
    for f in df.schema.fields:
        if not is_numeric(f.dataType):
            continue
        name, c = f.name.lower(), known(f.name, f.dataType)
        if any(m in name for m in MONEY):
            flags[f"{f.name}_suspiciously_round"] = F.coalesce(c % F.lit(round_modulus) == 0, F.lit(False)).cast("int")
        for part, (lo, hi) in (("age", age_range), ("rating", rating_range)):
            if part in name:
                flags[f"{f.name}_out_of_range"] = F.coalesce((c < lo) | (c > hi), F.lit(False)).cast("int")
    return df.select(*[col(k) for k in keys or []], *[v.alias(k) for k, v in flags.items()])
