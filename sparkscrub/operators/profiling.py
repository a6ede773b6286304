"""Profiles of frames."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.missing import is_missing, known, numeric_columns
from sparkscrub.operators.quality import byte_size
from sparkscrub.plans.stats import collect_stats, quantiles, value

MB = 2**20
DESCRIBED = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def dataset_overview(df: DataFrame, deep: bool = True, approx: bool = False) -> pd.DataFrame:
    """Per column: dtype, non_nulls, nulls, missing_pct, unique_count (null counts as a value), memory_mb; largest first."""
    wants = {"": F.count(F.lit(1))}
    for f in df.schema.fields:
        distinct = F.approx_count_distinct if approx else F.count_distinct
        wants[f"{f.name}/m"] = F.count_if(is_missing(f.name, f.dataType))
        wants[f"{f.name}/u"] = distinct(known(f.name, f.dataType))
        wants[f"{f.name}/b"] = F.coalesce(F.sum(byte_size(f.name, f.dataType)), F.lit(0)) if deep else F.lit(8) * F.count(F.lit(1))
    s = collect_stats(df, wants)
    rows = []
    for f in df.schema.fields:
        n = s[f"{f.name}/m"]
        rows.append({
            "column": f.name, "dtype": f.dataType.simpleString(), "non_nulls": s[""] - n, "nulls": n, "missing_pct": round(n / s[""] * 100, 2) if s[""] else 0.0,
            "unique_count": s[f"{f.name}/u"] + (n > 0), "memory_mb": s[f"{f.name}/b"] / MB,
        })
    out = pd.DataFrame(rows, columns=["column", "dtype", "non_nulls", "nulls", "missing_pct", "unique_count", "memory_mb"])
    return out.sort_values("memory_mb", ascending=False, kind="stable", ignore_index=True)


def numeric_summary(df: DataFrame, approx: bool = False) -> dict[str, dict[str, float]]:
    """count, mean, std, min, quartiles and max of every numeric column."""
    wants = {}
    for c in numeric_columns(df):
        v = value(df, c)
        wants |= {f"{c}/c": F.count(v), f"{c}/a": F.avg(v), f"{c}/s": F.stddev_samp(v), f"{c}/l": F.min(v), f"{c}/h": F.max(v)}
    s = collect_stats(df, wants)
    s |= {f"{c}/q": q for c, q in quantiles(df, {c: (value(df, c), [0.25, 0.5, 0.75]) for c in numeric_columns(df)}, approx).items()}
    return {c: dict(zip(DESCRIBED, [s[f"{c}/c"], s[f"{c}/a"], s[f"{c}/s"], s[f"{c}/l"], *(s[f"{c}/q"] or [None] * 3), s[f"{c}/h"]], strict=True)) for c in numeric_columns(df)}


def profile_dataframe(df: DataFrame, deep: bool = True, include_numeric_summary: bool = True, approx: bool = False) -> dict[str, Any]:
    """Rows, columns, memory_mb, dtypes, missing_values, and numeric_summary if asked for."""
    wants = {"": F.count(F.lit(1)), "b": F.coalesce(F.sum(sum((byte_size(f.name, f.dataType) for f in df.schema.fields), F.lit(0))), F.lit(0))}
    s = collect_stats(df, wants | {f"{f.name}/m": F.count_if(is_missing(f.name, f.dataType)) for f in df.schema.fields})
    out = {"rows": s[""], "columns": len(df.columns), "memory_mb": s["b"] / MB, "dtypes": dict(df.dtypes), "missing_values": {c: s[f"{c}/m"] for c in df.columns}}
    if include_numeric_summary:
        out["numeric_summary"] = numeric_summary(df, approx)
    return out
