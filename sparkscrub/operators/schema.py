"""Physical schema: recommend and apply the narrowest types.

Labels are those of common columnar libraries (uint8, float32, category). Spark has no unsigned or
category type: unsigned labels take the next signed width, categories stay strings, which Parquet
encodes by dictionary anyway.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import FLOATING, col, is_missing, known
from sparkscrub.plans.stats import collect_stats

log = logging.getLogger("sparkscrub")
#: Fixed: largest change of a value that narrowing to a float may make.
FLOAT_SLACK = 5e-4
FLOAT_MAX = 3.4028234663852886e38
#: Fixed: labels and the Spark types that hold them.
LABELS = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "boolean": "boolean", "category": "string", "string": "string", "datetime64[ns]": "timestamp_ntz",
}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spark_type(label: str) -> str:
    """Spark type of a label; nullable spellings (UInt8, Int64) count as their plain ones, Spark types as themselves."""
    return LABELS.get(label, LABELS.get(label.lower(), label))


def smallest_int_label(low: int | None, high: int | None, nullable: bool = False) -> str:
    """Narrowest integer label of a range, unsigned from 0 up; an empty range gives int64."""
    if low is None or high is None:
        label = "int64"
    elif low >= 0:
        label = next(f"uint{b}" for b in (8, 16, 32, 64) if high < 2**b)
    else:
        label = next((f"int{b}" for b in (8, 16, 32) if -(2 ** (b - 1)) <= low and high < 2 ** (b - 1)), "int64")
    return label.replace("ui", "UI").replace("int", "Int") if nullable and label.startswith("int") else label.replace("uint", "UInt") if nullable else label


def _stats(df: DataFrame, exact_float: bool, categories: bool) -> dict[str, Any]:
    wants = {"": F.count(F.lit(1))}
    for f in df.schema.fields:
        c = known(f.name, f.dataType)
        if isinstance(f.dataType, INTEGRAL) or isinstance(f.dataType, FLOATING):
            wants |= {f"{f.name}/l": F.min(c), f"{f.name}/h": F.max(c), f"{f.name}/m": F.count_if(is_missing(f.name, f.dataType))}
        if exact_float and isinstance(f.dataType, T.DoubleType):
            wants[f"{f.name}/x"] = F.bool_and(F.abs(c.cast("float").cast("double") - c) <= FLOAT_SLACK)
        if categories and isinstance(f.dataType, T.StringType):
            wants[f"{f.name}/u"] = F.count_distinct(col(f.name))
            wants[f"{f.name}/n"] = F.count_if(col(f.name).isNull())
    return collect_stats(df, wants)


def analyze_optimization(
    df: DataFrame, cat_threshold: float = 0.5, cat_max_unique: int = 1000, downcast_float: bool = True, require_float_notnull: bool = True,
    for_parquet: bool = False, verbose: bool = False, enable_logging: bool = False,
) -> dict[str, list[str]]:
    """Recommended label -> columns, from one aggregation. Floats are judged by their range alone."""
    s = _stats(df, False, not for_parquet)
    out: dict[str, list[str]] = {}
    for f in df.schema.fields:
        label = None
        if isinstance(f.dataType, INTEGRAL):
            label = smallest_int_label(s[f"{f.name}/l"], s[f"{f.name}/h"], s[f"{f.name}/m"] > 0)
        elif isinstance(f.dataType, FLOATING):
            label = "float64"
            lo, hi = s[f"{f.name}/l"], s[f"{f.name}/h"]
            if downcast_float and lo is not None and (not require_float_notnull or not s[f"{f.name}/m"]) and lo >= -FLOAT_MAX and hi <= FLOAT_MAX:
                label = "float32"
            if label == ("float64" if isinstance(f.dataType, T.DoubleType) else "float32"):
                label = None
        elif isinstance(f.dataType, T.StringType) and not for_parquet:
            unique = s[f"{f.name}/u"] + (s[f"{f.name}/n"] > 0)
            if unique <= cat_max_unique or unique / max(s[""], 1) <= cat_threshold:
                label = "category"
        if label:
            out.setdefault(label, []).append(f.name)
            if verbose or enable_logging:
                log.info("[%s] %s -> %s", f.name, f.dataType.simpleString(), label)
    return out


def apply_optimization(df: DataFrame, type_map: dict[str, list[str]], enable_logging: bool = False) -> DataFrame:
    """Cast columns to their labels; missing columns and casts that Spark does not know are left out."""
    new = {}
    for label, names in type_map.items():
        for c in names:
            if c not in df.columns:
                log.log(logging.WARNING if enable_logging else logging.DEBUG, "no column %s", c)
                continue
            if df.schema[c].dataType.simpleString() != spark_type(label):
                new[c] = col(c).try_cast(spark_type(label))
    return df.withColumns(new) if new else df


def detect_engine(df: Any) -> str:
    """There is one engine; anything but a Spark frame is refused."""
    if isinstance(df, DataFrame):
        return "spark"
    raise TypeError(f"not a Spark DataFrame: {type(df)}")


def narrow_types(df: DataFrame, downcast_float: bool = True) -> dict[str, str]:
    """Column -> narrower label, for casts that keep every value."""
    s, out = _stats(df, downcast_float, False), {}
    for f in df.schema.fields:
        if isinstance(f.dataType, INTEGRAL):
            label = smallest_int_label(s[f"{f.name}/l"], s[f"{f.name}/h"])
            if spark_type(label) != "decimal(20,0)":
                out[f.name] = label
        elif downcast_float and isinstance(f.dataType, T.DoubleType) and s[f"{f.name}/x"]:
            out[f.name] = "float32"
    return out


def optimize_dataset(df: DataFrame, enable_logging: bool = False, for_parquet: bool = False) -> DataFrame:
    """Narrow integers, and doubles whose values floats hold."""
    detect_engine(df)
    labels: dict[str, list[str]] = {}
    for c, label in narrow_types(df).items():
        labels.setdefault(label, []).append(c)
    return apply_optimization(df, labels, enable_logging)


def optimization_report(before: DataFrame, after: DataFrame, type_map: dict[str, list[str]], show_per_column: bool = True) -> tuple[float, float, float]:
    """Print and return estimated MB before and after, and the percentage saved."""
    from sparkscrub.operators.quality import byte_size

    size = lambda d: (d.agg(F.sum(sum((byte_size(f.name, f.dataType) for f in d.schema.fields), F.lit(0)))).first()[0] or 0) / 2**20
    a, b = size(before), size(after)
    saved = (1 - b / a) * 100 if a else 0.0
    if show_per_column:
        for label, names in type_map.items():
            for c in names:
                now = dict(after.dtypes).get(c, "dropped")
                print(f"{c}: {dict(before.dtypes).get(c)} -> {now} ({label})")
    print(f"{a:.2f} MB -> {b:.2f} MB ({saved:.1f} % less)")
    return a, b, saved
