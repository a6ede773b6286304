"""Missing values: analysis, imputation learnt from one frame and applied to any, and simple helpers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import TEMPORAL, col, is_missing, is_numeric, known, numeric_columns
from sparkscrub.operators.base import BaseTransformer, FitTransformer, percent, table
from sparkscrub.plans.order import BUCKET, ordered
from sparkscrub.plans.stats import collect_stats, corrected_skew, medians, missing_counts, modes, value

CARRIED = ("interpolate", "ffill", "bfill")


@dataclass
class MissingReport:
    column: str
    missing_count: int
    missing_pct: float
    strategy: str
    fill_value: Any


def _before_and_after(out: DataFrame) -> DataFrame:
    """Per bucket, the last value known before it and the first known after it, with their positions as counted from its start."""
    ends = out.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("size"), F.max_by("__known", F.col("__known.i")).alias("last"), F.min_by("__known", F.col("__known.i")).alias("first"),
    )
    w = Window.orderBy(BUCKET)
    ends = ends.withColumn("start", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    moved = lambda c, by: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["v"].alias("v"), (F.col(c)["i"] + by).alias("i")))
    ends = ends.withColumns({c: moved(c, F.col("start")) for c in ("last", "first")})
    ends = ends.withColumns({"__prev": F.expr("lag(last) IGNORE NULLS").over(w), "__next": F.expr("lead(first) IGNORE NULLS").over(w)})
    return ends.select(F.col(BUCKET).alias("__b"), *[moved(c, -F.col("start")).alias(c) for c in ("__prev", "__next")])


def carry(df: DataFrame, name: str, how: str, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Fill one column by ``ffill``, ``bfill`` or linear ``interpolate`` by position.

    No global sort of all rows into one task: buckets are filled by themselves, and take over what
    lies before and after from one row per bucket. With ``partition_by`` nothing is taken over.
    Rows are shuffled by bucket, once for both uses where all their columns can be sorted; all that follows keeps to the order in a bucket.
    """
    t = df.schema[name].dataType
    o = ordered(df, order_by, partition_by)
    w = o.window()
    c = known(name, t)
    out = o.df.withColumn("__i", F.row_number().over(w).cast("long"))
    out = out.withColumn("__known", F.when(c.isNotNull(), F.struct(c.alias("v"), F.col("__i").alias("i"))))
    p, n_ = F.col("__p"), F.col("__n")
    ends = None if partition_by else _before_and_after(out)
    # what lies ahead is no frame that ends with the bucket: that would be gone through again for every row
    out = out.withColumns({"__p": F.last("__known", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.expr("lead(__known) IGNORE NULLS").over(w)})
    if ends is not None:
        out = out.join(ends, F.col(BUCKET) == F.col("__b"), "left")  # buckets are never null
        p, n_ = F.coalesce(p, "__prev"), F.coalesce(n_, "__next")
    if how == "ffill":
        filled = F.coalesce(c, p["v"])
    elif how == "bfill":
        filled = F.coalesce(c, n_["v"])
    else:
        number, back_to = _line(t)
        step = (number(n_["v"]) - number(p["v"])) * (F.col("__i") - p["i"]) / (n_["i"] - p["i"])
        inner = F.when(n_["v"].isNull(), p["v"].cast(_out(t))).otherwise(back_to(number(p["v"]) + step))
        filled = F.when(c.isNotNull(), c.cast(_out(t))).when(p["v"].isNotNull(), inner)
    return out.withColumn(name, filled).select(*[col(x) for x in df.columns])


def _out(t: T.DataType) -> T.DataType:
    return T.DoubleType() if is_numeric(t) else t


def _line(t: T.DataType):
    """A type's values as doubles, and back."""
    if isinstance(t, T.DateType):
        return (lambda c: F.unix_date(c).cast("double")), lambda c: F.date_from_unix_date(F.round(c).cast("int"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return (lambda c: F.unix_micros(c.cast("timestamp")).cast("double")), lambda c: F.timestamp_micros(F.round(c).cast("long")).cast(t)
    return (lambda c: c.cast("double")), lambda c: c


class MissingValueHandler(FitTransformer):
    """Impute missing values with per-column strategies.

    Strategies: mean, median, mode, zero, unknown, interpolate, ffill, bfill, drop_rows, drop_column,
    flag_missing. ``order_by`` and ``partition_by`` order rows for those that carry values; ``approx`` takes
    approximate medians.
    """

    def __init__(
        self, strategies: dict[str, str] | None = None, default_numeric: str = "median", default_categorical: str = "mode",
        drop_threshold: float = 0.7, order_by: list[str] | None = None, partition_by: list[str] | None = None, approx: bool = False,
    ):
        self.strategies, self.default_numeric, self.default_categorical, self.drop_threshold = dict(strategies or {}), default_numeric, default_categorical, drop_threshold
        self.order_by, self.partition_by, self.approx = order_by, partition_by, approx
        self.model: dict[str, tuple[str, Any]] | None = None
        self._report: list[MissingReport] = []

    def analyze(self, df: DataFrame) -> pd.DataFrame:
        """Per column: dtype, missing_count, missing_pct, unique_values and recommended_strategy."""
        wants: dict[str, Column] = {"": F.count(F.lit(1))}
        for f in df.schema.fields:
            wants[f"{f.name}/m"] = F.count_if(is_missing(f.name, f.dataType))
            wants[f"{f.name}/u"] = F.count_distinct(known(f.name, f.dataType))
            if is_numeric(f.dataType):
                wants[f"{f.name}/s"] = corrected_skew(value(df, f.name))
        s = collect_stats(df, wants)
        rows = []
        for f in df.schema.fields:
            n = s[f"{f.name}/m"]
            share = n / s[""] if s[""] else 0.0
            rows.append({
                "column": f.name, "dtype": f.dataType.simpleString(), "missing_count": n, "missing_pct": round(share * 100, 2),
                "unique_values": s[f"{f.name}/u"], "recommended_strategy": self._recommend(f.dataType, share, s.get(f"{f.name}/s"), s[""] - n),
            })
        return table(rows, ["column", "dtype", "missing_count", "missing_pct", "unique_values", "recommended_strategy"])

    @staticmethod
    def _recommend(t: T.DataType, share: float, skew: float | None, known_rows: int) -> str:
        if share > 0.7:
            return "drop_column"
        if share > 0.5:
            return "flag_missing"
        if isinstance(t, T.BooleanType):
            return "mode"
        if is_numeric(t):
            return "median" if known_rows > 2 and skew is not None and abs(skew) > 1 else "mean"
        return "interpolate" if isinstance(t, TEMPORAL) else "mode"

    def _pick(self, name: str, t: T.DataType, share: float) -> str:
        if name in self.strategies:
            return self.strategies[name]
        if share > self.drop_threshold:
            return "drop_column"
        if isinstance(t, T.BooleanType):
            return "mode"
        if is_numeric(t):
            return self.default_numeric
        return "interpolate" if isinstance(t, TEMPORAL) else self.default_categorical

    def fit(self, df: DataFrame) -> MissingValueHandler:
        """Learn strategies and fill values of the columns that miss some: one job for counts, others for values."""
        counts = missing_counts(df)
        rows = counts.pop("")
        chosen = {c: self._pick(c, df.schema[c].dataType, n / rows) for c, n in counts.items() if n}
        numbers = {s: {c: value(df, c) for c, x in chosen.items() if x == s and is_numeric(df.schema[c].dataType)} for s in ("mean", "median")}
        found = collect_stats(df, {c: F.avg(v) for c, v in numbers["mean"].items()})
        if numbers["median"]:
            found |= medians(df, numbers["median"], self.approx)
        found |= modes(df, {c: known(c, df.schema[c].dataType) for c, s in chosen.items() if s == "mode"})
        self.model = {}
        for c, s in chosen.items():
            fill = found.get(c)
            if s == "zero":
                fill = 0
            elif s == "unknown" or (s == "mode" and fill is None and isinstance(df.schema[c].dataType, T.StringType)):
                fill = "UNKNOWN"
            self.model[c] = (s, fill)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the model. Columns that the model does not know, or that miss nothing here, stay as they are."""
        if self.model is None:
            raise RuntimeError("fit must be called before transform")
        counts = missing_counts(df, [c for c in self.model if c in df.columns])
        rows = counts.pop("")
        self._report, new, carried, gone, need, flags = [], {}, [], [], [], {}
        for c, n in counts.items():
            if not n:
                continue
            strategy, fill = self.model[c]
            t = df.schema[c].dataType
            shown = {"drop_column": "DROPPED", "drop_rows": "ROWS_DROPPED", "interpolate": "INTERPOLATED", "ffill": "FORWARD_FILL", "bfill": "BACKWARD_FILL", "flag_missing": "FLAGGED"}.get(strategy, fill)
            self._report.append(MissingReport(c, n, percent(n, rows), strategy, shown))
            if strategy == "drop_column":
                gone.append(c)
            elif strategy == "drop_rows":
                need.append(c)
            elif strategy in CARRIED:
                carried.append((c, strategy))
            elif strategy == "flag_missing":
                flags[f"{c}_is_missing"] = is_missing(c, t).cast("int")
            elif fill is not None:
                wide = T.DoubleType() if isinstance(fill, float) and isinstance(t, T.IntegralType) and not fill.is_integer() else t
                new[c] = F.coalesce(known(c, t).cast(wide), F.lit(fill).cast(wide))
        out = df
        if need:
            out = out.where(~_any([is_missing(c, df.schema[c].dataType) for c in need]))
        if new or flags:
            out = out.withColumns(new | flags)
        for c, how in carried:
            out = carry(out, c, how, self.order_by, self.partition_by)
        return out.drop(*gone) if gone else out

    def get_report(self) -> pd.DataFrame:
        return table([r.__dict__ for r in self._report], ["column", "missing_count", "missing_pct", "strategy", "fill_value"])


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def drop_na(df: DataFrame, axis: int = 0, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Drop rows (axis 0) or columns (axis 1) with any or only missing values."""
    if axis == 0:
        tests = [is_missing(c, df.schema[c].dataType) for c in (subset or df.columns)]
        if how == "any":
            return df.where(~_any(tests))
        return df.where(_any([~t for t in tests]))
    counts = missing_counts(df)
    rows = counts.pop("")
    return df.drop(*[c for c, n in counts.items() if (n > 0 if how == "any" else n == rows and rows > 0)])


def fill_na(df: DataFrame, numeric_fill: float = 0, categorical_fill: str = "unknown") -> DataFrame:
    """Fill numbers with one value and text with another; other types keep their nulls."""
    new = {}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            new[f.name] = F.coalesce(known(f.name, f.dataType), F.lit(numeric_fill).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            new[f.name] = F.coalesce(col(f.name), F.lit(categorical_fill))
    return df.withColumns(new) if new else df


def add_missing_indicators(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A 0/1 column ``{c}_is_missing`` for each column named, by default all; unknown names are skipped."""
    names = df.columns if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_is_missing": is_missing(c, df.schema[c].dataType).cast("int") for c in names}) if names else df


class MissingIndicator(FitTransformer):
    """Indicators for the columns that miss values when fitted."""

    def __init__(self, suffix: str = "_is_missing"):
        self.suffix, self.columns = suffix, []

    def fit(self, df: DataFrame) -> MissingIndicator:
        counts = missing_counts(df)
        counts.pop("")
        self.columns = [c for c, n in counts.items() if n]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"{c}{self.suffix}": is_missing(c, df.schema[c].dataType).cast("int") for c in self.columns if c in df.columns}
        return df.withColumns(new) if new else df

    def get_report(self) -> pd.DataFrame:
        return table([{"column": c, "indicator": f"{c}{self.suffix}"} for c in self.columns], ["column", "indicator"])


__all__ = ["BaseTransformer", "MissingIndicator", "MissingReport", "MissingValueHandler", "add_missing_indicators", "carry", "drop_na", "fill_na", "numeric_columns"]
