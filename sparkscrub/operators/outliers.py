"""Outliers: bounds from one aggregation, treatments as expressions over those bounds."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.missing import col, is_numeric, known, numeric_columns
from sparkscrub.operators.base import BaseTransformer, percent, table
from sparkscrub.plans.stats import collect_stats, medians, quantiles, value

METHODS = ("iqr", "zscore", "modified_zscore", "percentile")
#: Fixed: makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 0.6745


@dataclass
class OutlierReport:
    column: str
    method: str
    lower_bound: float
    upper_bound: float
    outlier_count: int
    outlier_pct: float
    treatment: str


class OutlierHandler(BaseTransformer):
    """Detect outliers of numeric columns, then cap, remove, flag or impute them."""

    def __init__(self, approx: bool = False):
        self.approx = approx
        self.bounds: dict[str, tuple[float, float]] = {}
        self._flat: set[str] = set()
        self._method, self._rows = "iqr", []

    def detect(self, df: DataFrame, columns: list[str] | None = None, method: str = "iqr", threshold: float = 1.5, percentile_range: tuple[float, float] = (0.01, 0.99)) -> dict[str, tuple[float, float]]:
        """Bounds of each numeric column with three values or more; others are skipped."""
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        names = [c for c in (columns or numeric_columns(df)) if c in df.columns and is_numeric(df.schema[c].dataType)]
        shares = {"iqr": [0.25, 0.75], "percentile": list(percentile_range), "modified_zscore": [0.5], "zscore": []}[method]
        wants: dict[str, Column] = {}
        for c in names:
            v = value(df, c)
            wants[f"{c}/n"] = F.count(v)
            if not shares:
                wants |= {f"{c}/m": F.avg(v), f"{c}/s": F.stddev_samp(v)}
        s = collect_stats(df, wants)
        names = [c for c in names if s[f"{c}/n"] >= 3]
        if shares:
            s |= {f"{c}/q": q for c, q in quantiles(df, {c: (value(df, c), shares) for c in names}, self.approx).items()}
        if method == "modified_zscore":
            s |= {f"{c}/mad": q for c, q in medians(df, {c: F.abs(value(df, c) - F.lit(s[f"{c}/q"][0])) for c in names}, self.approx).items()}
        self.bounds, self._flat, self._method, self._rows = {}, set(), method, []
        for c in names:
            if method == "iqr":
                lo, hi = s[f"{c}/q"]
                self.bounds[c] = (lo - threshold * (hi - lo), hi + threshold * (hi - lo))
            elif method == "percentile":
                self.bounds[c] = tuple(s[f"{c}/q"])
            else:
                mid, spread = (s[f"{c}/m"], s[f"{c}/s"]) if method == "zscore" else (s[f"{c}/q"][0], s[f"{c}/mad"] / MAD_SCALE)
                self.bounds[c] = (mid - threshold * spread, mid + threshold * spread)
                if not spread:
                    self._flat.add(c)  # without spread nothing is an outlier
        return self.bounds

    def mask(self, df: DataFrame, c: str) -> Column:
        """True where a value of column ``c`` is beyond its bounds; null counts as inside."""
        if c in self._flat:
            return F.lit(False)
        lo, hi = self.bounds[c]
        v = known(c, df.schema[c].dataType)
        return F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))

    def transform(self, df: DataFrame, strategy: str = "cap", columns: list[str] | None = None) -> DataFrame:
        """``cap`` or ``winsorize``, ``remove``, ``flag``, ``impute_mean``, ``impute_median``; others only report."""
        names = [c for c in (columns or self.bounds) if c in self.bounds and c in df.columns]
        self._before, self._names, self._strategy = df, names, strategy
        masks = {c: self.mask(df, c) for c in names}
        if not names:
            return df
        if strategy in ("cap", "winsorize"):
            new = {}
            for c in names:
                if c not in self._flat:
                    lo, hi = self.bounds[c]
                    new[c] = F.when(masks[c], F.when(col(c) < F.lit(lo), F.lit(lo)).otherwise(F.lit(hi))).otherwise(col(c).cast("double"))
            return df.withColumns(new) if new else df
        if strategy == "remove":
            keep = ~masks[names[0]]
            for c in names[1:]:
                keep = keep & ~masks[c]
            return df.where(keep)
        if strategy == "flag":
            return df.withColumns({f"{c}_is_outlier": masks[c].cast("int") for c in names})
        if strategy in ("impute_mean", "impute_median"):
            inner = {c: F.when(~masks[c], value(df, c)) for c in names}
            fill = collect_stats(df, {c: F.avg(v) for c, v in inner.items()}) if strategy == "impute_mean" else medians(df, inner, self.approx)
            return df.withColumns({c: F.when(masks[c], F.lit(fill[c])).otherwise(col(c).cast("double")) for c in names})
        return df

    def get_report(self) -> pd.DataFrame:
        columns = list(OutlierReport.__dataclass_fields__)
        if not getattr(self, "_names", None):
            return table([], columns)
        s = collect_stats(self._before, {"": F.count(F.lit(1))} | {c: F.count_if(self.mask(self._before, c)) for c in self._names})
        rows = [OutlierReport(c, self._method, round(self.bounds[c][0], 4), round(self.bounds[c][1], 4), s[c], percent(s[c], s[""]), self._strategy).__dict__ for c in self._names]
        return table(rows, columns)
