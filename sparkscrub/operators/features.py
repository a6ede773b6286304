"""Feature preparation: numeric transforms and scaling, date features, feature selection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions import dates as dx
from sparkscrub.functions.missing import TEMPORAL, col, columns_of, known, numeric_columns
from sparkscrub.operators.base import BaseTransformer, FitTransformer, table
from sparkscrub.operators.missing import MissingIndicator
from sparkscrub.plans.stats import collect_stats, corrected_kurtosis, corrected_skew, quantiles, value

TRANSFORMS, SCALERS = ("none", "log", "boxcox", "yeojohnson"), ("standard", "minmax", "robust")


def boxcox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeojohnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


@dataclass
class Fitted:
    """What is learnt about one column, in literals."""

    transform: str = "none"
    shift: float = 0.0
    lam: float = 0.0
    scaling: str = "none"
    center: float = 0.0
    scale: float = 1.0

    def transformed(self, x: Column) -> Column:
        y = x + F.lit(self.shift) if self.shift else x
        return {"none": lambda: x, "log": lambda: F.ln(y), "boxcox": lambda: boxcox(y, self.lam), "yeojohnson": lambda: yeojohnson(x, self.lam)}[self.transform]()

    def apply(self, x: Column) -> Column:
        y = self.transformed(x)
        return (y - F.lit(self.center)) / F.lit(self.scale) if self.scaling != "none" else y


class NumericalTransformer(FitTransformer):
    """Choose, per column, the transform that brings it nearest to normal, then scale.

    Exponents are found by maximum likelihood: a job evaluates the profile likelihood of all columns on
    a grid of exponents of both families, then on finer grids around the best, ROUNDS times.
    """

    GRID, ROUNDS = 9, 5

    def __init__(self, columns: list[str] | None = None, auto_transform: bool = True, scaling_method: str | None = "standard", approx: bool = False):
        self.columns, self.auto_transform, self.scaling_method, self.approx = columns, auto_transform, scaling_method, approx
        self.model: dict[str, Fitted] = {}

    def _normality(self, c: Column) -> Column:
        """Distance from normal: |skewness| + |excess kurtosis| / 3; null when there are too few values."""
        return F.abs(corrected_skew(c)) + F.abs(corrected_kurtosis(c)) / 3

    def _exponents(self, df: DataFrame, xs: dict[tuple[str, str], Column]) -> dict[tuple[str, str], float]:
        """Maximum-likelihood exponent for each (family, column): -2..2 for Box-Cox, -2..4 for Yeo-Johnson."""
        bounds = {k: (-2.0, 2.0) if k[0] == "boxcox" else (-2.0, 4.0) for k in xs}
        best = dict.fromkeys(xs, 1.0)
        for _ in range(self.ROUNDS if xs else 0):
            wants, grids, arrays = {}, {}, []
            for j, (k, x) in enumerate(xs.items()):
                lo, hi = bounds[k]
                grids[k] = [lo + (hi - lo) * i / (self.GRID - 1) for i in range(self.GRID)]
                family = boxcox if k[0] == "boxcox" else yeojohnson
                logs = F.ln(x) if k[0] == "boxcox" else F.signum(x) * F.log1p(F.abs(x))
                # transformed values are made once a row, in an array: moments name their argument many times
                arrays.append(F.array(x, logs, *[family(x, lam) for lam in grids[k]]).alias(f"a{j}"))
                a = F.col(f"a{j}")
                wants |= {(*k, i): F.var_pop(a[i + 2]) for i in range(self.GRID)} | {(*k, "logs"): F.sum(a[1]), (*k, "n"): F.count(a[0])}
            s = collect_stats(df.select(*arrays), wants)
            for k, grid in grids.items():
                scored = []
                for i, lam in enumerate(grid):
                    var = s[(*k, i)]
                    if var is not None and math.isfinite(var) and var > 0:
                        scored.append((-s[(*k, "n")] / 2 * math.log(var) + (lam - 1) * s[(*k, "logs")], -i))
                if scored:
                    best[k], step = grid[-max(scored)[1]], grid[1] - grid[0]
                    bounds[k] = (best[k] - step, best[k] + step)
        return best

    def fit(self, df: DataFrame) -> NumericalTransformer:
        names = [c for c in (self.columns or numeric_columns(df)) if c in numeric_columns(df)]
        x = {c: value(df, c) for c in names}
        self.model = {c: Fitted() for c in names}
        if self.auto_transform and names:
            low = collect_stats(df, {c: F.min(x[c]) for c in names})
            names_ok = [c for c in names if low[c] is not None]
            shift = {c: (abs(low[c]) + 1.0 if low[c] <= 0 else 0.0) for c in names_ok}
            lam = self._exponents(df, {("boxcox", c): x[c] + F.lit(shift[c]) for c in names_ok} | {("yeojohnson", c): x[c] for c in names_ok})
            options = {c: [Fitted(), Fitted("log", shift[c]), *(Fitted(k, shift[c] if k == "boxcox" else 0.0, lam[k, c]) for k in ("boxcox", "yeojohnson"))] for c in names_ok}
            made = df.select(*[F.array(*[o.transformed(x[c]) for o in os]).alias(f"a{j}") for j, (c, os) in enumerate(options.items())])
            s = collect_stats(made, {f"{c}/{i}": self._normality(F.col(f"a{j}")[i]) for j, (c, os) in enumerate(options.items()) for i in range(len(os))})
            for c, os in options.items():
                known_scores = [(s[f"{c}/{i}"], i) for i in range(len(os)) if s[f"{c}/{i}"] is not None and math.isfinite(s[f"{c}/{i}"])]
                if known_scores and s[f"{c}/0"] is not None:
                    self.model[c] = os[min(known_scores)[1]]
        if self.scaling_method in SCALERS and names:
            y = {c: self.model[c].transformed(x[c]) for c in names}
            make = {"standard": lambda v: F.array(F.avg(v), F.stddev_pop(v)), "minmax": lambda v: F.array(F.min(v), F.max(v) - F.min(v))}
            robust = self.scaling_method == "robust"
            learnt = quantiles(df, {c: (y[c], [0.5, 0.25, 0.75]) for c in names}, self.approx) if robust else collect_stats(df, {c: make[self.scaling_method](y[c]) for c in names})
            for c, v in learnt.items():
                if v is None or v[0] is None:
                    continue
                m = self.model[c]
                m.scaling, m.center = self.scaling_method, v[0]
                m.scale = (v[2] - v[1] if self.scaling_method == "robust" else v[1]) or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: m.apply(value(df, c)) for c, m in self.model.items() if c in df.columns and (m.transform, m.scaling) != ("none", "none")}
        return df.withColumns(new) if new else df

    def get_report(self) -> pd.DataFrame:
        rows = [{"column": c, "transformation": m.transform, "scaling": m.scaling} for c, m in self.model.items()]
        return table(rows, ["column", "transformation", "scaling"])


FeatureScaler = NumericalTransformer


class DateFeatureExtractor(BaseTransformer):
    """Add parts of every date and timestamp column that has a value."""

    DEFAULT = ("year", "month", "day", "weekday")

    def __init__(self, features: list[str] | None = None, drop_original: bool = False):
        self.features, self.drop_original = list(features or self.DEFAULT), drop_original
        self._added: list[tuple[str, str, str]] = []

    def _of(self, name: str) -> dict[str, tuple[Column, str]]:
        c, f = col(name), set(self.features)
        out: dict[str, tuple[Column, str]] = {}
        for k, part in dx.BASIC.items():
            if k in f:
                out[f"{name}_{k}"] = (part(c), "basic")
        if f & {"is_weekend", "flags"}:
            out[f"{name}_is_weekend"] = (dx.is_weekend(c), "flag")
        for k, flag in (("is_month_start", dx.is_month_start), ("is_month_end", dx.is_month_end)):
            if k in f:
                out[f"{name}_{k}"] = (flag(c), "flag")
        for k, part, period in (("month", F.month, 12), ("weekday", F.weekday, 7)):
            if f & {f"{k}_sin", "cyclical"}:
                sin, cos = dx.cycle(part(c), period)
                out |= {f"{name}_{k}_sin": (sin, "cyclical"), f"{name}_{k}_cos": (cos, "cyclical")}
        if "season" in f:
            out[f"{name}_season"] = (dx.season(c), "season")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        names = columns_of(df, *TEMPORAL)
        some = collect_stats(df, {c: F.count(col(c)) for c in names})
        self._added, new = [], {}
        for c in [c for c in names if some[c]]:
            made = self._of(c)
            self._added += [(c, k, kind) for k, (_, kind) in made.items()]
            new |= {k: expr for k, (expr, _) in made.items()}
        out = df.withColumns(new) if new else df
        return out.drop(*[c for c in names if some[c]]) if self.drop_original else out

    def get_report(self) -> pd.DataFrame:
        return table([{"source": s, "feature": f, "type": k} for s, f, k in self._added], ["source", "feature", "type"])


class FeatureSelector(FitTransformer):
    """Drop numeric columns of low variance, then each that correlates too much with an earlier one.

    ``low_variance`` and ``correlated`` switch the two rules; both are on.
    """

    def __init__(self, variance_threshold: float = 0.0, correlation_threshold: float = 0.95, low_variance: bool = True, correlated: bool = True):
        self.variance_threshold, self.correlation_threshold, self.low_variance, self.correlated = variance_threshold, correlation_threshold, low_variance, correlated
        self.dropped: dict[str, str] = {}

    def fit(self, df: DataFrame) -> FeatureSelector:
        names, self.dropped = numeric_columns(df), {}
        v = {c: value(df, c) for c in names}
        if self.low_variance:
            for c, s in collect_stats(df, {c: F.var_samp(v[c]) for c in names}).items():
                if s is not None and s <= self.variance_threshold:
                    self.dropped[c] = "low_variance"
        rest = [c for c in names if c not in self.dropped]
        if self.correlated and len(rest) > 1:
            wants = {}
            for j, b in enumerate(rest):
                for a in rest[:j]:
                    both = v[a].isNotNull() & v[b].isNotNull()
                    x, y = F.when(both, v[a]), F.when(both, v[b])
                    wants[f"{a}\0{b}"] = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
            r = collect_stats(df, wants)
            for j, b in enumerate(rest):
                if any((s := r[f"{a}\0{b}"]) is not None and not math.isnan(s) and abs(s) > self.correlation_threshold for a in rest[:j]):
                    self.dropped[b] = "high_correlation"
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped) if self.dropped else df

    def get_report(self) -> pd.DataFrame:
        return table([{"column": c, "reason": r} for c, r in self.dropped.items()], ["column", "reason"])


__all__ = ["DateFeatureExtractor", "FeatureScaler", "FeatureSelector", "MissingIndicator", "NumericalTransformer", "known"]
