"""Type standardisation of text columns: booleans, percentages, numbers, times."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions import parsing
from sparkscrub.functions.missing import col, text_columns
from sparkscrub.operators.base import BaseTransformer, table
from sparkscrub.plans.stats import collect_stats

#: Non-null values that a column's type is told from, and those of them that are tried as dates.
SAMPLE, DATE_SAMPLE = 50, 10
#: First rows that all columns are told from in one job; columns with too few values there take a job of their own.
HEAD = 500


@dataclass
class ConversionResult:
    column: str
    original_dtype: str
    new_dtype: str
    success_count: int
    failed_count: int


def _parses(v: str) -> bool:
    return re.match(parsing.NUMBER, v) is not None


def _is_date(v: str) -> bool:
    for f, _ in parsing.FORMATS:
        try:
            datetime.strptime(v, f)
            return True
        except ValueError:
            continue
    return False


def detect_kind(values: list[str]) -> str | None:
    """Kind of a sample: boolean, percentage, numeric, date, or None. The first that fits wins."""
    sample = [v.strip().lower() for v in values]
    if not sample:
        return None
    share = lambda test, of: sum(map(test, of)) / len(of)
    if share(lambda v: v in parsing.TRUE + parsing.FALSE, sample) > 0.8:
        return "boolean"
    if share(lambda v: re.match(r"^-?\d+\.?\d*\s*%$", v) is not None, sample) > 0.5:
        return "percentage"
    if share(lambda v: _parses(re.sub(parsing.CURRENCY, "", v).strip()), sample) > 0.5:
        return "numeric"
    if share(_is_date, sample[:DATE_SAMPLE]) > 0.5:
        return "date"
    return None


class DataStandardizer(BaseTransformer):
    """Give text columns the type that their first values show.

    ``skip``: columns to leave alone. ``date_inference``: "all" tries every accepted format on each
    value, "first" only the one that fits the first value. With ``coerce_errors`` off, the first
    value that cannot be parsed fails the job that reads it.
    """

    def __init__(self, auto_detect: bool = True, coerce_errors: bool = True, skip: list[str] | None = None, date_inference: str = "all"):
        self.auto_detect, self.coerce_errors, self.skip, self.date_inference = auto_detect, coerce_errors, set(skip or []), date_inference
        self._before: DataFrame | None = None
        self.kinds: dict[str, str] = {}

    def analyze(self, df: DataFrame) -> dict[str, str]:
        """Kind of each text column that has one, by its first values in the order of the rows; the first rows are read once for all."""
        names = [c for c in text_columns(df) if c not in self.skip]
        kinds, self._formats = {}, {}
        head = df.select(*[col(c) for c in names]).limit(HEAD).collect() if names else []
        for i, name in enumerate(names):
            values = [r[i] for r in head if r[i] is not None][:SAMPLE]
            if len(values) < SAMPLE and len(head) == HEAD:
                values = [r[0] for r in df.select(col(name)).where(col(name).isNotNull()).limit(SAMPLE).collect()]
            if kind := detect_kind(values):
                kinds[name] = kind
                if kind == "date" and self.date_inference == "first":
                    v = values[0].strip()
                    self._formats[name] = [f for f in parsing.FORMATS if _is(v, f[0])][:1] or parsing.FORMATS
        return kinds

    def _parsed(self, name: str, kind: str):
        c = col(name)
        out = {
            "boolean": lambda: parsing.to_boolean(c), "percentage": lambda: parsing.to_percentage(c), "numeric": lambda: parsing.to_number(c),
            "date": lambda: parsing.to_time(c, self._formats.get(name, parsing.FORMATS)),
        }[kind]()
        if not self.coerce_errors and kind != "boolean":
            out = F.when(c.isNull() | out.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), c)))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        self._before = df
        self.kinds = self.analyze(df)
        new = {name: self._parsed(name, kind) for name, kind in self.kinds.items()}
        numeric = [n for n, k in self.kinds.items() if k == "numeric"]
        whole = collect_stats(df, {n: F.coalesce(F.bool_and(F.coalesce((new[n] == F.floor(new[n])) & (F.abs(new[n]) < 2**53), F.lit(False))), F.lit(False)) for n in numeric})
        self._new = {n: (c.cast("long") if whole.get(n) else c) for n, c in new.items()}
        return df.withColumns(self._new) if self._new else df

    def get_report(self) -> pd.DataFrame:
        """One row per converted column; counts are of non-null values."""
        if self._before is None:
            return table([], ["column", "original_dtype", "new_dtype", "success_count", "failed_count"])
        df, after = self._before, self._before.select(*[c.alias(n) for n, c in self._new.items()]) if self._new else self._before
        wants = {f"{n}/{k}": v for n, c in self._new.items() for k, v in (("ok", F.count(c)), ("bad", F.count_if(col(n).isNotNull() & c.isNull())))}
        s = collect_stats(df, wants)
        kinds = dict(after.dtypes)
        rows = [ConversionResult(n, df.schema[n].dataType.simpleString(), kinds[n], s[f"{n}/ok"], s[f"{n}/bad"]).__dict__ for n in self._new]
        return table(rows, ["column", "original_dtype", "new_dtype", "success_count", "failed_count"])


def _is(v: str, f: str) -> bool:
    try:
        datetime.strptime(v, f)
        return True
    except ValueError:
        return False
