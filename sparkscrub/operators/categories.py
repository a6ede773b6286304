"""Category standardisation: case, value mappings, groupings and rare values."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import col, text_columns
from sparkscrub.operators.base import BaseTransformer, table
from sparkscrub.plans.stats import collect_stats


@dataclass
class CategoryReport:
    column: str
    action: str
    unique_before: int
    unique_after: int
    rows_modified: int


def replaced(c: Column, t: T.DataType, mapping: dict) -> Column:
    """All replacements at once: a value that one makes is not replaced again."""
    if not mapping:
        return c
    pairs = [x for k, v in mapping.items() for x in (F.lit(k).cast(t), F.lit(v).cast("string" if isinstance(t, T.StringType) else t))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


class CategoryStandardizer(BaseTransformer):
    """Steps in order: lower case, mappings, groupings, rare values.

    ``rare_threshold``: values of text columns (or of ``rare_columns``) with fewer rows become
    ``rare_label``. Keys of mappings follow ``normalize_case``, those of groupings do not.
    """

    def __init__(
        self, mappings: dict[str, dict] | None = None, groupings: dict[str, dict] | None = None, rare_threshold: int | None = None,
        rare_label: str = "Other", normalize_case: bool = False, rare_columns: list[str] | None = None,
    ):
        self.mappings, self.groupings = dict(mappings or {}), dict(groupings or {})
        self.rare_threshold, self.rare_label, self.normalize_case, self.rare_columns = rare_threshold, rare_label, normalize_case, rare_columns
        self._steps: list[tuple[DataFrame, DataFrame, str, str]] = []

    def add_mapping(self, column: str, mapping: dict) -> CategoryStandardizer:
        self.mappings[column] = mapping
        return self

    def add_grouping(self, column: str, grouping: dict) -> CategoryStandardizer:
        self.groupings[column] = grouping
        return self

    def _step(self, df: DataFrame, new: dict[str, Column], action: str) -> DataFrame:
        if not new:
            return df
        before = df.withColumns({f"__before_{c}": col(c) for c in new})
        after = before.withColumns(new)
        self._steps += [(after, None, c, action) for c in new]
        return df.withColumns(new)

    def _replace(self, df: DataFrame, maps: dict[str, dict], action: str, lower: bool) -> DataFrame:
        new = {}
        for c, m in maps.items():
            if c in df.columns and not isinstance(df.schema[c].dataType, T.BooleanType):
                m = {(k.lower() if lower and isinstance(k, str) else k): v for k, v in m.items()}
                new[c] = replaced(col(c), df.schema[c].dataType, m)
        return self._step(df, new, action)

    def transform(self, df: DataFrame) -> DataFrame:
        self._steps = []
        if self.normalize_case:
            df = self._step(df, {c: F.lower(col(c)) for c in text_columns(df)}, "normalize_case")
        df = self._replace(df, self.mappings, "value_mapping", self.normalize_case)
        df = self._replace(df, self.groupings, "category_grouping", False)
        if self.rare_threshold is not None:
            for c in [c for c in (self.rare_columns or text_columns(df)) if c in df.columns]:
                df = self._rare(df, c)
        return df

    def _rare(self, df: DataFrame, c: str) -> DataFrame:
        """Counts are aggregated first (no hot key) and joined back; each value has one row there."""
        common = df.where(col(c).isNotNull()).groupBy(col(c).alias("__value")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= self.rare_threshold)
        joined = df.join(common.select("__value"), col(c) == F.col("__value"), "left")
        new = F.when(col(c).isNull() | F.col("__value").isNotNull(), col(c)).otherwise(F.lit(self.rare_label))
        after = joined.withColumns({f"__before_{c}": col(c), c: new})
        self._steps.append((after, None, c, "rare_grouping"))
        return joined.withColumn(c, new).select(*[col(x) for x in df.columns])

    def get_report(self) -> pd.DataFrame:
        rows = []
        for after, _, c, action in self._steps:
            old, new = col(f"__before_{c}"), col(c)
            s = collect_stats(after, {"b": F.count_distinct(old), "a": F.count_distinct(new), "m": F.count_if(~old.eqNullSafe(new))})
            if action in ("value_mapping", "category_grouping") or s["m"]:
                rows.append(CategoryReport(c, action, s["b"], s["a"], s["m"]).__dict__)
        return table(rows, ["column", "action", "unique_before", "unique_after", "rows_modified"])
