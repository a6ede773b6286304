"""Base classes. A transformer takes a frame and gives a lazy frame; its report is computed on demand."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def table(rows: list[dict[str, Any]], columns: list[str]) -> pd.DataFrame:
    """A report: a small local table with fixed columns."""
    return pd.DataFrame(rows, columns=columns)


def percent(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


class BaseTransformer(ABC):
    """Stateless step: analyse, transform, report."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def get_report(self) -> pd.DataFrame: ...


class FitTransformer(BaseTransformer):
    """Step that learns a model of literals from one frame and applies it to any."""

    @abstractmethod
    def fit(self, df: DataFrame) -> FitTransformer: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
