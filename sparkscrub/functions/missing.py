"""Missing values: SQL null and, for floating columns, NaN are the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(t: T.DataType) -> bool:
    """Numbers; booleans are none."""
    return isinstance(t, T.NumericType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def known(name: str, t: T.DataType) -> Column:
    """The column with NaN turned into null."""
    return F.nanvl(col(name), F.lit(None).cast(t)) if isinstance(t, FLOATING) else col(name)


def is_missing(name: str, t: T.DataType) -> Column:
    return (col(name).isNull() | F.isnan(col(name))) if isinstance(t, FLOATING) else col(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """The same frame with NaN as null; one projection, and none at all without floating columns."""
    names = columns_of(df, *FLOATING)
    return df.withColumns({n: known(n, df.schema[n].dataType) for n in names}) if names else df
