"""Row order for operators whose result depends on it.

Order comes from ``order_by``, completed by the other sortable columns as tie-breakers, or, without
it, from the order in which the source is read. Rows are dealt into buckets by order, so that running
results need no single task: each bucket is handled by itself, and what it takes over from the buckets
before or after it comes from one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.missing import col
from sparkscrub.plans.scratch import written

BUCKET, ROW = "__bucket", "__row_id"
#: Buckets that an explicit order is cut into, at most: by quantiles of a number or time, else by a sample of whole keys.
BUCKETS, KEY_BUCKETS, KEY_SAMPLE = 256, 64, 10_000


def _sortable(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))


@dataclass
class Ordered:
    """A frame with its bucket column, and the expressions that order the rows of a bucket."""

    df: DataFrame
    order: list[Column]
    helpers: list[str]

    def window(self):
        return Window.partitionBy(BUCKET).orderBy(*self.order)


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` with the ordinal of its rows as read; kept if there already."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a column of row numbers from 0 in a total order; no task sees more than a range of the rows.

    Ranges are sorted and written; the rows of the ranges before one are added from one row per range.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), at.alias(name))
    rows = written(rows, "numbered")
    sizes = sorted(tuple(r) for r in rows.groupBy("__range").agg(F.count(F.lit(1))).collect())  # one row per range
    starts, n = [], 0
    for part, size in sizes:
        starts.append((part, n))
        n += size
    ahead = df.sparkSession.createDataFrame(starts, "__range int, __ahead long")
    return rows.join(F.broadcast(ahead), "__range").withColumn(name, F.col(name) + F.col("__ahead")).drop("__range", "__ahead")


def ordered(df: DataFrame, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> Ordered:
    """Deal rows into buckets. With ``partition_by`` each group is a bucket of its own."""
    if not order_by:
        out = with_row_id(df)
        keys: list[Column] = [F.col(ROW)]
        helpers = [BUCKET] + [ROW] * (ROW not in df.columns)
        if not partition_by:
            out = written(out, "rows")  # an ordinal holds only for one way in which the rows are made
    else:
        rest = [f.name for f in df.schema.fields if f.name not in order_by and _sortable(f.dataType)]
        out, keys, helpers = df, [col(c) for c in [*order_by, *rest]], [BUCKET]
    if partition_by:
        out = out.withColumn(BUCKET, F.struct(*[col(c) for c in partition_by]))
    elif not order_by:
        out = out.withColumn(BUCKET, F.shiftright(F.col(ROW), 33))
    else:
        out = _with_bucket(df, order_by[0], keys)
    return Ordered(out, keys, helpers)


def _with_bucket(df: DataFrame, name: str, keys: list[Column]) -> DataFrame:
    """``df`` with the index of a row's range of the order, never null.

    Ranges are told by quantiles of the first order column where it is a number or time with enough different
    values; else by a sample of whole keys, tie-breakers included, so that text and constant columns are dealt
    out too. Only rows that are the same in all sortable columns cannot be told apart.
    """
    t = df.schema[name].dataType
    if isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        as_number = _number(col(name), t)
        shares = [i / BUCKETS for i in range(1, BUCKETS)]
        bounds = sorted(set(df.agg(F.percentile_approx(as_number, shares, 1000)).first()[0] or []), key=lambda b: (b != b, b))  # NaN last
        if len(bounds) >= BUCKETS // 2:
            return _reached(df, F.lit(bounds), len(bounds), as_number)
    n = df.count()
    if not n:
        return df.withColumn(BUCKET, F.lit(0))
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    some = df.select(*named).sample(min(1.0, KEY_SAMPLE / n), 7)
    rows = some.orderBy(*some.columns).collect()  # about KEY_SAMPLE rows
    cuts = list(dict.fromkeys(tuple(rows[len(rows) * i // KEY_BUCKETS]) for i in range(1, KEY_BUCKETS))) if rows else []
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    lits = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, some.schema.fields, strict=True)]) for cut in cuts])
    return _reached(df, lits, len(cuts), F.struct(*named))


def _reached(df: DataFrame, bounds: Column, n: int, at: Column) -> DataFrame:
    """``df`` with the count of ``n`` ascending bounds that are not above a row's place.

    By halving: a look at every bound costs more than sorting the rows. Each step is a projection, so that none is inlined twice.
    """
    out, k = df, F.lit(0)
    for step in (1 << i for i in reversed(range(n.bit_length()))):
        out, k = out.withColumn(BUCKET, k + F.when(F.get(bounds, k + (step - 1)) <= at, step).otherwise(0)), F.col(BUCKET)
    return out


def _number(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")
