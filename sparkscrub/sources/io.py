"""Loading, caching and converting CSV and Parquet through Spark's readers and any Hadoop file system."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import parsing
from sparkscrub.functions.missing import col, is_missing
from sparkscrub.logs import get_logger
from sparkscrub.logs import log as say
from sparkscrub.operators.schema import optimize_dataset, spark_type
from sparkscrub.plans.scratch import written
from sparkscrub.plans.stats import collect_stats

log = logging.getLogger("sparkscrub")
#: Fixed: cells of a CSV file that mean a missing value.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CODECS = ("snappy", "zstd", "gzip", "brotli", "lz4", "none")
ENGINES = ("spark", "pandas", "polars")


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def schema_for_types(names: list[str], type_map: dict[str, list[str]]) -> dict[str, str]:
    """Column -> Spark type for the columns of a label -> columns map that exist."""
    return {c: spark_type(str(label)) for label, cols in type_map.items() for c in cols if c in names}


def _na_to_null(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~col(c).isin(NA), col(c)) for c in texts}) if texts else df


def _typed(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """Cast text columns by hints; a hint that would lose a value leaves its column as it is."""
    new = {c: (parsing.to_time(col(c)).cast(t) if t.startswith("timestamp") and dict(df.dtypes)[c] == "string" else col(c).try_cast(t)) for c, t in hints.items() if c in df.columns}
    lost = collect_stats(df, {c: F.count_if(~is_missing(c, df.schema[c].dataType) & e.isNull()) for c, e in new.items()})
    for c in [c for c, n in lost.items() if n]:
        log.warning("column %s does not fit its hint %s", c, hints[c])
    good = {c: e for c, e in new.items() if not lost[c]}
    return df.withColumns(good) if good else df


def _inferred(df: DataFrame) -> DataFrame:
    """Narrowest of bigint, double and boolean that holds all known values of a text column; one aggregation."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wants = {}
    for c in texts:
        v = F.trim(col(c))
        wants[f"{c}/n"] = F.count(v)
        wants[f"{c}/i"] = F.count_if(v.rlike(r"^[+-]?[0-9]{1,18}$"))
        wants[f"{c}/d"] = F.count_if(v.rlike(parsing.NUMBER))
        wants[f"{c}/b"] = F.count_if(F.lower(v).isin("true", "false"))
    s, new = collect_stats(df, wants), {}
    for c in texts:
        n = s[f"{c}/n"]
        for key, t in (("i", "bigint"), ("d", "double"), ("b", "boolean")):
            if n and s[f"{c}/{key}"] == n:
                new[c] = F.trim(col(c)).cast(t)
                break
    return df.withColumns(new) if new else df


def spans_lines(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a quoted cell of a CSV file may go over a line's end: some line has an odd number of quotes."""
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    return not (spark or _spark()).read.text(path).where(odd).isEmpty()


def _raw_csv(path: str, spark: SparkSession, multi_line: bool | None, schema: T.StructType | None = None):
    """A reader of cells as text. Files with cells over several lines cannot be split; others are, line by line."""
    multi_line = spans_lines(path, spark) if multi_line is None else multi_line
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("escape", '"').option("columnNameOfCorruptRecord", "__bad")
    return (reader.schema(schema) if schema else reader).csv(path)


def load_csv(
    path: str, chunksize: int | None = None, type_map: dict[str, list[str]] | None = None, use_dtype_hints: bool = True, logger: logging.Logger | None = None,
    spark: SparkSession | None = None, multi_line: bool | None = None,
) -> DataFrame | Iterator[DataFrame]:
    """Read a CSV file with a header. Columns with hints take their types, the others are inferred.

    ``chunksize``: an iterator of frames of so many rows each, in the order of the file. ``multi_line``: whether
    quoted cells may go over several lines; by default the file is looked through for such cells.
    """
    spark = spark or _spark()
    say(logger, f"reading {path} as CSV")
    raw = _na_to_null(_raw_csv(path, spark, multi_line))
    hints = schema_for_types(raw.columns, type_map) if type_map and use_dtype_hints else {}
    typed = _typed(raw, hints) if hints else raw
    rest = [c for c in typed.columns if c not in hints]
    inferred = _inferred(typed.select(*[col(c) for c in rest])) if rest else None
    new = {f.name: f.dataType for f in inferred.schema.fields if not isinstance(f.dataType, T.StringType)} if inferred is not None else {}
    out = typed.withColumns({c: F.trim(col(c)).cast(t) for c, t in new.items()}) if new else typed
    return _chunks(out, chunksize) if chunksize else out


def _chunks(df: DataFrame, size: int) -> Iterator[DataFrame]:
    """Frames of ``size`` consecutive rows: row ranges of a written copy, found by the sizes of its parts."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(df.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "chunks")
    sizes = sorted(tuple(r) for r in rows.groupBy("__part").agg(F.count(F.lit(1))).collect())  # one row per part
    total, starts = 0, []
    for part, n in sizes:
        starts.append((total, part))
        total += n

    def place(row: int) -> tuple[int, int]:
        first, part = max((s for s in starts if s[0] <= row), default=(0, 0))
        return part, row - first

    for a in range(0, total, size):
        (p, x), (q, y) = place(a), place(min(a + size, total) - 1)
        after = (F.col("__part") > p) | ((F.col("__part") == p) & (F.col("__at") >= x))
        until = (F.col("__part") < q) | ((F.col("__part") == q) & (F.col("__at") <= y))
        yield rows.where(after & until).drop("__part", "__at")


def load_parquet(path: str, spark: SparkSession | None = None, logger: logging.Logger | None = None) -> DataFrame:
    say(logger, f"reading {path} as Parquet")
    return (spark or _spark()).read.parquet(path)


def load_csv_polars(path: str, logger: logging.Logger | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The second engine's name for ``load_csv``: there is one engine here, and it gives the same rows."""
    return load_csv(path, logger=logger, spark=spark)


def load_parquet_polars(path: str, logger: logging.Logger | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The second engine's name for ``load_parquet``."""
    return load_parquet(path, spark, logger)


def cache_key(path: str, type_map: dict[str, list[str]] | None = None, spark: SparkSession | None = None) -> str:
    """Twelve hexadecimal digits that change with the file's path, size and time, and with the types asked for."""
    fs, p = _hadoop(spark or _spark(), path)
    status = fs.getFileStatus(p)
    said = {"path": str(status.getPath()), "size": status.getLen(), "mtime": status.getModificationTime(), "types": {str(k): sorted(v) for k, v in (type_map or {}).items()}}
    return hashlib.sha1(json.dumps(said, sort_keys=True).encode()).hexdigest()[:12]


def load_dataset(
    path: str, engine: str = "spark", enable_logging: bool = False, type_map: dict[str, list[str]] | None = None, use_dtype_hints: bool = True,
    cache: bool = False, cache_dir: str | None = None, spark: SparkSession | None = None, fetch_format: str = "relation",
) -> Any:
    """Load ``.csv`` or ``.parquet``. ``engine`` names are accepted as such; there is one engine.

    ``cache`` keeps a Parquet copy in ``cache_dir`` (default: beside the file), found again by
    ``cache_key``. ``fetch_format``: "relation" (lazy frame), "arrow" or "pandas" (collected).
    """
    spark = spark or _spark()
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    kind = _suffix(path)
    if kind not in (".csv", ".parquet"):
        raise ValueError(f"only .csv and .parquet files are supported: {path}")
    logger = get_logger(enabled=enable_logging)
    held = None
    if cache:
        folder, _, name = path.rstrip("/").rpartition("/")
        held = f"{cache_dir or f'{folder}/.sparkscrub_cache' if folder else cache_dir or '.sparkscrub_cache'}/{name.rsplit('.', 1)[0]}.optimized.{cache_key(path, type_map, spark)}.parquet"
        fs, p = _hadoop(spark, held + "/_SUCCESS")
        if fs.exists(p):
            return _fetched(load_parquet(held, spark, logger), fetch_format)
    if kind == ".csv":
        df = load_csv(path, type_map=type_map, use_dtype_hints=use_dtype_hints, logger=logger, spark=spark)
    else:
        df = load_parquet(path, spark, logger)
        if type_map and use_dtype_hints:
            df = _typed(df, schema_for_types(df.columns, type_map))
    if held:
        try:
            df.write.mode("overwrite").parquet(held)
            df = load_parquet(held, spark)
        except Exception as e:  # a cache that cannot be written is no reason not to load
            log.warning("cache not written: %s", e)
    return _fetched(df, fetch_format)


def _fetched(df: DataFrame, fetch_format: str) -> Any:
    if fetch_format not in ("relation", "arrow", "pandas"):
        raise ValueError("fetch_format must be relation, arrow or pandas")
    return df if fetch_format == "relation" else df.toArrow() if fetch_format == "arrow" else df.toPandas()


def estimate_csv_memory(path: str, sample_rows: int = 50_000, spark: SparkSession | None = None) -> float:
    """Estimated MB of a CSV file when loaded: bytes a row, of a sample, times rows, which is its size; 0 where a sample has no row."""
    spark = spark or _spark()
    if _raw_csv(path, spark, False).limit(sample_rows).isEmpty():
        return 0.0
    fs, p = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength() / 2**20


def convert_to_parquet(path: str, out: str, engine: str = "duckdb", enable_logging: bool = False, spark: SparkSession | None = None, multi_line: bool | None = None) -> str:
    """CSV to Parquet with inferred types. Short rows are padded with nulls, rows with too many cells are dropped.

    ``multi_line`` as for ``load_csv``.
    """
    if engine not in ("duckdb", "spark"):
        raise ValueError("engine must be 'spark' (or its alias 'duckdb')")
    spark = spark or _spark()
    multi_line = spans_lines(path, spark) if multi_line is None else multi_line
    head = _raw_csv(path, spark, multi_line).schema
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in head.fields], T.StructField("__bad", T.StringType())])
    raw = _raw_csv(path, spark, multi_line, schema)
    cells = F.size(F.split(F.regexp_replace("__bad", r'"(?:[^"]|"")*"', ""), ","))
    good = raw.where(F.col("__bad").isNull() | (cells <= len(head.fields))).drop("__bad")
    _inferred(_na_to_null(good)).write.mode("overwrite").parquet(out)
    say(get_logger(enabled=enable_logging), f"wrote {out}")
    return str(out)


def convert_to_parquet_optimized(
    path: str, out: str, compression: str = "snappy", chunksize: int = 1_000_000, enable_logging: bool = False, engine: str = "spark", spark: SparkSession | None = None,
) -> str:
    """CSV to Parquet with the narrowest types: one pass for ranges, one that casts and writes.

    ``chunksize`` has no meaning here (partitions are the chunks) and is accepted as such.
    """
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}")
    if compression == "brotli":
        raise ValueError("this Spark has no brotli codec; choose snappy, zstd, gzip, lz4 or none")
    df = optimize_dataset(load_csv(path, spark=spark or _spark()), enable_logging, for_parquet=True)
    df.write.mode("overwrite").option("compression", compression).parquet(out)
    return str(out)
