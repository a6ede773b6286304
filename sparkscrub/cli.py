"""Command lines: optimise or convert a file, and profile one."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from sparkscrub.operators.profiling import dataset_overview, profile_dataframe
from sparkscrub.operators.schema import optimize_dataset
from sparkscrub.sources.io import CODECS, ENGINES, convert_to_parquet, convert_to_parquet_optimized, load_dataset


def optimize_main(argv: Sequence[str] | None = None) -> int:
    """``path [--to-parquet OUT] [--optimize]``: convert, or load and optimise."""
    p = argparse.ArgumentParser(prog="sparkscrub-optimize", description="Convert CSV to Parquet or optimise column types.")
    p.add_argument("path")
    p.add_argument("--to-parquet", metavar="OUT")
    p.add_argument("--optimize", action="store_true")
    p.add_argument("--engine", choices=ENGINES, default="spark")
    p.add_argument("--compression", choices=[c for c in CODECS if c != "brotli"], default="snappy")
    p.add_argument("--chunksize", type=int, default=1_000_000)
    p.add_argument("--log", action="store_true")
    a = p.parse_args(argv)
    if a.to_parquet and a.optimize:
        print("wrote", convert_to_parquet_optimized(a.path, a.to_parquet, a.compression, a.chunksize, a.log, a.engine))
    elif a.to_parquet:
        print("wrote", convert_to_parquet(a.path, a.to_parquet, enable_logging=a.log))
    else:
        optimize_dataset(load_dataset(a.path, a.engine, a.log), a.log).printSchema()
    return 0


def profile_main(argv: Sequence[str] | None = None) -> int:
    """``path [--fast] [--sample N]``: print a profile and the twenty largest columns."""
    p = argparse.ArgumentParser(prog="sparkscrub-profile", description="Profile a CSV or Parquet file.")
    p.add_argument("path")
    p.add_argument("--fast", action="store_true")
    p.add_argument("--sample", type=int)
    p.add_argument("--engine", choices=ENGINES, default="spark")
    a = p.parse_args(argv)
    df = load_dataset(a.path, a.engine)
    if a.sample and a.path.endswith(".csv"):
        df = df.limit(a.sample)
    profile = profile_dataframe(df, deep=not a.fast, include_numeric_summary=not a.fast, approx=a.fast)
    print(f"{profile['rows']} rows, {profile['columns']} columns, {profile['memory_mb']:.2f} MB")
    print(dataset_overview(df, deep=not a.fast, approx=a.fast).head(20).to_string(index=False))
    return 0
