"""Sources and sinks: CSV and Parquet, a Parquet cache, and conversion."""

from sparkscrub.sources.io import convert_to_parquet, convert_to_parquet_optimized, estimate_csv_memory, load_csv, load_csv_polars, load_dataset, load_parquet, load_parquet_polars, schema_for_types

__all__ = ["convert_to_parquet", "convert_to_parquet_optimized", "estimate_csv_memory", "load_csv", "load_csv_polars", "load_dataset", "load_parquet", "load_parquet_polars", "schema_for_types"]
