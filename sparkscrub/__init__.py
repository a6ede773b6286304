"""sparkscrub: reviewable cleaning, profiling and preparation of tabular data on Spark."""

from sparkscrub.logs import get_logger, log
from sparkscrub.operators.base import BaseTransformer, FitTransformer
from sparkscrub.operators.categories import CategoryStandardizer
from sparkscrub.operators.duplicates import DuplicateHandler
from sparkscrub.operators.features import DateFeatureExtractor, FeatureScaler, FeatureSelector, NumericalTransformer
from sparkscrub.operators.missing import MissingIndicator, MissingValueHandler, add_missing_indicators, drop_na, fill_na
from sparkscrub.operators.outliers import OutlierHandler
from sparkscrub.operators.pipeline import AutomatedCleaner
from sparkscrub.operators.profiling import dataset_overview, profile_dataframe
from sparkscrub.operators.quality import check_quality, detect_suspicious, quality_score
from sparkscrub.operators.schema import analyze_optimization, apply_optimization, optimization_report, optimize_dataset
from sparkscrub.operators.standardize import DataStandardizer
from sparkscrub.operators.text import TextCleaner
from sparkscrub.sources.io import convert_to_parquet, convert_to_parquet_optimized, estimate_csv_memory, load_csv, load_csv_polars, load_dataset, load_parquet, load_parquet_polars

__version__ = "0.1.0"
__all__ = [
    "AutomatedCleaner", "BaseTransformer", "CategoryStandardizer", "DataStandardizer", "DateFeatureExtractor", "DuplicateHandler", "FeatureScaler",
    "FeatureSelector", "FitTransformer", "MissingIndicator", "MissingValueHandler", "NumericalTransformer", "OutlierHandler", "TextCleaner",
    "add_missing_indicators", "analyze_optimization", "apply_optimization", "check_quality", "convert_to_parquet", "convert_to_parquet_optimized",
    "dataset_overview", "detect_suspicious", "drop_na", "estimate_csv_memory", "fill_na", "get_logger", "load_csv", "load_csv_polars", "load_dataset", "load_parquet", "load_parquet_polars", "log", "optimization_report", "optimize_dataset",
    "profile_dataframe", "quality_score",
]
