"""The cleaning pipeline: twelve steps, one report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from sparkscrub.operators.categories import CategoryStandardizer
from sparkscrub.operators.duplicates import DuplicateHandler
from sparkscrub.operators.features import DateFeatureExtractor, FeatureSelector, NumericalTransformer
from sparkscrub.operators.missing import MissingIndicator, MissingValueHandler
from sparkscrub.operators.outliers import OutlierHandler
from sparkscrub.operators.quality import check_quality
from sparkscrub.operators.standardize import DataStandardizer
from sparkscrub.operators.text import TextCleaner

#: Fixed: names of steps that ``skip_steps`` knows.
STEPS = ("standardize", "date_features", "text", "categories", "duplicates", "outliers", "missing_indicators", "missing", "scaling", "selection")


class AutomatedCleaner:
    """Audit, standardise, extract dates, clean text and categories, drop duplicates, treat outliers,
    flag and impute missing values, scale, select, audit again.

    Steps are lazy between the jobs that learn something. ``persist`` holds the frame after the
    duplicate step, which most of those jobs read (memory and disk); ``close`` lets go of it.
    """

    def __init__(
        self, standardizer: DataStandardizer | None = None, missing_handler: MissingValueHandler | None = None, text_cleaner: TextCleaner | None = None,
        category_standardizer: CategoryStandardizer | None = None, duplicate_handler: DuplicateHandler | None = None, outlier_handler: OutlierHandler | None = None,
        numerical_transformer: NumericalTransformer | None = None, date_extractor: DateFeatureExtractor | None = None,
        missing_indicator: MissingIndicator | None = None, feature_selector: FeatureSelector | None = None,
        duplicate_subset: list[str] | None = None, duplicate_survivorship: str = "most_complete",
        outlier_method: str = "iqr", outlier_threshold: float = 1.5, outlier_strategy: str = "cap", outlier_columns: list[str] | None = None,
        column_types: dict[str, str] | None = None, scale_method: str | None = None, auto_transform_numerics: bool = False,
        extract_date_features: bool | list[str] = False, add_missing_indicators: bool = False, drop_low_variance: bool = False, variance_threshold: float = 0.0,
        drop_correlated: bool = False, correlation_threshold: float = 0.95, skip_steps: list[str] | None = None,
        percentile_range: tuple[float, float] = (0.01, 0.99), persist: bool = True,
    ):
        # columns cleaned as text keep their text: a phone number is no number
        self.standardizer = standardizer or DataStandardizer(skip=list(column_types or {}))
        self.missing_handler = missing_handler or MissingValueHandler()
        self.text_cleaner = text_cleaner or TextCleaner()
        self.category_standardizer = category_standardizer
        self.duplicate_handler = duplicate_handler or DuplicateHandler()
        self.outlier_handler = outlier_handler or OutlierHandler()
        self.numerical_transformer = numerical_transformer or NumericalTransformer(auto_transform=auto_transform_numerics, scaling_method=scale_method)
        features = extract_date_features if isinstance(extract_date_features, list) else ["year", "month", "day", "is_weekend"] if extract_date_features else None
        self.date_extractor = date_extractor or DateFeatureExtractor(features=features)
        self.missing_indicator = missing_indicator or MissingIndicator()
        self.feature_selector = feature_selector or FeatureSelector(variance_threshold, correlation_threshold)
        self.duplicate_subset, self.duplicate_survivorship = duplicate_subset, duplicate_survivorship
        self.outlier = {"method": outlier_method, "threshold": outlier_threshold, "percentile_range": percentile_range}
        self.outlier_strategy, self.outlier_columns, self.column_types = outlier_strategy, outlier_columns, column_types
        self.scale, self.extract_date_features, self.indicators = bool(scale_method or auto_transform_numerics), extract_date_features, add_missing_indicators
        self.select, self.skip_steps, self.persist = drop_low_variance or drop_correlated, set(skip_steps or []), persist
        self._held: DataFrame | None = None

    def close(self) -> None:
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def clean(self, df: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        """The cleaned frame, still lazy, and the report of what was done."""
        self.close()
        report: dict[str, Any] = {"initial_quality": check_quality(df)}
        first = report["initial_quality"]

        def note(key: str, step: Any) -> None:
            rows = step.get_report()
            if not rows.empty:
                report[key] = rows.to_dict("records")

        def on(name: str, wanted: Any) -> bool:
            return name not in self.skip_steps and bool(wanted)

        if on("standardize", True):
            df = self.standardizer.transform(df)
            note("type_conversions", self.standardizer)
        if on("date_features", self.extract_date_features):
            df = self.date_extractor.transform(df)
            note("date_features", self.date_extractor)
        if on("text", self.column_types):
            df = self.text_cleaner.clean_all(df, self.column_types)
            note("text_cleaning", self.text_cleaner)
        if on("categories", self.category_standardizer is not None):
            df = self.category_standardizer.transform(df)
            note("category_standardization", self.category_standardizer)
        if on("duplicates", self.duplicate_subset):
            self.duplicate_handler.find_exact(df, subset=self.duplicate_subset)
            df = self.duplicate_handler.transform(df, survivorship=self.duplicate_survivorship)
            note("duplicate_handling", self.duplicate_handler)
        if self.persist:
            df = self._held = df.persist()
        if on("outliers", self.outlier_columns):
            self.outlier_handler.detect(df, columns=self.outlier_columns, **self.outlier)
            df = self.outlier_handler.transform(df, strategy=self.outlier_strategy)
            note("outlier_handling", self.outlier_handler)
        if on("missing_indicators", self.indicators):
            df = self.missing_indicator.fit_transform(df)
            note("missing_indicators", self.missing_indicator)
        if on("missing", True):
            df = self.missing_handler.fit_transform(df)
            note("missing_value_handling", self.missing_handler)
        if on("scaling", self.scale):
            df = self.numerical_transformer.fit_transform(df)
            note("feature_scaling", self.numerical_transformer)
        if on("selection", self.select):
            df = self.feature_selector.fit_transform(df)
            note("feature_selection", self.feature_selector)
        last = report["final_quality"] = check_quality(df)
        rows = first["total_rows"]
        report["validation"] = {
            "rows_before": rows, "rows_after": last["total_rows"], "columns_before": first["total_columns"], "columns_after": last["total_columns"],
            "data_loss_pct": round((1 - last["total_rows"] / rows) * 100, 2) if rows else 0,
            "missing_before": first["total_missing_values"], "missing_after": last["total_missing_values"],
        }
        return df, report
