"""Text cleaning of whole columns."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions import text as fx
from sparkscrub.functions.missing import col, text_columns
from sparkscrub.operators.base import BaseTransformer, table
from sparkscrub.plans.stats import collect_stats


@dataclass
class TextCleaningResult:
    column: str
    transformations: str
    rows_modified: int


#: Per kind of column: its cleaner and the names of the steps, as reports give them.
KINDS = {
    "name": (fx.clean_name, ["strip_whitespace", "titlecase", "remove_accents"]),
    "address": (fx.clean_address, ["strip_whitespace", "lowercase", "expand_abbreviations"]),
    "description": (fx.clean_description, ["strip_whitespace", "remove_html", "remove_urls", "lowercase"]),
    "code": (fx.clean_code, ["strip_whitespace", "uppercase", "remove_spaces"]),
    "email": (fx.clean_email, ["strip_whitespace", "lowercase", "validate"]),
    "phone": (fx.clean_phone, ["extract_digits", "format"]),
}


class TextCleaner(BaseTransformer):
    """Clean text columns by kind. The frame given is never changed; counts are null-safe."""

    strip_whitespace, titlecase = staticmethod(fx.strip_whitespace), staticmethod(fx.titlecase)
    lowercase, uppercase = staticmethod(F.lower), staticmethod(F.upper)
    remove_html, remove_special_chars = staticmethod(fx.remove_html), staticmethod(fx.remove_special_chars)
    remove_urls, remove_emails_from_text = staticmethod(fx.remove_urls), staticmethod(fx.remove_emails)
    normalize_unicode, remove_accents = staticmethod(fx.normalize_unicode), staticmethod(fx.remove_accents)

    def __init__(self) -> None:
        self._steps: list[tuple[DataFrame, str, Column, list[str], bool]] = []

    def _apply(self, df: DataFrame, new: dict[str, tuple[Column, list[str]]], always: bool = True) -> DataFrame:
        self._steps += [(df, c, expr, steps, always) for c, (expr, steps) in new.items()]
        return df.withColumns({c: expr for c, (expr, _) in new.items()}) if new else df

    def _one(self, df: DataFrame, c: str, kind: str) -> DataFrame:
        return self._apply(df, {c: (KINDS[kind][0](col(c)), KINDS[kind][1])})

    def clean_names(self, df: DataFrame, c: str) -> DataFrame:
        return self._one(df, c, "name")

    def clean_addresses(self, df: DataFrame, c: str) -> DataFrame:
        return self._one(df, c, "address")

    def clean_descriptions(self, df: DataFrame, c: str) -> DataFrame:
        return self._one(df, c, "description")

    def clean_codes(self, df: DataFrame, c: str) -> DataFrame:
        return self._one(df, c, "code")

    def clean_emails(self, df: DataFrame, c: str) -> DataFrame:
        return self._one(df, c, "email")

    def clean_phones(self, df: DataFrame, c: str, format_str: str = "({0}) {1}-{2}") -> DataFrame:
        return self._apply(df, {c: (fx.clean_phone(col(c), format_str), KINDS["phone"][1])})

    def clean_all(self, df: DataFrame, column_types: dict[str, str]) -> DataFrame:
        """All columns in one projection; unknown columns and kinds are ignored."""
        new = {c: (KINDS[k][0](col(c)), KINDS[k][1]) for c, k in column_types.items() if c in df.columns and k in KINDS}
        return self._apply(df, new)

    def transform(self, df: DataFrame) -> DataFrame:
        """Fold white space in every text column."""
        return self._apply(df, {c: (fx.strip_whitespace(col(c)), ["strip_whitespace"]) for c in text_columns(df)}, always=False)

    def get_report(self) -> pd.DataFrame:
        rows, at = [], 0
        while at < len(self._steps):
            df, end = self._steps[at][0], at
            while end < len(self._steps) and self._steps[end][0] is df:
                end += 1
            part = self._steps[at:end]
            n = collect_stats(df, {str(i): F.count_if(~col(c).eqNullSafe(expr)) for i, (_, c, expr, _, _) in enumerate(part)})
            rows += [TextCleaningResult(c, ", ".join(steps), n[str(i)]).__dict__ for i, (_, c, _, steps, always) in enumerate(part) if always or n[str(i)]]
            at = end
        return table(rows, ["column", "transformations", "rows_modified"])
