"""Text cleaning as column functions. Null stays null."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: entities that are decoded without leaving the JVM; ``&amp;`` comes last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
#: Fixed: street abbreviations and what they stand for, in the order in which they are applied.
ABBREVIATIONS = [
    ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"),
    ("rd", "road"), ("ct", "court"), ("pl", "place"), ("apt", "apartment"),
]


def strip_whitespace(c: Column) -> Column:
    """Trim, and fold runs of (Unicode) white space into one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def titlecase(c: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))), "")


def remove_html(c: Column) -> Column:
    """Decode the common entities, then drop tags, escaped ones too, and trim."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return _strip(F.regexp_replace(c, "<[^>]+>", ""))


@F.udf(T.StringType(), useArrow=True)
def unescape_exact(s):
    """Every named and numeric entity; Arrow batches."""
    import html

    return None if s is None else html.unescape(s)


def remove_html_exact(c: Column) -> Column:
    return _strip(F.regexp_replace(unescape_exact(c), "<[^>]+>", ""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_special_chars(c: Column, keep_chars: str = "") -> Column:
    """Only ASCII letters, digits, white space and ``keep_chars`` stay."""
    keep = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in keep_chars)
    return F.regexp_replace(c, f"(?U)[^a-zA-Z0-9\\s{keep}]", "")


def remove_urls(c: Column) -> Column:
    return _strip(F.regexp_replace(c, r"https?://\S+|www\.\S+", ""))


def remove_emails(c: Column) -> Column:
    return _strip(F.regexp_replace(c, r"\S+@\S+\.\S+", ""))


@F.pandas_udf(T.StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    """NFKD; no built-in function does it."""
    import unicodedata

    return s.map(lambda v: unicodedata.normalize("NFKD", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def remove_accents_exact(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda v: "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)), na_action="ignore")


def _latin() -> tuple[str, str]:
    """Accented letters whose decomposition is one base letter and marks: from a rule, not a list."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def remove_accents(c: Column) -> Column:
    """Accents of Latin letters, composed or combining, inside the JVM."""
    return F.regexp_replace(F.translate(c, *_latin()), r"\p{M}+", "")


def clean_name(c: Column) -> Column:
    return remove_accents(titlecase(strip_whitespace(c)))


def clean_address(c: Column) -> Column:
    c = F.lower(strip_whitespace(c))
    for short, full in ABBREVIATIONS:
        c = F.regexp_replace(c, rf"\b{short}\.?\b", full)
    return c


def clean_description(c: Column) -> Column:
    return F.lower(remove_urls(remove_html(strip_whitespace(c))))


def clean_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(strip_whitespace(c)), r"(?U)\s+", "")


def clean_email(c: Column) -> Column:
    """Lower case and trimmed; null where there is no ``@``."""
    v = F.lower(_strip(c))
    return F.when(F.instr(v, "@") > 0, v)


def clean_phone(c: Column, format_str: str = "({0}) {1}-{2}") -> Column:
    """The last ten digits in ``format_str``; null for fewer."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    to = re.sub(r"\{(\d)\}", lambda m: f"${int(m[1]) + 1}", format_str.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(F.length(digits) >= 10, F.regexp_replace(F.right(digits, F.lit(10)), r"^(\d{3})(\d{3})(\d{4})$", to))
