"""Bounded samples of labelled rows for fitting, and the split that keeps rows out of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one text that a sample for fitting holds at most, which bounds the driver's memory; of longer texts
#: PARTS parts, evenly spread over the whole text, stand for it.
SAMPLE_BYTES, PARTS = 64_000, 16


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """True for rows that labels must not be learnt from: crc32(id as text) mod ``mod`` = ``rest``. Null ids: false."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def shortened(text: Column, most: int, parts: int = PARTS) -> Column:
    """A text's bytes, or ``parts`` evenly spread parts of it where it has more than ``most`` bytes. Null is empty."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    size = most // parts
    at = lambda k: (F.octet_length(raw) - size).cast("double") * (k / (parts - 1))
    some = F.concat(*[F.substring(raw, at(k).cast("int") + 1, F.lit(size)) for k in range(parts)])
    return F.when(F.octet_length(raw) <= most, raw).otherwise(some)


def sample_texts(docs: DataFrame, chosen: DataFrame, rows: int, id_col: str, text_col: str, extra: list[str], most: int = SAMPLE_BYTES) -> pd.DataFrame:
    """Texts of at most ``rows`` rows of ``chosen`` (id and ``extra``), in the order of a hash of the id, each of at most ``most`` bytes."""
    few = chosen.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows)
    few = few.withColumnsRenamed({c: f"__{c}" for c in few.columns})
    texts = docs.select(id_col, text_col)
    found = texts.join(F.broadcast(few), texts[id_col] == few[f"__{id_col}"])  # at most ``rows`` ids
    out = found.select(F.col(id_col).alias("id"), shortened(F.col(text_col), most).alias("text"), *[F.col(f"__{c}").alias(c) for c in extra])
    return out.groupBy("id").agg(F.min(F.struct("text", *extra)).alias("s")).select("id", "s.*").toPandas().sort_values("id", ignore_index=True)
