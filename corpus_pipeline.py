"""The corpus pipeline: five stages, each by an operator of sparkscrub.llm over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, which are written as Parquet
and read again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkscrub.llm.decontaminate import drop_contaminated
from sparkscrub.llm.exact_dedup import drop_exact_duplicates
from sparkscrub.llm.mixing import taken_documents
from sparkscrub.llm.near_dedup import drop_near_duplicates
from sparkscrub.llm.quality import keep_quality
from sparkscrub.llm.staging import released, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    Null texts count as empty ones; equal texts go or stay together; an empty table stays empty.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, of the smallest id; null ids come last.

    Of repeated rows one stays; null and empty texts are one group; an empty table stays empty.
    """
    return drop_exact_duplicates(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: shingles of five words, similarity 0.8 or more.

    Texts without words are in no group and stay; rows without ids are judged by their texts; an empty table stays empty.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark.

    Texts without words stay, rows without ids are judged by their texts; without items nothing goes.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to target weights: documents taken, with size, source_size, target and taken.

    A null source is a source; texts without words are not taken; an empty table stays empty.
    """
    return taken_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the first stage (a trained network); tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, with a written table between each two; what a stage staged goes when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with released(keep=f"pipeline-{name}"):
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
