"""Exact de-duplication through a log-structured merge index of text digests.

* Memtables: each scan task holds ``digest -> (kept id, count, text)`` up to a number of rows and
  bytes, compares the bytes of every hit, and flushes a run sorted by digest (level 0).
* Compaction deals the runs out by ranges of digests and merges them in digest order into one sorted run
  (level 1), keeping one identifier: the smallest (``keep="min"``) or, by the same merge with the order
  turned round, the largest (``keep="max"``).
* Digests that came from more than one run are hits between runs: the texts of the runs' kept rows
  are fetched (through a bounded filter, so that other texts do not move) and compared as bytes.
  Different texts with one SHA-256 stop the job: two texts are never merged silently.
* Filters: a probe tests each row against a bitmap of bounded size first. What it clears is answered
  without a join; only the rest is joined with the sorted run.

A hot text reaches the merge once per memtable, whatever the number of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.llm.staging import drop_rows, marked, maybe_in, small_batches, stage

RUN_SCHEMA = "run string, digest binary, keep_id long, n long"
LEVEL_SCHEMA = "digest binary, keep_id long, group_size long, runs long"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _better(keep: str):
    def better(a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if keep == "max" else min(a, b)

    return better


def _merge(keep: str):
    """Rows sorted by digest, of any number of runs -> one row of each digest, in order; one group is held at a time."""
    better = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list | None = None
        for batch in batches:
            done = []
            for digest, keep_id, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at is not None and at[0] == digest:
                    at = [digest, better(at[1], keep_id), at[2] + n, at[3] + 1]
                else:
                    if at is not None:
                        done.append(at)
                    at = [digest, keep_id, n, 1]
            yield _level(done)
        if at is not None:
            yield _level([at])

    return run


def _level(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["digest", "keep_id", "group_size", "runs"])


def _memtables(keep: str, max_rows: int, max_bytes: int):
    better = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, table = TaskContext.get().partitionId(), 0, 0, {}

        def flush() -> pa.RecordBatch:
            rows = sorted(table.items())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{seq}"] * len(rows), pa.string()),
                    pa.array([d for d, _ in rows], pa.binary()),
                    pa.array([e[0] for _, e in rows], pa.int64()),
                    pa.array([e[1] for _, e in rows], pa.int64()),
                ],
                ["run", "digest", "keep_id", "n"],
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                text = text.as_py() or b""
                digest = hashlib.sha256(text).digest()
                entry = table.get(digest)
                if entry is None:
                    table[digest] = [doc_id, 1, text]
                    held += len(text)
                elif entry[2] != text:
                    raise ValueError(f"two texts have the SHA-256 {digest.hex()}")
                else:
                    entry[0] = better(entry[0], doc_id)
                    entry[1] += 1
                if len(table) >= max_rows or held >= max_bytes:
                    yield flush()
                    seq, held, table = seq + 1, 0, {}
        if table:
            yield flush()

    return run


class LsmDigestIndex:
    """Index ``digest -> (keep_id, group_size)`` over every row that was flushed into it.

    ``keep``: "min" or "max". Null ids lose to any other id. ``memtable_rows`` and
    ``memtable_bytes`` bound the memory of a task.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", memtable_rows: int = 50_000, memtable_bytes: int = 48 << 20):
        if keep not in ("min", "max"):
            raise ValueError("keep must be 'min' or 'max'")
        self.spark, self.keep = spark, keep
        self.memtable_rows, self.memtable_bytes = memtable_rows, memtable_bytes
        self.level0: list[DataFrame] = []
        self.level1: DataFrame | None = None
        self.sources: list[DataFrame] = []

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Pass a batch of rows through memtables into sorted runs of level 0."""
        small_batches(self.spark)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        runs = rows.mapInArrow(_memtables(self.keep, self.memtable_rows, self.memtable_bytes), RUN_SCHEMA)
        self.level0.append(stage(runs, "lsm-runs"))
        self.sources.append(rows)

    def compact(self) -> DataFrame:
        """Merge every run into level 1 after the byte check of hits between runs."""
        runs = self.level0 + ([self.level1.select(F.lit("level1").alias("run"), "digest", "keep_id", F.col("group_size").alias("n"))] if self.level1 is not None else [])
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        in_order = both.select("digest", "keep_id", "n").repartitionByRange("digest").sortWithinPartitions("digest")
        level1 = stage(in_order.mapInArrow(_merge(self.keep), LEVEL_SCHEMA), "lsm-level1")
        self._verify(both, level1.where("runs > 1").select("digest"))
        self.level1, self.level0 = level1.select("digest", "keep_id", "group_size"), []
        return self.level1

    def _verify(self, runs: DataFrame, hits: DataFrame) -> None:
        wanted = runs.join(hits, "digest", "left_semi").select("digest", F.col("keep_id").alias("id"))
        wanted = stage(wanted.distinct(), "lsm-hits")
        texts = self.sources[0]
        for s in self.sources[1:]:
            texts = texts.unionByName(s)
        texts = maybe_in(texts, [F.col("id")], wanted, [F.col("id")])
        texts = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
        near = (texts["digest"] == wanted["digest"]) & texts["id"].eqNullSafe(wanted["id"])
        found = texts.join(wanted, near, "left_semi").select("digest", "text")
        bad = found.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").limit(1)
        if row := bad.collect():
            raise ValueError(f"two texts have the SHA-256 {bytes(row[0].digest).hex()}")

    def probe(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", own: bool = False) -> DataFrame:
        """``docs`` with keep_id, group_size and text_digest; null keep_id where a text is not indexed.

        ``own``: these are the rows that were flushed, all of them. Then only digests with several rows are
        looked up; a row that the filter clears is its own group. Columns of ``docs`` with these names are replaced.
        """
        docs = docs.drop("keep_id", "group_size", "text_digest")
        index = self.level1.where("group_size > 1") if own else self.level1
        rows = marked(docs.withColumn("text_digest", text_digest(F.col(text_col))), [F.col("text_digest")], index, [F.col("digest")])
        joined = rows.where("__maybe").join(index.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
        alone = F.col(id_col).cast("long") if own else F.lit(None).cast("long")
        one = F.lit(1 if own else None).cast("long")
        clear = rows.where("not __maybe").withColumn("keep_id", alone).withColumn("group_size", one)
        if own:
            joined = joined.withColumn("keep_id", F.when(F.col("group_size").isNull(), alone).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", one))
        return clear.unionByName(joined).drop("__maybe")

    def unseen(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Rows whose text is surely not in level 1, told by the filter alone: no run is joined."""
        return marked(docs, [text_digest(F.col(text_col))], self.level1, [F.col("digest")]).where("not __maybe").drop("__maybe")


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, text_digest and ``kept``.

    Texts are equal when their bytes are; a null text counts as empty; an empty text is a text
    like any other. Of repeated rows with one id and text, all are marked as kept: an id is the
    unit that stays. If all ids of a group are null, its rows are kept. An empty table gives an
    empty result.
    """
    index = LsmDigestIndex(docs.sparkSession, keep)
    index.flush(docs, id_col, text_col)
    index.compact()
    return index.probe(docs, text_col, id_col, own=True).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs`` as they were.

    Of repeated rows (one id, one text) one stays, and one of a group whose ids are all null; otherwise the row of
    the smallest (``keep="max"``: largest) id. Null and empty texts are one group. An empty table gives an empty result.
    """
    found = exact_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keep, "id", "text")
    several = found.where("group_size > 1").groupBy(F.col("id").cast("long").alias("id"), "text_digest").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    several = stage(several, "exact-several")
    gone, once = several.where("not kept").select("id", "text_digest"), several.where("kept and n > 1").select("id", "text_digest")
    return drop_rows(docs, [F.col(id_col).cast("long"), text_digest(F.col(text_col))], gone, once)
