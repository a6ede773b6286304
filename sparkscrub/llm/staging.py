"""Tables in the folder that driver and executors share, and a bounded native row filter.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (any Hadoop file system).
Only where that setting is missing (tests, a laptop) a local folder is used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one block made by ``bitmap_construct_agg`` (fixed by Spark).
BLOCK_BITS = 32768

#: Gateway, file system and path of each folder; the file system is held, so that a session that was stopped is no obstacle.
_made: list[tuple[Any, Any, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; where it is unset, a local one, if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkscrub-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkscrub/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    _made.append((jvm, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(jvm: Any, fs: Any, path: str) -> None:
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def unstage(df: DataFrame, label: str) -> None:
    """Delete the staged table ``df`` (``label`` as given to ``stage``), which nothing unfinished may read."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for made in [m for m in _made if m[2].rpartition("/")[2] == path.rpartition("/")[2] and f"/{label}-" in path]:
            _made.remove(made)
            _delete(*made)


@contextlib.contextmanager
def released(keep: str | None = None) -> Iterator[None]:
    """Delete what is staged inside when the block ends; results made inside must be written by then. ``keep``: a label that stays."""
    before = {path for _, _, path in _made}
    try:
        yield
    finally:
        for made in [m for m in _made if m[2] not in before and not (keep and f"/{keep}-" in m[2])]:
            _made.remove(made)
            _delete(*made)


def drop_all() -> None:
    """Delete every staged table of this driver; for callers that run many operators."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the gateway may be gone at exit; the folder is then the cluster's to clean
            return


atexit.register(drop_all)


def small_batches(spark: SparkSession, rows: int = 500, size: int = 32 << 20) -> None:
    """Hold Arrow batches to ``rows`` rows and about ``size`` bytes, so that very long texts fit in a Python worker.

    Frames are lazy, so the setting has to hold when a caller runs them: it stays, and is only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        with contextlib.suppress(Exception):  # older versions know no bound of bytes
            if not 0 < int(spark.conf.get(key).lower().removesuffix("b")) <= most:
                spark.conf.set(key, str(most))


#: Bits for each wanted key, and bounds of a bitmap: 128 kB to 32 MB are broadcast, whatever the data.
BITS_A_KEY, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28


def marked(df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]) -> DataFrame:
    """``df`` with ``__maybe``: false only where the keys are surely not among ``wanted``."""
    n, bits = wanted.count(), MIN_BITS
    while bits < BITS_A_KEY * n and bits < MAX_BITS:
        bits *= 2
    slot = lambda ks: F.pmod(F.xxhash64(*ks), F.lit(bits))
    block = lambda s: F.shiftright(s, 15).cast("int")
    blocks = wanted.select(slot(wanted_keys).alias("s")).select(block(F.col("s")).alias("__block"), (F.col("s") % BLOCK_BITS).alias("__pos"))
    blocks = blocks.groupBy("__block").agg(F.bitmap_construct_agg("__pos").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__slot") % BLOCK_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("__slot") % 8).cast("int")) == 1
    rows = df.withColumn("__slot", slot(keys)).withColumn("__block", block(F.col("__slot")))
    out = rows.join(F.broadcast(blocks), "__block", "left").withColumn("__maybe", F.coalesce(hit, F.lit(False)))
    return out.drop("__block", "__slot", "__bits")


def maybe_in(df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]) -> DataFrame:
    """Rows of ``df`` whose keys may be among ``wanted`` (a staged table): none is lost, some may be surplus.

    A bitmap of bounded size is broadcast, so that a later exact join moves few rows. With more keys
    than it was made for it lets more rows through; results stay the same.
    """
    return marked(df, keys, wanted, wanted_keys).where("__maybe").drop("__maybe")


def drop_rows(df: DataFrame, keys: list[Column], gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``df`` without the rows whose keys are in ``gone``, and with one row only of each key in ``once``.

    Keys are compared column by column; nulls are equal. Only rows that a bitmap of bounded size cannot
    clear are shuffled and joined; the others stay where they were read. Keys must have the types of the
    columns of ``gone`` and ``once``, which share no key. Of the rows of a key in ``once`` that with the
    smallest hash of its columns stays: an aggregate, which combines before the shuffle, picks it.
    """
    names = [f"__gone{i}" for i in range(len(keys))]
    listed = gone.distinct().withColumn("__once", F.lit(False))
    if once is not None:
        listed = listed.unionByName(once.distinct().toDF(*gone.columns).withColumn("__once", F.lit(True)))
    listed = stage(listed, "gone").toDF(*names, "__once")
    rows = marked(df.withColumns({f"__key{i}": k for i, k in enumerate(keys)}), keys, listed, [F.col(c) for c in names])
    same = [F.col(f"__key{i}").eqNullSafe(F.col(c)) for i, c in enumerate(names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    clear = rows.where("not __maybe").select(*columns)
    if once is None:
        return clear.unionByName(rows.where("__maybe").join(listed, on, "left_anti").select(*columns))
    rest = rows.where("__maybe").join(listed, on, "left").where("__once is null or __once")
    plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    order = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in plain])
    picked = rest.where("__once").groupBy(*[F.col(c) for c in names]).agg(F.min_by(F.struct(*columns), order).alias("__row"))
    picked = picked.select(*[F.col("__row")[c].alias(c) for c in df.columns])
    return clear.unionByName(rest.where("__once is null").select(*columns)).unionByName(picked)
