"""A scratch folder for results that have to be files: under ``spark.checkpoint.dir``; a local one only where all tasks run on this machine.

Lazy frames may read what is there for as long as the driver runs, so it is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[Any, Any, str]] = []
_local: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path; what is written to it, or to it with a suffix, goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="sparkscrub-"))
        base = "file://" + _local[0]
    path = f"{base.rstrip('/')}/sparkscrub/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    # the file system is held, so that a session that was stopped is no obstacle
    _made.append((jvm, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the scratch folder and read again: what it holds no longer depends on how it was made."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Delete what this driver wrote to the scratch folder; for callers that run many queries and read none of it any more."""
    while _made:
        jvm, fs, path = _made.pop()
        try:
            for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + "*")) or []:
                fs.delete(found.getPath(), True)
        except Exception:  # the gateway may be gone at exit; the folder is then the cluster's to clean
            break
    while _local:
        shutil.rmtree(_local.pop(), ignore_errors=True)


atexit.register(drop_scratch)
