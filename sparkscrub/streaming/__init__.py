"""Fitted models on streams: they are expressions over literals, hence legal on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def clean_stream(source: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply ``steps`` (such as ``fitted.transform``) to each micro-batch and append it as Parquet.

    Steps may run jobs of their own (counts), so they get whole micro-batches; a batch that is
    repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        for step in steps:
            batch = step(batch)
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
