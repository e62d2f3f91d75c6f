"""Resumable ingestion of arriving capture files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_batches(
    stream: DataFrame, out: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame] | None = None, once: bool = True
) -> None:
    """Save each micro-batch, or what `reduce` makes of it, in a folder of its own.

    No state is kept and no watermark is set, so rows of any age count, in whatever order they arrive. A repeated batch
    replaces its folder, and a restart with the same checkpoint goes on behind the last batch. With `once` all
    files present are taken and the call returns; else it runs until stopped.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        (reduce(batch) if reduce else batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def distinct_arrivals(saved: DataFrame, keys: Sequence[str], event_time: str = "ts") -> DataFrame:
    """Of all saved rows the earliest under each key; ties go to the smallest of the other columns."""
    others = [c for c in saved.columns if c not in (*keys, event_time, "batch")]
    first = saved.groupBy(*keys).agg(F.min(F.struct(event_time, *others)).alias("first"))
    return first.select(*keys, *[F.col("first")[c].alias(c) for c in (event_time, *others)])
