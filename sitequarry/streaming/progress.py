"""Progress of transfers while they run: counts per outcome and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counts(transfers: DataFrame, window: Column) -> DataFrame:
    return (
        transfers.groupBy(window.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("done"),
            F.count_if(F.col("success")).alias("succeeded"),
            F.count_if(~F.col("success")).alias("failed"),
            F.sum("bytes").alias("bytes"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "done", "succeeded", "failed", "bytes",
        )
    )


def windowed_progress(transfers: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per tumbling window, or sliding with `slide`, of a table or of one batch of a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _counts(transfers, window)


def session_slots(transfers: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """Counts per site and slot as long as the gap, of a table or of one batch of a stream.

    Rows of one slot always share a burst.
    """
    return transfers.groupBy("domain", F.window("ts", f"{gap_minutes} minutes")["start"].alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("done"), F.count_if(~F.col("success")).alias("failed")
    )


def session_progress(transfers: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """Counts per burst of activity of a site; a pause of more than the gap parts two bursts."""
    return merge_sessions(session_slots(transfers, gap_minutes), gap_minutes)


def merge_sessions(slots: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """Bursts out of the slots of all batches: only slots are put in order, however busy a site is."""
    slots = slots.groupBy("domain", "slot").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("done").alias("done"), F.sum("failed").alias("failed")
    )
    order = Window.partitionBy("domain").orderBy("first")
    pause = F.col("first") - F.lag("last").over(order)
    numbered = slots.withColumn(
        "fresh", F.when(pause <= F.expr(f"INTERVAL '{gap_minutes}' MINUTE"), 0).otherwise(1)
    ).withColumn("burst", F.sum("fresh").over(order))
    return (
        numbered.groupBy("domain", "burst")
        .agg(
            F.min("first").alias("window_start"), (F.max("last") + F.expr(f"INTERVAL '{gap_minutes}' MINUTE")).alias("window_end"),
            F.sum("done").alias("done"), F.sum("failed").alias("failed"),
        )
        .drop("burst")
    )


def merge_progress(counts: DataFrame) -> DataFrame:
    """Counts per window over the partial counts of all batches."""
    names = ["done", "succeeded", "failed", "bytes"]
    return counts.groupBy("window_start", "window_end").agg(*[F.sum(n).alias(n) for n in names])
