"""Retry state per page while attempts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import failures
from sitequarry.schemas import RETRY_COUNT

PAGE = ["domain", "route", "page"]


def retry_state(responses: DataFrame, retry_count: int = RETRY_COUNT) -> DataFrame:
    """Per page the first successful attempt within the limit and the last attempt, of a table or of one batch.

    It is combined before the shuffle and needs no Python; the batch definition is pages.resolve_retries.
    """
    good = failures.is_success(F.col("status"), F.col("error")) & (F.col("attempt") <= retry_count)
    return responses.where("kind = 'list' AND page >= 1").groupBy(*PAGE).agg(
        F.min(F.when(good, F.col("attempt"))).alias("attempt"), F.max("attempt").alias("last_attempt")
    )


def merge_state(updates: DataFrame) -> DataFrame:
    """One row per page out of the states of all batches; both values can be merged in any order, any number of times."""
    return updates.groupBy(*PAGE).agg(
        F.min("attempt").alias("attempt"), F.max("last_attempt").alias("last_attempt")
    )


def settled(state: DataFrame, retry_count: int = RETRY_COUNT) -> DataFrame:
    """Pages that need no further attempt: succeeded, or failed at the limit."""
    outcome = F.when(F.col("attempt").isNotNull(), "success").when(F.col("last_attempt") >= retry_count, "failed")
    return state.withColumn("outcome", outcome).where("outcome IS NOT NULL")
