"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequarry.llm.common import saved


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the whole text; a null text is an empty one."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def frequent(hashed: DataFrame, winners: int = 512, counters: int = 8192) -> DataFrame:
    """Digests that may be frequent, at most `winners`.

    approx_top_k keeps a mergeable Misra-Gries summary of at most `counters` digests in each task. A digest that it
    does not report is rarer than a fixed share of the rows (a few times 1 / counters, or beyond the winners).
    """
    top = hashed.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))


def exact_dedup(docs: DataFrame, winners: int = 512, counters: int = 8192) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts that with the largest doc_id stays. Rows of frequent digests are resolved beside a broadcast
    table of at most `winners` rows whose counts and kept ids were taken over all rows; they never move. The
    others meet by digest, in groups that the summary bounds. A null doc_id is smaller than any other; where a
    whole group has none, keep_id is null and kept is true. Rows that repeat doc_id and text count
    in group_size and are all marked like one. No rows in, no rows out. Extra columns are not looked at.
    """
    hashed = saved(digests(docs), "digests")
    may = frequent(hashed, winners, counters)
    resolved = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = saved(
        hashed.join(F.broadcast(may), "text_sha256").groupBy("text_sha256").agg(*resolved).where("group_size > 1"), "winners"
    )
    of_text = Window.partitionBy("text_sha256")
    light = hashed.join(F.broadcast(heavy), "text_sha256", "left_anti").select(
        "doc_id", "text_sha256", F.max("doc_id").over(of_text).alias("keep_id"), F.count(F.lit(1)).over(of_text).alias("group_size")
    )
    return (
        hashed.join(F.broadcast(heavy), "text_sha256")
        .unionByName(light)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns; rows that repeat a kept row's doc_id stay."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["of"]), "left_semi")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""
