"""Connected components by alternating joins with smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node in links (a, b), which may repeat.

    Each round links every node's larger neighbours to its smallest one, then the node itself and its smaller
    ones. Links never grow in number; rounds are about the logarithm of the longest path. Smallest neighbours are combined
    in the map tasks and written before they are joined, so that a node of many links is split over tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = saved(edges, "links")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(larger.where("u <> v").distinct(), "links")

        least = saved(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")

        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
