"""Joins whose large side may have a key that holds a large part of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
SPREAD = 16


def by_sort(side: DataFrame) -> DataFrame:
    """The side of a join that grows with the sites, to be sorted and never broadcast.

    Spark guesses the size of rows that a generator makes, as routes and pages are made, from what goes into it, and of texts by
    their number; a table far beyond its threshold would be sent whole through the driver.
    """
    return side.hint("merge")


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: int = 1000) -> DataFrame:
    """The keys with more than one in `share` rows: fewer than `share` of them, whatever the table."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    # one row beside each key
    return counts.join(F.broadcast(total), F.col("n") * share > F.col("total")).select(*keys)


def spread_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], how: str, by: Sequence[str], heavy: DataFrame | None = None, parts: int = SPREAD
) -> DataFrame:
    """large.join(small, keys, how) for how `left`, `inner`, `left_semi` or `left_anti`, with the rows of a key dealt to `parts` groups.

    `small` has few rows per key, as an aggregate has. Rows of `large` are dealt by the columns `by`, which tell rows of a key apart. With `heavy`, a table of
    keys from heavy_keys, only those are dealt and only their rows of `small` repeated; without it all are, which costs `parts` times the small
    side and no look at the large one. A small side below Spark's threshold is broadcast as ever.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"no spread join of type {how}")
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    if heavy is None:
        dealt, repeated = large.withColumn("_part", part), small.withColumn("_part", F.explode(every))
    else:
        marked = F.broadcast(heavy.select(*keys).withColumn("_heavy", F.lit(True)))  # fewer rows than heavy_keys' share
        dealt = large.join(marked, list(keys), "left").withColumn("_part", F.when(F.col("_heavy"), part).otherwise(0)).drop("_heavy")
        repeated = small.join(marked, list(keys), "left").withColumn("_part", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0))))).drop("_heavy")
    joined = dealt.join(repeated, [*keys, "_part"], how).drop("_part")
    rest = [c for c in small.columns if c not in keys] if how in ("left", "inner") else []
    return joined.select(*large.columns, *rest)
