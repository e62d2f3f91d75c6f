"""Catalogue upkeep: grouped proposals, update text, merging, conflicts, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.schemas import CATEGORIES


def _category_rank(category: Column) -> Column:
    return F.array_position(F.lit(CATEGORIES), category).cast("int")


def category_groups(settled: DataFrame) -> DataFrame:
    """Inferred routes group by group: one row per route, so that no group must fit into one row."""
    return settled.select(
        "domain", "category", _category_rank(F.col("category")).alias("category_pos"), "route", "route_pos"
    )


def category_group_sizes(settled: DataFrame) -> DataFrame:
    """Size of each group, 0 for the empty ones."""
    counts = [F.count_if(F.col("category") == c).alias(c.replace("-", "_")) for c in CATEGORIES]
    return settled.groupBy("domain").agg(*counts)


def update_lines(proposed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the catalogue text per `keys`: sorted routes below their header, no empty headers.

    The lines are in place when ordered by (keys, category_pos, is_route, route).
    """
    known = proposed.where(F.col("category").isin(CATEGORIES))
    position = _category_rank(F.col("category")).alias("category_pos")
    head = F.struct(F.lit(0).alias("is_route"), F.lit("").alias("route"), F.concat("category", F.lit(":")).alias("line"))
    entry = F.struct(F.lit(1).alias("is_route"), F.col("route"), F.concat(F.lit("- "), "route").alias("line"))
    # each route brings its header along; the headers are reduced to one before the shuffle
    return known.select(*keys, position, F.inline(F.array(head, entry))).distinct()


def update_text(proposed: DataFrame) -> DataFrame:
    """The catalogue text of each site as one value.

    A site's routes came from one index document, so its text is no larger than that one cell was.
    For a text over many sites use update_lines, which the sink writes line by line.
    """
    known = proposed.where(F.col("category").isin(CATEGORIES))
    blocks = known.groupBy("domain", "category").agg(
        F.expr("listagg('- ' || route, '\n') WITHIN GROUP (ORDER BY route)").alias("entries")
    )
    named = blocks.select(
        "domain",
        _category_rank(F.col("category")).alias("category_pos"),
        F.concat("category", F.lit(":\n"), "entries").alias("block"),
    )
    return named.groupBy("domain").agg(
        F.expr("listagg(block, '\n') WITHIN GROUP (ORDER BY category_pos)").alias("catalogue_text")
    )


def merge_catalogue(known_routes: DataFrame, proposed: DataFrame) -> DataFrame:
    """The catalogue with proposed (category, route) entries added, each entry once."""
    return known_routes.select("category", "route").unionByName(proposed.select("category", "route")).distinct()


def catalogue_conflicts(known_routes: DataFrame) -> DataFrame:
    """Routes listed in more than one category.

    The four fixed categories are counted as flags, so each route needs a small buffer only.
    """
    listed = [F.max(F.when(F.col("category") == c, 1).otherwise(0)) for c in CATEGORIES]
    n_categories = sum(listed[1:], listed[0])
    names = F.concat_ws(",", *[F.when(flag == 1, c) for c, flag in zip(CATEGORIES, listed)])
    return (
        known_routes.where("route IS NOT NULL")
        .groupBy("route")
        .agg(n_categories.cast("bigint").alias("n_categories"), names.alias("categories"))
        .where("n_categories > 1")
    )


def catalogue_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Routes that are new, dropped or in other categories than before."""

    def flags(table: DataFrame, prefix: str) -> DataFrame:
        listed = [F.max(F.when(F.col("category") == c, 1).otherwise(0)) for c in CATEGORIES]
        names = F.concat_ws(",", *[F.when(flag == 1, c) for c, flag in zip(CATEGORIES, listed)])
        return table.where("route IS NOT NULL").groupBy("route").agg(names.alias(prefix))

    joined = flags(old, "old_categories").join(flags(new, "new_categories"), "route", "full")
    change = (
        F.when(F.col("old_categories").isNull(), "new")
        .when(F.col("new_categories").isNull(), "dropped")
        .when(F.col("old_categories") != F.col("new_categories"), "moved")
    )
    return joined.select("route", "old_categories", "new_categories", change.alias("change")).where(
        "change IS NOT NULL"
    )
