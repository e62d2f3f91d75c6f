"""Routes of a site: listing, categories, and what a dump does with each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import failures, json_shapes, urls
from sitequarry.operators.computed import with_computed
from sitequarry.operators.skew import by_sort, spread_join
from sitequarry.schemas import CATEGORIES, DUMP_CATEGORIES, PUBLIC_DICT, PUBLIC_LIST, UNKNOWN


def explode_routes(site_index: DataFrame) -> DataFrame:
    """Routes of each fetched index in index order: domain, route, route_pos, route_json.

    A repeated key keeps its first place and takes its last value, as JSON objects do. What begins with an object is judged and read
    by one parse.
    """
    other = ~F.ltrim("body", F.lit(" \t\n\r")).startswith("{") & json_shapes.is_json(F.col("body"))
    routes = F.coalesce(
        json_shapes.index_routes_of(F.col("document")), F.when(F.col("other"), F.from_json("body", "routes map<string,string>")["routes"])
    )
    names = F.map_keys("routes")
    entries = F.map_entries("routes")
    merged = F.transform(
        F.array_distinct(names),
        lambda name: F.struct(
            name.alias("key"),
            F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)["value"].alias("value"),
        ),
    )
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    fetched = site_index.where(failures.is_success(F.col("status"), F.col("error")))
    read = with_computed(fetched.select("domain", "body"), document=json_shapes.index_read(F.col("body")), other=other)
    parsed = with_computed(read, routes=routes)
    return (
        parsed.select("domain", F.posexplode_outer(F.when(repeated, merged).otherwise(entries)).alias("route_pos", "entry"))
        .where("entry IS NOT NULL")
        .select(
            "domain",
            F.col("entry.key").alias("route"),
            "route_pos",
            F.col("entry.value").alias("route_json"),
        )
    )


def _first_match(known_routes: DataFrame, order: Sequence[str]) -> DataFrame:
    """The catalogue with one category per route, the first of `order` that lists it."""
    rank = F.array_position(F.lit(list(order)), F.col("category"))
    best = known_routes.where(F.col("route").isNotNull() & F.col("category").isin(list(order)))
    best = best.groupBy("route").agg(F.min(rank).alias("rank"))
    return best.select("route", F.element_at(F.lit(list(order)), F.col("rank").cast("int")).alias("category"))


def categorise(routes: DataFrame, known_routes: DataFrame) -> DataFrame:
    """Routes with the category the analysis gives them, `unknown` when not in the catalogue.

    A catalogue below Spark's broadcast threshold is broadcast; with a larger one the commonest routes, which nearly all sites have, are
    dealt to many tasks by site.
    """
    ranked = _first_match(known_routes, CATEGORIES)
    joined = spread_join(routes, ranked, ["route"], "left", by=["domain"])
    return joined.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))


def unknown_routes(routes: DataFrame, known_routes: DataFrame) -> DataFrame:
    known = known_routes.where(F.col("category").isin(CATEGORIES)).select("route")
    return spread_join(routes, known, ["route"], "left_anti", by=["domain"])


def present_in_index(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """Candidate (domain, route) rows that the index has."""
    return candidates.join(by_sort(routes.select("domain", "route")), ["domain", "route"], "left_semi")


def with_definitions(candidates: DataFrame, routes: DataFrame, **parts: Column) -> DataFrame:
    """Candidate (domain, route) rows with their definition from the index, or with what `parts` take from it.

    Parts are read where the definition is; its text, which is most of an index, is then neither shuffled nor sorted.
    """
    taken = [part.alias(name) for name, part in parts.items()] or ["route_json"]
    return candidates.join(by_sort(routes.select("domain", "route", *taken)), ["domain", "route"])


def category_statistics(categorised: DataFrame) -> DataFrame:
    """Routes per site and category; categories without routes are 0."""
    counts = [
        F.count_if(F.col("category") == name).alias(name.replace("-", "_")) for name in [*CATEGORIES, UNKNOWN]
    ]
    return categorised.groupBy("domain").agg(F.count(F.lit(1)).alias("total_routes"), *counts)


def category_totals(categorised: DataFrame) -> DataFrame:
    """Routes per (site, category), per site and over all sites."""
    return categorised.rollup("domain", "category").agg(F.count(F.lit(1)).alias("n_routes"))


def route_counts(routes: DataFrame) -> DataFrame:
    return routes.groupBy("domain").agg(F.count(F.lit(1)).alias("routes_count"))


def dispatch(
    routes: DataFrame,
    known_routes: DataFrame,
    include_unknown: bool = True,
    absent_categories: Sequence[str] = (),
) -> DataFrame:
    """What a dump does with each route: action `list`, `dict` or `skip`, with the reason.

    The categories are tried in another order than in the analysis. A catalogue without one of its
    four categories (`absent_categories`) fails every route that gets as far as that category.
    """
    ranked = _first_match(known_routes, DUMP_CATEGORIES)
    definition = F.col("definition")
    matched = spread_join(routes, ranked, ["route"], "left", by=["domain"])
    unknown = F.col("category").isNull()
    # a generator copies its rows, so one is all: filters stay above it, and what they repeat there is cheap
    joined = with_computed(
        matched.withColumn("definition", json_shapes.route_definition(F.col("route_json"))),
        link=json_shapes.self_link(definition),
        # what only routes outside the catalogue are judged by
        endpoints=F.when(unknown, json_shapes.endpoint_count(definition)),
        args=F.when(unknown, json_shapes.args_kind(definition)),
        paginated=F.when(unknown, json_shapes.is_paginated(definition)),
    ).drop("definition")
    category, no_url = F.col("category"), F.col("link").isNull()

    reason = None
    for name in DUMP_CATEGORIES:
        if name in absent_categories:
            reason = _when(reason, F.lit(True), "catalogue_incomplete")
        elif name in (PUBLIC_LIST, PUBLIC_DICT):
            reason = _when(reason, (category == name) & no_url, "no_self_link")
            reason = _when(reason, category == name, None)
        else:
            reason = _when(reason, category == name, name)
    reason = (
        reason.when(F.contains(F.col("route"), F.lit("?P")), "regex")
        .when(F.lit(not include_unknown), "unknown_not_wanted")
        .when(F.col("endpoints").isNull() | (F.col("endpoints") == 0), "no_endpoints")
        .when(no_url, "no_self_link")
        .when(F.col("args").isin("missing", "other"), "no_args")
    )
    action = (
        F.when(F.col("skip_reason").isNotNull(), "skip")
        .when(category == PUBLIC_LIST, "list")
        .when(category == PUBLIC_DICT, "dict")
        .when(F.col("paginated"), "list")
        .otherwise("dict")
    )
    result = joined.withColumn("skip_reason", reason).withColumn("action", action)
    name = F.when(F.col("action") != "skip", urls.output_name(F.col("route"), F.col("action")))
    return result.select(
        "domain",
        "route",
        "route_pos",
        F.coalesce("category", F.lit(UNKNOWN)).alias("category"),
        "action",
        "skip_reason",
        F.col("link").alias("url"),
        name.alias("out_name"),
    )


def _when(chain: Column | None, condition: Column, value: str | None) -> Column:
    return F.when(condition, value) if chain is None else chain.when(condition, value)


def mark_overwritten(written: DataFrame) -> DataFrame:
    """Routes saved under the same name: all but the last in index order are overwritten.

    A window group holds routes of one index document only, and that document was one cell.
    """
    later = F.max("route_pos").over(Window.partitionBy("domain", "out_name"))
    return written.withColumn("overwritten", F.col("route_pos") < later)


def unknown_preview(unknown: DataFrame, shown: int = 10) -> DataFrame:
    """The first unknown routes of each site in index order, and how many more there are."""
    counts = unknown.groupBy("domain").agg(F.count(F.lit(1)).alias("n_unknown"))
    first = unknown.withColumn(
        "place", F.row_number().over(Window.partitionBy("domain").orderBy("route_pos"))
    ).where(F.col("place") <= shown)
    return first.join(by_sort(counts), "domain").select(
        "domain", "place", "route", "n_unknown", F.greatest(F.col("n_unknown") - shown, F.lit(0)).alias("n_more")
    )


def in_index_order(routes: DataFrame) -> DataFrame:
    return routes.orderBy("domain", "route_pos")


def in_name_order(routes: DataFrame) -> DataFrame:
    """By code point, which is the binary order of Spark's strings."""
    return routes.orderBy("domain", "route")
