"""Categories of unknown routes, inferred from two probe requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import failures, json_shapes, urls
from sitequarry.operators.computed import with_computed
from sitequarry.operators.skew import by_sort
from sitequarry.schemas import PROTECTED, PUBLIC_DICT, PUBLIC_LIST, USELESS

ROUTE = ["domain", "route"]


def _defined(unknown: DataFrame) -> DataFrame:
    definition = F.col("definition")
    link = F.col("link")
    parsed = unknown.withColumn("definition", json_shapes.route_definition(F.col("route_json")))
    return (
        with_computed(
            parsed,
            link=json_shapes.self_link(definition),
            endpoints=F.coalesce(json_shapes.endpoint_count(definition), F.lit(0)),
            args=json_shapes.args_kind(definition),
            paginated=json_shapes.is_paginated(definition),
            regex=F.contains(F.col("route"), F.lit("?P<")),
        )
        .withColumn("link", F.when(link != "", link))
        .drop("definition")
    )


def first_probes(unknown: DataFrame) -> DataFrame:
    """The first request of each paginated route: one record of page 1.

    `unknown` holds domain, route, route_json.
    """
    return _plan(_defined(unknown).withColumn("probe", F.explode(_wanted(first=True))))


def second_probes(unknown: DataFrame, probes: DataFrame) -> DataFrame:
    """The plain request of the routes that the first one left undecided."""
    return _plan(_answered(unknown, probes).withColumn("probe", F.explode(_wanted(second=True))))


def probe_plan(unknown: DataFrame, probes: DataFrame) -> DataFrame:
    """Both requests of each route, as far as it needs them: definitions are parsed once, answers joined once."""
    return _plan(_answered(unknown, probes).withColumn("probe", F.explode(_wanted(first=True, second=True))))


def _answered(unknown: DataFrame, probes: DataFrame) -> DataFrame:
    return _defined(unknown).join(by_sort(_first_results(probes)), ROUTE, "left")


def _wanted(first: bool = False, second: bool = False) -> Column:
    """Numbers of the requests that a route needs."""
    asks = ~F.col("regex") & (F.col("endpoints") > 0) & F.col("link").isNotNull() & F.col("paginated").isNotNull()
    needs = []
    if first:
        needs.append(F.when(asks & F.col("paginated"), 1))
    if second:
        needs.append(F.when(asks & (~F.col("paginated") | F.col("paginated_answer").isNull()), 2))
    return F.array_compact(F.array(*needs))


def _plan(rows: DataFrame) -> DataFrame:
    url = F.when(F.col("probe") == 1, urls.probe_url(F.col("link"))).otherwise(F.col("link"))
    return rows.select(
        "domain", "route", F.lit("probe").alias("kind"), url.alias("url"), F.col("probe").alias("page"), F.lit(1).alias("attempt")
    )


def _first_results(probes: DataFrame) -> DataFrame:
    shape = json_shapes.json_shape(F.col("body"))
    status = failures.status_class(F.col("status"))
    answer = F.when(F.col("error").isNull() & (status == "protected"), PROTECTED).when(
        F.col("error").isNull() & (status == "ok") & (shape == "list"), PUBLIC_LIST
    )
    return probes.where("probe = 1").select(*ROUTE, answer.alias("paginated_answer"))


def _second_results(probes: DataFrame) -> DataFrame:
    body = F.col("body")
    return probes.where("probe = 2").select(
        *ROUTE,
        F.col("error").isNotNull().alias("broken"),
        failures.status_class(F.col("status")).alias("class"),
        json_shapes.json_shape(body).alias("shape"),
        json_shapes.has_key(body, "id").alias("has_id"),
    )


def classify(unknown: DataFrame, probes: DataFrame) -> DataFrame:
    """Inferred category of each unknown route and the rule that gave it; NULL when undecided.

    `probes` may hold answers of more routes than needed; a route takes the first only if it is
    paginated and has a link. A missing second probe counts as undecided.
    """
    joined = (
        _defined(unknown)
        .join(by_sort(_first_results(probes)), ROUTE, "left")
        .join(by_sort(_second_results(probes)), ROUTE, "left")
    )
    asked_first = F.col("paginated") & F.col("link").isNotNull()
    ok = F.col("class") == "ok"
    last_part = F.element_at(F.split("route", "/"), -1)
    item = last_part.rlike(r"\p{Nd}") & (F.size(F.split("route", "/")) > 3)
    rules = [
        ("regex", F.col("regex"), USELESS),
        ("no_endpoints", F.col("endpoints") == 0, None),
        ("first_protected", asked_first & (F.col("paginated_answer") == PROTECTED), PROTECTED),
        ("first_list", asked_first & (F.col("paginated_answer") == PUBLIC_LIST), PUBLIC_LIST),
        ("no_self_link", F.col("link").isNull(), None),
        ("broken_paginated", F.col("broken") & F.col("paginated"), PUBLIC_LIST),
        ("broken_dict", F.col("broken") & F.col("args").isin("dict", "missing"), PUBLIC_DICT),
        ("broken_other", F.col("broken"), None),
        ("second_protected", F.col("class") == "protected", PROTECTED),
        ("item", item & ok & (F.col("shape") == "dict") & F.col("has_id"), USELESS),
        ("second_list", ok & (F.col("shape") == "list"), PUBLIC_LIST),
        ("second_dict", ok & (F.col("shape") == "dict"), PUBLIC_DICT),
    ]
    matched = F.coalesce(*[F.when(condition, name) for name, condition, _ in rules], F.lit("undecided"))
    given = F.create_map(*[F.lit(x) for name, _, result in rules if result for x in (name, result)])
    kept = [c for c in unknown.columns if c != "route_json"]
    return joined.select(*kept, matched.alias("rule")).select(*kept, F.try_element_at(given, F.col("rule")).alias("category"), "rule")


def settle(classified: DataFrame) -> DataFrame:
    """Undecided routes become useless."""
    return classified.withColumn("category", F.coalesce("category", F.lit(USELESS)))
