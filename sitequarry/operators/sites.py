"""Site names and site health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import domains, failures, json_shapes, urls
from sitequarry.operators.computed import with_computed


def clean_domains(sites: DataFrame) -> DataFrame:
    """Each input name with its domain and kind, or the reason it is refused."""
    name = F.col("input")
    found = with_computed(sites.select("input"), domain=domains.normalised(name))
    found = with_computed(found, domain_kind=domains.kind(F.col("domain")))
    checked = with_computed(found, reject_reason=domains.reject_reason(name, F.col("domain"), F.col("domain_kind")))
    refused = F.col("reject_reason").isNotNull()
    return checked.select(
        "input",
        "domain",
        F.when(~refused, F.col("domain_kind")).alias("domain_kind"),
        "reject_reason",
        F.when(refused, failures.domain_message(F.coalesce("domain", F.lit("")), F.col("reject_reason"))).alias(
            "error_message"
        ),
    )


def accepted_domains(cleaned: DataFrame) -> DataFrame:
    """Accepted names, repeats after normalising collapsed."""
    return cleaned.where("reject_reason IS NULL").select("domain", "domain_kind").distinct()


def index_state(site_index: DataFrame) -> DataFrame:
    """Site index rows with what their body turned out to be.

    state is `fetch_failed`, `invalid` (no JSON), `unusable` (JSON that has no keys, or routes that
    are no object), `no_routes` or `ok`; `routes` is NULL unless `ok`.
    """
    fetched = failures.is_success(F.col("status"), F.col("error"))
    shape = json_shapes.json_shape(F.col("body"))
    routes = F.from_json("body", "routes map<string,string>")["routes"]
    parsed = with_computed(site_index, fetched=fetched, shape=F.when(fetched, shape))
    has_routes = json_shapes.has_key(F.col("body"), "routes")
    parsed = with_computed(parsed, has_routes=F.when(F.col("shape") == "dict", has_routes))
    parsed = with_computed(parsed, routes=F.when(F.col("has_routes"), routes))
    state = (
        F.when(~F.col("fetched"), "fetch_failed")
        .when(F.col("shape") == "invalid", "invalid")
        .when(F.col("routes").isNotNull(), "ok")
        .when(F.coalesce("has_routes", F.lit(False)) | (F.col("shape") == "other"), "unusable")
        .otherwise("no_routes")
    )
    return parsed.select("domain", "status", "error", state.alias("state"), "routes")


def index_outcomes(site_index: DataFrame) -> DataFrame:
    """What each command makes of an index: ping, analyze and dump differ on a missing route list."""
    state = F.col("state")
    outcome = {
        "ping_outcome": F.when(state == "ok", "routes").when(state == "no_routes", "empty").otherwise("failure"),
        "analyze_outcome": F.when(state == "ok", "routes").when(state == "no_routes", "zeros").otherwise("failure"),
        "dump_outcome": F.when(state == "ok", "routes").otherwise("failure"),
    }
    return index_state(site_index).select(
        "domain", state.alias("state"), (state == "ok").alias("index_ok"),
        *[column.alias(name) for name, column in outcome.items()],
    )


def site_health(sites: DataFrame, site_index: DataFrame, https: bool = True) -> DataFrame:
    """Per domain of `sites`: URL, ok flag and route count, or kind and message of the failure."""
    joined = sites.select("domain").join(index_state(site_index), "domain", "left")
    url = urls.index_url(F.col("domain"), https)
    state = F.coalesce("state", F.lit("not_captured"))
    error_kind = (
        F.when(state == "fetch_failed", failures.failure_kind(F.col("status"), F.col("error")))
        .when(state == "not_captured", "not_captured")
        .when(state.isin("invalid", "unusable"), "api")
    )
    status = F.when((F.col("error_kind") == "api") & F.col("error").isNull(), F.col("status"))
    detail = (
        F.when(state == "invalid", "Invalid response format: no JSON")
        .when(state == "unusable", "Unexpected error: no route list")
        .otherwise(F.col("error"))
    )
    http_status = F.when(state == "fetch_failed", status)
    message = F.when(F.col("error_kind") == "ssl", failures.ssl_message(F.col("url"), F.col("error"))).when(
        F.col("error_kind") == "api", failures.api_message(F.col("url"), http_status, detail)
    )
    routes_count = F.when(state == "ok", F.size(F.array_distinct(F.map_keys("routes")))).cast("bigint")
    return (
        joined.withColumn("url", url)
        .withColumn("error_kind", error_kind)
        .select(
            "domain",
            "url",
            (state == "ok").alias("ok"),
            routes_count.alias("routes_count"),
            "error_kind",
            http_status.alias("error_status"),
            message.alias("error_message"),
        )
    )
