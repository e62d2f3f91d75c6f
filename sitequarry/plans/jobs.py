"""The four commands as whole jobs over tables of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators import catalogue, media, pages, probe, routes, sites
from sitequarry.operators.skew import by_sort
from sitequarry.schemas import RETRY_COUNT
from sitequarry.session import stored


def ping(site_names: DataFrame, site_index: DataFrame, https: bool = True) -> dict[str, DataFrame]:
    """Health of each site whose name is accepted, and the names refused."""
    cleaned = sites.clean_domains(site_names)
    return {
        "health": sites.site_health(sites.accepted_domains(cleaned), site_index, https),
        "rejected": cleaned.where("reject_reason IS NOT NULL"),
    }


def analyze(
    site_index: DataFrame, known_routes: DataFrame, probes: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Categories and their counts; with probe answers also the proposals for unknown routes."""
    found = routes.explode_routes(site_index)
    categorised = routes.categorise(found, known_routes)
    unknown = categorised.where("category = 'unknown'").drop("category")
    result = {
        "routes": categorised.drop("route_json"),
        "statistics": routes.category_statistics(categorised),
        "unknown": unknown,
        "preview": routes.unknown_preview(unknown),
    }
    if probes is not None:
        settled = probe.settle(probe.classify(unknown, probes))
        result["proposed"] = catalogue.category_groups(settled)
        result["catalogue_lines"] = catalogue.update_lines(settled, ("domain",))
    return result


def dump(
    site_index: DataFrame,
    known_routes: DataFrame,
    responses: DataFrame,
    include_unknown: bool = True,
    retry_count: int = RETRY_COUNT,
) -> dict[str, DataFrame]:
    """Records, documents and statistics out of captured responses; of routes saved under one name the last stays.

    The plan and the numbers of the pages are written once. Routes that the plan does not want get no outcome, so the bodies of list
    pages move once, with the pages that are kept.
    """
    planned = stored(routes.dispatch(routes.explode_routes(site_index), known_routes, include_unknown), "plan")
    wanted = planned.where("action <> 'skip'").select("domain", "route", planned.action.alias("kind"))
    lists, dicts = (wanted.where(F.col("kind") == kind).select("domain", "route") for kind in ("list", "dict"))
    resolved = stored(pages.resolve_retries(responses, retry_count), "pages")
    # a row a route meets the plan, not a row a page
    outcomes = stored(pages.assemble(resolved).join(by_sort(lists), ["domain", "route"], "left_semi"), "outcomes")
    documents = pages.dict_documents(responses).join(by_sort(dicts), ["domain", "route"], "left_semi")
    times = responses.select("domain", "route", "kind", "fetched_at").join(by_sort(wanted), ["domain", "route", "kind"], "left_semi")
    written = planned.join(
        by_sort(outcomes.where("outcome = 'complete'").select("domain", "route")
        .unionByName(documents.where("body IS NOT NULL").select("domain", "route"))),
        ["domain", "route"], "left_semi",
    )
    files = routes.mark_overwritten(written)
    # a later route of the same name replaces what an earlier one wrote
    lost = files.where("overwritten").select("domain", "route")
    lasting = outcomes.join(by_sort(lost), ["domain", "route"], "left_anti")
    return {
        "plan": planned,
        "pages": resolved.join(by_sort(lists), ["domain", "route"], "left_semi"),
        "outcomes": outcomes,
        "records": pages.records(responses, resolved, lasting),
        "documents": documents.join(by_sort(lost), ["domain", "route"], "left_anti"),
        "files": files,
        "summary": pages.route_summary(resolved, outcomes),
        "statistics": pages.run_statistics(planned, documents, times),
    }


def getfiles(
    media_lines: DataFrame,
    manifest: DataFrame,
    existing_files: DataFrame,
    transfers: DataFrame,
    now: float,
    resume: bool = True,
) -> dict[str, DataFrame]:
    """Download plan, its outcomes, statistics and the next checkpoint; the outcomes are written once."""
    targets = media.with_targets(media.distinct_urls(media.media_urls(media_lines)))
    plan = media.download_plan(targets, manifest, existing_files, resume)
    outcomes = stored(media.with_outcomes(plan, transfers), "outcomes")
    return {
        "rejects": media.media_rejects(media_lines),
        "plan": plan,
        "outcomes": outcomes,
        "failed": media.failed_urls(outcomes),
        "statistics": media.transfer_statistics(outcomes),
        "manifest": media.next_manifest(manifest, outcomes, now, resume),
    }
