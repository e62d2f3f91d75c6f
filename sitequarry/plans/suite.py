"""Registered queries: each takes (session, folder of the given tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.functions import failures, json_shapes, text
from sitequarry.operators import catalogue, content, media, pages, positions, probe, routes, search_index, sites
from sitequarry.operators.skew import by_sort
from sitequarry.plans import bindings as b
from sitequarry.plans import crawl, jobs
from sitequarry.session import fresh_dir, stored
from sitequarry.sources import captures, checkpoints, fetch, sinks
from sitequarry.sources.catalogue import parse_catalogue, seed_catalogue
from sitequarry.streaming import ingest, progress, retries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- sites -------------------------------------------------------------------------------------


@query
def domain_cleaning(spark, sf_dir):
    return sites.clean_domains(b.sites(spark, sf_dir))


@query
def domains_accepted(spark, sf_dir):
    return sites.accepted_domains(sites.clean_domains(b.sites(spark, sf_dir)))


@query
def site_health(spark, sf_dir):
    return sites.site_health(b.index_domains(spark, sf_dir), b.site_index(spark, sf_dir))


@query
def site_route_counts(spark, sf_dir):
    return routes.route_counts(routes.explode_routes(b.site_index(spark, sf_dir)))


@query
def index_validity(spark, sf_dir):
    return sites.index_outcomes(b.site_index(spark, sf_dir))


# --- routes ------------------------------------------------------------------------------------


def _routes(spark, sf_dir):
    return routes.explode_routes(b.site_index(spark, sf_dir))


@query
def index_routes(spark, sf_dir):
    found = _routes(spark, sf_dir)
    definition = json_shapes.route_definition(F.col("route_json"))
    return found.select(
        "domain", "route", "route_pos", json_shapes.self_link(definition).alias("self_url")
    )


@query
def route_definitions(spark, sf_dir):
    # routes that the catalogue knows have no candidate and stay where they are read
    wanted = routes.unknown_routes(_routes(spark, sf_dir), seed_catalogue(spark))
    definition = json_shapes.route_definition(F.col("route_json"))
    return routes.with_definitions(
        wanted.select("domain", "route"),
        wanted,
        endpoints=json_shapes.endpoint_count(definition).cast("int"),
        args=json_shapes.args_kind(definition),
        paginated=F.coalesce(json_shapes.is_paginated(definition), F.lit(False)),
    )


@query
def routes_categorised(spark, sf_dir):
    return routes.categorise(_routes(spark, sf_dir), seed_catalogue(spark)).select(
        "domain", "route", "route_pos", "category"
    )


@query
def category_statistics(spark, sf_dir):
    return routes.category_statistics(routes.categorise(_routes(spark, sf_dir), seed_catalogue(spark)))


@query
def category_statistics_by_customer(spark, sf_dir):
    return routes.category_statistics(
        routes.categorise(b.customer_routes(spark, sf_dir), seed_catalogue(spark))
    )


@query
def category_totals(spark, sf_dir):
    return routes.category_totals(routes.categorise(b.customer_routes(spark, sf_dir), seed_catalogue(spark)))


@query
def unknown_routes(spark, sf_dir):
    return routes.unknown_routes(b.customer_routes(spark, sf_dir), seed_catalogue(spark)).select("domain", "route")


@query
def unknown_in_index(spark, sf_dir):
    names = [r for k, r, _, _ in b.TEMPLATES if k in b.UNKNOWN_TEMPLATES]
    candidates = b.index_domains(spark, sf_dir).select("domain", F.explode(F.lit(names)).alias("route"))
    return routes.present_in_index(candidates, _routes(spark, sf_dir))


@query
def routes_dispatched(spark, sf_dir):
    return routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))


@query
def routes_dispatched_known_only(spark, sf_dir):
    return routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark), include_unknown=False)


@query
def routes_dispatched_without_dicts(spark, sf_dir):
    known = seed_catalogue(spark).where("category <> 'public-dict'")
    return routes.dispatch(_routes(spark, sf_dir), known, absent_categories=["public-dict"])


@query
def routes_in_index_order(spark, sf_dir):
    rows = _routes(spark, sf_dir).select("domain", "route_pos", "route")
    return positions.with_positions(rows, positions.sort_keys(["domain", "route_pos"]))


@query
def routes_in_name_order(spark, sf_dir):
    rows = b.customer_routes(spark, sf_dir).select("domain", "route")
    return positions.with_positions(rows, positions.sort_keys(["domain", "route"]))


@query
def output_collisions(spark, sf_dir):
    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    marked = routes.mark_overwritten(planned.where("action <> 'skip'"))
    return marked.select("domain", "route", "out_name", "overwritten")


@query
def unknown_preview(spark, sf_dir):
    return routes.unknown_preview(routes.unknown_routes(b.customer_routes(spark, sf_dir), seed_catalogue(spark)))


# --- pages -------------------------------------------------------------------------------------


def _resolved(spark, sf_dir):
    return pages.resolve_retries(b.responses(spark, sf_dir))


def _pages(spark, sf_dir):
    """The same numbers, written once for those who read them more than once."""
    return stored(_resolved(spark, sf_dir), "pages")


@query
def request_plan(spark, sf_dir):
    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    return pages.request_plan(planned, pages.assemble(_pages(spark, sf_dir)))


@query
def plan_against_captures(spark, sf_dir):
    return pages.plan_against_captures(request_plan(spark, sf_dir), b.responses(spark, sf_dir))


@query
def next_requests(spark, sf_dir):
    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    return pages.next_requests(planned, _pages(spark, sf_dir)).select("domain", "route", "page", "attempt")


@query
def retry_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("domain", "route", "page", "tries", "attempt", "status", "failed")


@query
def retry_resolution_two_tries(spark, sf_dir):
    resolved = pages.resolve_retries(b.responses(spark, sf_dir), retry_count=2)
    return resolved.select("domain", "route", "page", "tries", "attempt", "status", "failed")


@query
def page_assembly(spark, sf_dir):
    return pages.assemble(_pages(spark, sf_dir))


@query
def dropped_routes(spark, sf_dir):
    return pages.dropped_routes(pages.assemble(_pages(spark, sf_dir)))


@query
def archived_records(spark, sf_dir):
    resolved = _pages(spark, sf_dir)
    return pages.records(b.responses(spark, sf_dir), resolved, pages.assemble(resolved))


@query
def stored_records(spark, sf_dir):
    """Records out of responses that are stored in buckets of pages."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = captures.store_responses(b.responses(spark, sf_dir), f"responses_{uuid.uuid4().hex}", fresh_dir(spark, "stored-responses"), n)
    resolved = pages.resolve_retries(table)
    # written before bodies are read again, which frees what the numbers took to get there
    return pages.records(table, resolved, stored(pages.assemble(resolved), "outcomes"))


@query
def records_in_server_order(spark, sf_dir):
    rows = archived_records(spark, sf_dir).select("domain", "route", "page", "idx")
    return positions.with_positions(rows, positions.sort_keys(["domain", "route", "page", "idx"]))


@query
def dict_documents(spark, sf_dir):
    return pages.dict_documents(b.responses(spark, sf_dir))


@query
def route_summary(spark, sf_dir):
    resolved = _pages(spark, sf_dir)
    return pages.route_summary(resolved, pages.assemble(resolved))


@query
def run_statistics(spark, sf_dir):
    captured = b.responses(spark, sf_dir)
    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    return pages.run_statistics(planned, pages.dict_documents(captured), captured)


@query
def bulk_fetch(spark, sf_dir):
    """Fetch the first pages of all planned list routes through a transport that answers by itself."""

    def transport(url):
        if "/feed" in url:
            raise TimeoutError("read timed out")
        return 200, {"X-WP-TotalPages": "1"}, f'[{{"length":{len(url)}}}]'

    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    return fetch.fetch(pages.request_plan(planned), transport).drop("headers", "fetched_at")


@query
def crawled_records(spark, sf_dir):
    """A dump driven to its end, broken off after two rounds and taken up again."""
    how = {"folder": fresh_dir(spark, "crawl"), "tasks": 8, "per_site": 2, "tell_attempt": True}
    inputs = b.crawl_index(spark, sf_dir), seed_catalogue(spark), b.answer
    crawl.crawl(*inputs, most_rounds=2, **how)
    return crawl.dump(*inputs, **how)["records"]


@query
def fetch_lanes(spark, sf_dir):
    """Fetching in lanes: how many each site's requests took, and whether answers came in the order of their turns."""
    planned = routes.dispatch(_routes(spark, sf_dir), seed_catalogue(spark))
    requests = stored(fetch.lanes(pages.request_plan(planned), tasks=16, per_site=3), "lanes")
    found = stored(fetch.fetch(requests, lambda url: (200, {}, "[]"), tasks=16, per_site=3), "answers")
    timed = found.join(by_sort(requests.select("domain", "route", "page", "lane", "turn")), ["domain", "route", "page"])
    earlier = F.lag("fetched_at").over(Window.partitionBy("domain", "lane").orderBy("turn"))
    ordered = timed.withColumn("late", F.coalesce(F.col("fetched_at") < earlier, F.lit(False)))
    return ordered.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_requests"), (F.countDistinct("lane") <= 3).alias("within_lanes"), (~F.bool_or("late")).alias("in_turn")
    )


# --- probes and catalogue ----------------------------------------------------------------------


def _unknown(spark, sf_dir):
    return routes.unknown_routes(_routes(spark, sf_dir), seed_catalogue(spark))


@query
def probe_plan(spark, sf_dir):
    plan = probe.probe_plan(_unknown(spark, sf_dir), b.probes(spark, sf_dir))
    return plan.select("domain", "route", F.col("page").alias("probe"), "url")


@query
def probe_classification(spark, sf_dir):
    found = probe.classify(_unknown(spark, sf_dir), b.probes(spark, sf_dir))
    return found.select("domain", "route", "category", "rule")


def _settled(spark, sf_dir):
    return probe.settle(probe.classify(_unknown(spark, sf_dir), b.probes(spark, sf_dir)))


@query
def inferred_groups(spark, sf_dir):
    return catalogue.category_groups(_settled(spark, sf_dir))


@query
def inferred_group_sizes(spark, sf_dir):
    return catalogue.category_group_sizes(_settled(spark, sf_dir))


@query
def catalogue_update_text(spark, sf_dir):
    return catalogue.update_text(_settled(spark, sf_dir))


@query
def catalogue_update_lines(spark, sf_dir):
    return catalogue.update_lines(_settled(spark, sf_dir), ("domain",))


def _scanned(spark, sf_dir):
    return parse_catalogue(b.catalogue_documents(spark, sf_dir))


@query
def catalogue_scan(spark, sf_dir):
    return _scanned(spark, sf_dir).select("p_partkey", "category", "route")


@query
def catalogue_conflicts(spark, sf_dir):
    return catalogue.catalogue_conflicts(_scanned(spark, sf_dir))


@query
def catalogue_merge(spark, sf_dir):
    proposed = _settled(spark, sf_dir).select("category", "route").distinct()
    return catalogue.merge_catalogue(seed_catalogue(spark), proposed)


@query
def catalogue_difference(spark, sf_dir):
    scanned = _scanned(spark, sf_dir)
    old = scanned.where("p_partkey % 4 <> 0")
    new = scanned.where("p_partkey % 4 <> 1")
    return catalogue.catalogue_difference(old, new)


# --- media -------------------------------------------------------------------------------------


@query
def media_urls(spark, sf_dir):
    return media.media_urls(b.page_media(spark, sf_dir))


@query
def media_rejects(spark, sf_dir):
    return media.media_rejects(b.page_media(spark, sf_dir))


@query
def media_rejects_of_files(spark, sf_dir):
    """Media lists written to their sites' folders and read back, with the numbers that lines have in their file."""
    out = fresh_dir(spark, "sites-saved")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    lists = b.page_media(spark, sf_dir).groupBy("domain").agg(lines.alias("text"))
    sinks.write_files(lists.select(F.concat("domain", F.lit("/data/wp_v2_media.jsonl")).alias("target_path"), F.encode("text", "UTF-8").alias("content")), out)
    return media.media_rejects(captures.read_media_lines(spark, out))


@query
def media_targets(spark, sf_dir):
    return media.with_targets(media.media_urls(b.page_media(spark, sf_dir)))


def _targets(spark, sf_dir):
    return media.with_targets(media.media_urls(b.item_media(spark, sf_dir))).select(
        "domain", "source_url", "target_path"
    )


def _distinct_targets(spark, sf_dir):
    urls = media.distinct_urls(media.media_urls(b.item_media(spark, sf_dir)))
    return media.with_targets(urls).select("domain", "source_url", "target_path", "n_lines")


def _plan(spark, sf_dir, resume=True):
    targets = _distinct_targets(spark, sf_dir)
    return media.download_plan(targets, b.manifest(spark, sf_dir), b.existing_files(spark, sf_dir), resume)


def _outcomes(spark, sf_dir):
    return media.with_outcomes(_plan(spark, sf_dir), b.item_transfers(spark, sf_dir))


@query
def target_collisions(spark, sf_dir):
    return media.target_collisions(_targets(spark, sf_dir))


@query
def download_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def download_plan_without_resume(spark, sf_dir):
    return _plan(spark, sf_dir, resume=False)


@query
def resume_filter(spark, sf_dir):
    return media.to_download(_plan(spark, sf_dir)).select("domain", "source_url", "target_path", "n_lines")


@query
def present_but_not_checkpointed(spark, sf_dir):
    targets = _distinct_targets(spark, sf_dir)
    return media.present_but_not_checkpointed(targets, b.manifest(spark, sf_dir), b.existing_files(spark, sf_dir))


@query
def transfer_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "domain", "source_url", "n_lines", "skip_reason", "outcome", "fetched", "error", "bytes"
    )


@query
def transfer_statistics(spark, sf_dir):
    stats = media.transfer_statistics(_outcomes(spark, sf_dir))
    return stats.withColumn("files_per_second", F.round("files_per_second", 6))


@query
def failed_urls(spark, sf_dir):
    return media.failed_urls(_outcomes(spark, sf_dir))


@query
def next_manifest(spark, sf_dir):
    done = stored(_outcomes(spark, sf_dir).select("domain", "target_path", "outcome", "fetched"), "outcomes")
    return media.next_manifest(b.manifest(spark, sf_dir), done, now=1.8e9)


def _grown(spark, sf_dir):
    """A checkpoint of a base and three runs, the last of which fetched nothing."""
    folder, done = fresh_dir(spark, "checkpoint"), stored(_outcomes(spark, sf_dir), "outcomes")
    checkpoints.start(b.manifest(spark, sf_dir), folder)
    odd = F.length("target_path") % 2 == 1
    checkpoints.add(done.where(~odd), folder, now=1.75e9)
    checkpoints.add(done.where(odd), folder, now=1.78e9)
    checkpoints.add(done.withColumn("fetched", F.lit(False)), folder, now=1.8e9)
    return folder


@query
def checkpoint_grown(spark, sf_dir):
    """The checkpoint after three runs, as base and additions and after compaction."""
    folder = _grown(spark, sf_dir)
    before = stored(checkpoints.read(spark, folder), "checkpoint-read")
    checkpoints.compact(spark, folder)
    after = checkpoints.read(spark, folder)
    return before.withColumn("compacted", F.lit(False)).unionByName(after.withColumn("compacted", F.lit(True)))


@query
def checkpoint_additions(spark, sf_dir):
    """What the second run wrote: only what it fetched."""
    return spark.read.schema(checkpoints.PATHS).parquet(f"{_grown(spark, sf_dir)}/paths-000002").select("domain", "path")


@query
def files_inventoried(spark, sf_dir):
    """Files written to their sites' folders, and what a listing by tasks finds there."""
    out = fresh_dir(spark, "tree")
    files = b.existing_files(spark, sf_dir).groupBy("path").agg(F.max("length").alias("length"))
    content = F.expr("repeat('x', cast(length % 1000 AS INT))")
    sinks.write_files(files.select(F.col("path").alias("target_path"), F.encode(content, "UTF-8").alias("content")), out)
    return captures.file_inventory(spark, out)


@query
def missing_media(spark, sf_dir):
    # media lists of every other site only
    listed = b.page_media(spark, sf_dir).where("line_no % 20 < 10")
    wanted = b.page_media(spark, sf_dir).select("domain").distinct()
    return media.missing_media(wanted, listed)


@query
def checkpoint_scan(spark, sf_dir):
    """Checkpoint documents, one per part, every 9th unreadable."""
    documents = b.table(spark, sf_dir, "part").selectExpr(
        "concat('p', p_partkey) AS domain",
        "CASE WHEN p_partkey % 9 = 0 THEN '{\"downloaded_files\":' ELSE concat('{\"downloaded_files\":[\"p', p_partkey, "
        "'/files/a.jpg\",\"p', p_partkey, '/files/b', p_size, '.jpg\"],\"last_updated\":', p_partkey, '.5}') END AS body",
    )
    return captures.parse_checkpoints(documents)


@query
def wrong_lengths(spark, sf_dir):
    """Stored files against the bytes that the transfers of their URLs tell."""
    moved = media.last_transfers(b.item_transfers(spark, sf_dir)).where("success").select("domain", "source_url", "bytes")
    expected = _distinct_targets(spark, sf_dir).join(moved, ["domain", "source_url"])
    return media.wrong_lengths(b.existing_files(spark, sf_dir), expected.select("domain", "target_path", "bytes").distinct())


@query
def bytes_as_text(spark, sf_dir):
    items = b.table(spark, sf_dir, "lineitem")
    sizes = items.selectExpr("cast(floor(l_extendedprice * pow(8, l_linenumber)) AS BIGINT) AS n").unionByName(
        items.selectExpr("l_partkey * 32 AS n")
    )
    return sizes.distinct().select("n", text.bytes_text(F.col("n")).alias("size_text"))


@query
def durations_as_text(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select((F.col("o_totalprice") * (F.col("o_orderkey") % 7)).alias("seconds"))
    return orders.distinct().select("seconds", text.duration_text(F.col("seconds")).alias("duration_text"))


# --- content -----------------------------------------------------------------------------------


def _posts(spark, sf_dir):
    return content.posts(b.post_records(spark, sf_dir))


@query
def posts_view(spark, sf_dir):
    return _posts(spark, sf_dir).select(
        "id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date_text"), "status", "title", "content",
        "excerpt", "author", "featured_media",
    )


@query
def posts_between_dates(spark, sf_dir):
    found = content.between_dates(_posts(spark, sf_dir), "2020-03-01T10:00:00", "2021-07-01T10:00:00")
    return found.select("id")


@query
def posts_by_author(spark, sf_dir):
    return content.with_values(_posts(spark, sf_dir), "author", [3, 5, 8]).select("id", "author")


@query
def posts_with_terms(spark, sf_dir):
    return content.with_terms(_posts(spark, sf_dir), "categories", "5,6").select("id")


@query
def posts_with_status(spark, sf_dir):
    return content.with_status(_posts(spark, sf_dir)).select("id", "status")


@query
def posts_search(spark, sf_dir):
    return content.search(_posts(spark, sf_dir), "The TH").select("id", "title")


@query
def posts_page(spark, sf_dir):
    return content.page_by_position(content.with_status(_posts(spark, sf_dir)), "date", "desc", page=3, per_page=20).select("id")


@query
def posts_page_late(spark, sf_dir):
    """A page far behind the first, oldest posts first."""
    found = content.page_by_position(_posts(spark, sf_dir), "date", "asc", offset=150, per_page=37)
    return found.select("id", "position")


@query
def posts_search_indexed(spark, sf_dir):
    index = search_index.build(_posts(spark, sf_dir).select("id", "title", "content"))
    return search_index.search(*index, b.SEARCHED).select("word", "id", "title")


@query
def search_all_per_site_indexed(spark, sf_dir):
    views = {
        ("post", "post"): _site_posts(spark, sf_dir),
        ("term", "category"): content.terms(b.site_term_records(spark, sf_dir)),
    }
    return search_index.search_all(views, b.SEARCHED)


@query
def media_filtered(spark, sf_dir):
    items = content.media_items(b.media_records(spark, sf_dir))
    return content.media_by(items, media_type="image", mime_type="image/png").select("id", "title", "parent", "source_url")


@query
def comments_filtered(spark, sf_dir):
    items = content.comments(b.comment_records(spark, sf_dir))
    return content.comments_by(items, author=0, status="approved").select("id", "post", "parent")


@query
def comments_with_posts(spark, sf_dir):
    items = content.comments(b.comment_records(spark, sf_dir))
    return content.comments_with_posts(items, _posts(spark, sf_dir)).select("id", "post", "post_title", "post_author")


@query
def terms_with_counts(spark, sf_dir):
    terms = content.terms(b.term_records(spark, sf_dir))
    counted = content.terms_with_counts(terms, _posts(spark, sf_dir))
    return content.ordered(content.terms_by(counted), "count", "desc").select("id", "name", "slug", "parent", "count")


@query
def terms_of_post(spark, sf_dir):
    terms = content.terms(b.term_records(spark, sf_dir))
    return content.terms_of_post(terms, _posts(spark, sf_dir), post=33).select("id", "name")


@query
def users_with_roles(spark, sf_dir):
    users = content.users(b.user_records(spark, sf_dir))
    return content.users_with_roles(users, "machinery, building").select("id", "name", "slug")


@query
def authors(spark, sf_dir):
    users = content.users(b.user_records(spark, sf_dir))
    return content.authors(users, _posts(spark, sf_dir)).select("id", "name")


@query
def search_all(spark, sf_dir):
    views = {
        ("post", "post"): _posts(spark, sf_dir),
        ("post", "attachment"): content.media_items(b.media_records(spark, sf_dir)),
        ("term", "category"): content.terms(b.term_records(spark, sf_dir)),
    }
    return content.search_all(views, "red")


def _site_posts(spark, sf_dir):
    return content.posts(b.site_post_records(spark, sf_dir))


@query
def posts_page_per_site(spark, sf_dir):
    found = content.page_per_site(content.with_status(_site_posts(spark, sf_dir)), "date", "desc", page=2, per_page=20)
    return found.select("domain", "place", "id")


@query
def terms_with_counts_per_site(spark, sf_dir):
    terms = content.terms(b.site_term_records(spark, sf_dir))
    return content.terms_with_counts(terms, _site_posts(spark, sf_dir)).select("domain", "id", "name", "count")


@query
def terms_of_post_per_site(spark, sf_dir):
    terms = content.terms(b.site_term_records(spark, sf_dir))
    return content.terms_of_post(terms, _site_posts(spark, sf_dir), post=33, domain="s1.example.com").select("domain", "id", "name")


@query
def authors_per_site(spark, sf_dir):
    users = content.users(b.site_user_records(spark, sf_dir))
    return content.authors(users, _site_posts(spark, sf_dir)).select("domain", "id", "name")


@query
def search_all_per_site(spark, sf_dir):
    views = {
        ("post", "post"): _site_posts(spark, sf_dir),
        ("term", "category"): content.terms(b.site_term_records(spark, sf_dir)),
    }
    return content.search_all(views, "red")


@query
def dictionary_entries(spark, sf_dir):
    documents = pages.dict_documents(b.dict_responses(spark, sf_dir)).where("route = '/wp/v2/types'")
    return content.dictionary_entries(documents).select("domain", "key", "name", "slug")


@query
def error_counts(spark, sf_dir):
    return content.error_counts(content.error_bodies(b.responses(spark, sf_dir)))


@query
def error_messages(spark, sf_dir):
    failed = b.responses(spark, sf_dir).where("status >= 400").select("url", "status", "error").distinct()
    return failed.select("url", "status", failures.api_message(F.col("url"), F.col("status"), F.col("error")).alias("error_message"))


# --- archives written and read back ------------------------------------------------------------


@query
def archive_written(spark, sf_dir):
    out = fresh_dir(spark, "archive")
    sinks.write_records(archived_records(spark, sf_dir), out)
    return captures.read_archive(spark, out)


@query
def documents_written(spark, sf_dir):
    out = fresh_dir(spark, "documents")
    sinks.write_documents(dict_documents(spark, sf_dir), out)
    return spark.read.parquet(out)


@query
def index_snapshot_written(spark, sf_dir):
    out = fresh_dir(spark, "index")
    sinks.write_index_snapshot(b.site_index(spark, sf_dir), out)
    return spark.read.parquet(out).select("domain", (F.length("body") > 0).alias("saved"))


@query
def catalogue_lines_written(spark, sf_dir):
    out = fresh_dir(spark, "catalogue")
    merged = catalogue.merge_catalogue(seed_catalogue(spark), _scanned(spark, sf_dir).where("route IS NOT NULL"))
    sinks.write_catalogue_lines(catalogue.update_lines(merged), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query
def manifest_written(spark, sf_dir):
    out = fresh_dir(spark, "manifest")
    sinks.write_manifest(next_manifest(spark, sf_dir), out)
    saved = spark.read.parquet(out)
    return saved.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_paths"), F.max("last_updated").alias("last_updated")
    )


@query
def sites_read(spark, sf_dir):
    out = fresh_dir(spark, "sites")
    b.sites(spark, sf_dir).write.parquet(out)
    return captures.read_sites(spark, out)


@query
def responses_read(spark, sf_dir):
    """Captures saved twice, read back once each."""
    out = fresh_dir(spark, "responses")
    captured = b.list_responses(spark, sf_dir)
    captured.unionByName(captured).write.parquet(out)
    read = captures.distinct_captures(captures.read_responses(spark, out))
    return read.select("domain", "route", "kind", "page", "attempt", "status")


@query
def statistics_written(spark, sf_dir):
    out = fresh_dir(spark, "statistics")
    sinks.write_statistics(transfer_statistics(spark, sf_dir), out)
    return spark.read.parquet(out)


@query
def media_written(spark, sf_dir):
    """Files fetched, with their URLs as contents."""
    out = fresh_dir(spark, "media")
    fetched = _outcomes(spark, sf_dir).where("fetched")
    sinks.write_media(fetched.withColumn("content", F.encode("source_url", "UTF-8")), out)
    return spark.read.parquet(out).withColumn("content", F.decode("content", "UTF-8"))


# --- whole jobs --------------------------------------------------------------------------------


@query
def ping_job(spark, sf_dir):
    names = b.index_domains(spark, sf_dir).select(F.col("domain").alias("input"))
    return jobs.ping(names, b.site_index(spark, sf_dir))["health"]


@query
def analyze_job(spark, sf_dir):
    return jobs.analyze(b.site_index(spark, sf_dir), seed_catalogue(spark))["statistics"]


@query
def dump_job(spark, sf_dir):
    return jobs.dump(b.site_index(spark, sf_dir), seed_catalogue(spark), b.responses(spark, sf_dir))["records"]


@query
def getfiles_job(spark, sf_dir):
    inputs = (make(spark, sf_dir) for make in (b.item_media, b.manifest, b.existing_files, b.item_transfers))
    return jobs.getfiles(*inputs, now=1.8e9)["manifest"]


# --- streams -----------------------------------------------------------------------------------


@query
def ingest_stream(spark, sf_dir):
    out = fresh_dir(spark, "ingest")
    arriving = b.event_transfers(b.arriving(spark, sf_dir, "events"))
    ingest.save_batches(arriving, out, fresh_dir(spark, "ingest-state"))
    saved = ingest.distinct_arrivals(spark.read.parquet(out), ["domain", "source_url"])
    return saved.select("domain", "source_url", "success", "error", "bytes")


def _progress_text(counts):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return counts.withColumn("window_start", F.date_format("window_start", stamp)).withColumn(
        "window_end", F.date_format("window_end", stamp)
    )


@query
def progress_tumbling(spark, sf_dir):
    transfers = b.event_transfers(b.table(spark, sf_dir, "events"))
    return _progress_text(progress.windowed_progress(transfers, "1 hour"))


@query
def progress_sliding(spark, sf_dir):
    transfers = b.event_transfers(b.table(spark, sf_dir, "events"))
    return _progress_text(progress.windowed_progress(transfers, "1 hour", "30 minutes"))


@query
def progress_sessions(spark, sf_dir):
    transfers = b.event_transfers(b.table(spark, sf_dir, "events"))
    return progress.session_progress(transfers, 30).select(
        "domain",
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"),
        "done",
        "failed",
    )


@query
def progress_stream(spark, sf_dir):
    out = fresh_dir(spark, "progress")
    arriving = b.event_transfers(b.arriving(spark, sf_dir, "events"))
    ingest.save_batches(arriving, out, fresh_dir(spark, "progress-state"), progress.windowed_progress)
    return _progress_text(progress.merge_progress(spark.read.parquet(out)))


@query
def retry_stream(spark, sf_dir):
    out = fresh_dir(spark, "retries")
    arriving = b.list_responses(spark, sf_dir, b.arriving)
    ingest.save_batches(arriving, out, fresh_dir(spark, "retries-state"), retries.retry_state)
    return retries.settled(retries.merge_state(spark.read.parquet(out)))
