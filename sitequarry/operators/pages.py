"""Paged responses to records: planning, retries, assembly, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import failures, json_shapes, text, urls
from sitequarry.operators.skew import by_sort
from sitequarry.schemas import PAGE_SIZE, RETRY_COUNT

ROUTE = ["domain", "route"]
PAGE = ["domain", "route", "page"]

# Pages per join group. A route may have any number of pages, so joins between pages and routes
# go by (domain, route, block of pages) and no group outgrows one task.
PAGE_BLOCK = 65536

# Pages of a route whose presence is kept as bits of one number. Only pages behind them are joined to tell which are there.
FIRST_PAGES = 62

# The largest page number.
MOST_PAGES = 2**31 - 1

# What ends a route at a page, in the order it is tested.
STOPS = ["status", "invalid_json", "dict", "empty_list", "other_type"]


def request_plan(routes: DataFrame, page_counts: DataFrame | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per page of each list route with `url`.

    `page_counts(domain, route, total_pages)` gives the pages known so far; other routes get page 1, and so do those
    that announce more pages than a page number can count. A route of many pages is spread over tasks by blocks.
    """
    planned = routes.where("action = 'list'").select("domain", "route", "url")
    if page_counts is None:
        planned = planned.withColumn("pages", F.lit(1).cast("bigint"))
    else:
        known = F.when(F.col("total_pages").between(1, MOST_PAGES), F.col("total_pages"))
        planned = planned.join(by_sort(page_counts.select(*ROUTE, "total_pages")), ROUTE, "left").withColumn(
            "pages", F.coalesce(known, F.lit(1)).cast("bigint")
        )
    blocks = planned.withColumn("block", F.explode(_blocks_up_to(F.col("pages")))).repartition(*ROUTE, "block")
    first = F.col("block") * PAGE_BLOCK + 1
    inside = F.sequence(first, F.least("pages", first + (PAGE_BLOCK - 1)))
    rows = blocks.select("domain", "route", "url", F.explode(inside).alias("page"))
    return rows.select(
        "domain",
        "route",
        F.lit("list").alias("kind"),
        urls.page_url(F.col("url"), F.col("page"), page_size).alias("url"),
        F.col("page").cast("int").alias("page"),
        F.lit(1).alias("attempt"),
    )


def next_requests(
    routes: DataFrame, pages: DataFrame, retry_count: int = RETRY_COUNT, page_size: int = PAGE_SIZE, ahead: int = 1
) -> DataFrame:
    """What a run asks for next: for each open list route its first page without a success, and the attempt's number.

    `pages` comes from resolve_retries. A route is closed by a page that stops it, by the announced number of pages, or
    by a first open page whose tries are used up. With `ahead` over 1 the pages behind the first are asked for too: up to the announced
    number, or `ahead` in all where none is announced; pages that have an answer or no try left are not asked for again.
    """
    planned = routes.where("action = 'list' AND domain IS NOT NULL AND route IS NOT NULL").select(*ROUTE, "url")
    good = pages.where("NOT failed")
    # the first page without a success lies in the first pages, or behind one that has them all
    far = good.where(F.col("page") > FIRST_PAGES).select(*PAGE)
    after = good.where((F.col("page") >= FIRST_PAGES) & F.col("stop").isNull()).select(*ROUTE, (F.col("page") + 1).alias("page"))
    behind = after.join(by_sort(far), PAGE, "left_anti").groupBy(*ROUTE).agg(F.min("page").alias("behind"))
    ends = pages.groupBy(*ROUTE).agg(
        F.min(F.when(~F.col("failed") & F.col("stop").isNotNull(), F.col("page"))).alias("first_stop"),
        F.max("total_pages").alias("total_pages"),
        _first_pages(~F.col("failed")).alias("had"),
    )
    tried = pages.where("failed").select(*PAGE, "tries")
    announced = F.when(F.col("total_pages") != 0, F.greatest("total_pages", F.lit(1)))
    in_a_row = F.bit_count(F.expr("had & ~(had + 1)"))
    page = F.when(in_a_row == FIRST_PAGES, F.col("behind")).otherwise(in_a_row + 1).cast("int")
    begun = planned.join(by_sort(ends), ROUTE, "left").join(by_sort(behind), ROUTE, "left").withColumn("had", F.coalesce("had", F.lit(0).cast("bigint")))
    is_open = ~F.coalesce((F.col("first_stop") < F.col("page")) | (F.col("page") > announced), F.lit(False))
    joined = begun.withColumn("page", page).where("page IS NOT NULL").join(by_sort(tried), PAGE, "left")
    wanted = joined.where(is_open & (F.coalesce("tries", F.lit(0)) < retry_count))
    if ahead > 1:
        known = F.when(announced <= MOST_PAGES, announced)
        last = F.least(F.coalesce(known, F.col("page") + (ahead - 1)), F.col("first_stop") - 1)
        spans = wanted.select(*ROUTE, "url", "page", F.greatest("page", last).cast("bigint").alias("last"))
        # long spans are cut into blocks before they become pages
        blocks = spans.withColumn("block", F.explode(F.sequence(_block(F.col("page")), _block(F.col("last"))))).repartition(*ROUTE, "block")
        begin = F.greatest(F.col("page").cast("bigint"), F.col("block") * PAGE_BLOCK + 1)
        inside = F.sequence(begin, F.least("last", (F.col("block") + 1) * PAGE_BLOCK))
        spread = blocks.select(*ROUTE, "url", F.explode(inside).alias("page")).withColumn("page", F.col("page").cast("int"))
        known = spread.join(by_sort(pages.select(*PAGE, "failed", "tries")), PAGE, "left")
        wanted = known.where(F.coalesce("failed", F.lit(True)) & (F.coalesce("tries", F.lit(0)) < retry_count))
    return wanted.select(
        *ROUTE,
        F.lit("list").alias("kind"),
        urls.page_url(F.col("url"), F.col("page"), page_size).alias("url"),
        "page",
        (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("attempt"),
    )


def plan_against_captures(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """Plan rows with the number of captured attempts; pages without any are not fetched."""
    seen = responses.where("kind = 'list'").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("attempts"))
    return plan.join(by_sort(seen), PAGE, "left").select(
        *PAGE, "url", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.col("attempts").isNotNull().alias("fetched")
    )


def resolve_retries(responses: DataFrame, retry_count: int = RETRY_COUNT) -> DataFrame:
    """Per page the first success among at most `retry_count` tries.

    Bodies are judged where they are read; only numbers reach the shuffle, and they are reduced
    before it. (domain, route, page, attempt) is the key of `responses`.
    """
    body = F.col("body")
    # nearly all bodies are lists that one parse tells and counts
    shape = F.when(F.col("counted").isNotNull(), "list").otherwise(json_shapes.json_shape(body))
    n_records = F.coalesce("counted", F.when(F.col("shape") == "list", json_shapes.list_length(body)))
    stop = (
        F.when(F.col("status") != 200, 0)
        .when(F.col("shape") == "invalid", 1)
        .when(F.col("shape") == "dict", 2)
        .when(F.col("n_records") == 0, 3)
        .when(F.col("shape") != "list", 4)
    )
    good = failures.is_success(F.col("status"), F.col("error")) & (F.col("attempt") <= retry_count)
    read = (
        responses.where("kind = 'list' AND page >= 1")
        .withColumn("tried", F.when(F.col("attempt") <= retry_count, 1).otherwise(0))
        .withColumn("won", F.when(good, F.col("attempt")))
    )
    # a body matters only if its response may win with status 200
    read = (
        read.withColumn("body", F.when((F.col("status") == 200) & F.col("won").isNotNull(), body))
        .withColumn("counted", json_shapes.strict_list_length(F.col("body")))
        .withColumn("shape", shape)
        .withColumn("n_records", n_records)
        .select(
            *PAGE,
            "tried",
            "won",
            "status",
            F.when(F.col("won").isNotNull(), stop).alias("stop"),
            "n_records",
            _first_page_number("X-WP-TotalPages").alias("total_pages"),
            _first_page_number("X-WP-Total").alias("total_records"),
        )
    )

    def of_winner(name: str) -> Column:
        return F.min_by(name, "won").alias(name)

    names = ["status", "stop", "n_records", "total_pages", "total_records"]
    pages = read.groupBy(*PAGE).agg(
        F.sum("tried").alias("tries"), F.min("won").alias("attempt"), *[of_winner(n) for n in names]
    )
    return pages.withColumn("failed", F.col("attempt").isNull())


def merge_resolved(parts: DataFrame) -> DataFrame:
    """One row per page out of what resolve_retries gave for different tries of it."""
    names = ["status", "stop", "n_records", "total_pages", "total_records"]
    pages = parts.groupBy(*PAGE).agg(
        F.sum("tries").alias("tries"), F.min("attempt").alias("attempt"), *[F.min_by(n, "attempt").alias(n) for n in names]
    )
    return pages.withColumn("failed", F.col("attempt").isNull())


def _first_page_number(name: str) -> Column:
    """Totals are taken from page 1 with status 200 only."""
    return F.when((F.col("page") == 1) & (F.col("status") == 200), json_shapes.header_number(F.col("headers"), name))


def assemble(pages: DataFrame) -> DataFrame:
    """Per list route, where its pages end and how many are kept.

    `pages` comes from resolve_retries. A page that failed or was never captured before the end
    drops the whole route. pages_reported is the count as logged by a run, one too low when the
    announced number of pages ends the route.
    """
    usable = ~F.col("failed")
    is_stop = usable & F.col("stop").isNotNull()
    total = F.max("total_pages")
    ends = pages.groupBy(*ROUTE).agg(
        F.min(F.when(is_stop, F.col("page"))).alias("first_stop"),
        F.min_by(F.col("stop"), F.when(is_stop, F.col("page"))).alias("stop"),
        F.min(F.when(F.col("failed"), F.col("page"))).alias("first_failed"),
        F.count(F.lit(1)).alias("n_seen"),
        F.max("page").alias("last_seen"),
        total.alias("total_pages"),
        F.max("total_records").alias("total_records"),
        _first_pages(F.lit(True)).alias("seen"),
    )
    announced = F.when(F.col("total_pages") != 0, F.greatest("total_pages", F.lit(1)))
    ends = ends.withColumn("end_page", F.least("first_stop", announced))
    # without gaps the counters decide; with gaps the pages up to the end must be counted
    in_reach = F.coalesce(
        (F.col("end_page") <= F.col("last_seen"))
        & (F.col("first_failed").isNull() | (F.col("first_failed") > F.col("end_page"))),
        F.lit(False),
    )
    ends = ends.withColumn("in_reach", in_reach).withColumn("gaps", F.col("n_seen") < F.col("last_seen"))
    # the routes to count behind their first pages get their blocks of pages, the others a NULL block that joins nothing
    blocks = F.when(F.col("in_reach") & F.col("gaps") & (F.col("end_page") > FIRST_PAGES), _blocks_up_to(F.col("end_page")))
    numbered = pages.where(F.col("page") > FIRST_PAGES).select(*PAGE, _block(F.col("page")).alias("block"))
    counted = ends.select("*", F.explode_outer(blocks).alias("block")).join(by_sort(numbered), [*ROUTE, "block"], "left")
    kept_columns = [c for c in ends.columns if c not in ROUTE]
    joined = counted.groupBy(*ROUTE).agg(
        F.count_if(F.col("page") <= F.col("end_page")).alias("n_behind"), *[F.first(c).alias(c) for c in kept_columns]
    )
    among_first = F.bit_count(F.expr(f"seen & (shiftleft(1L, cast(least(end_page, {FIRST_PAGES}) AS INT)) - 1)"))
    # routes without a name join nothing anywhere
    named = F.col("domain").isNotNull() & F.col("route").isNotNull()
    joined = joined.withColumn("n_present", F.col("n_behind") + F.when(named, among_first).otherwise(0))
    complete = F.col("in_reach") & (~F.col("gaps") | (F.col("n_present") == F.col("end_page")))
    by_stop = F.coalesce(F.col("first_stop") <= F.col("end_page"), F.lit(False))
    reason = F.when(by_stop, F.element_at(F.lit(STOPS), F.col("stop") + 1)).otherwise("total_pages")
    kept = F.when(by_stop, F.col("end_page") - 1).otherwise(F.col("end_page"))
    return joined.select(
        *ROUTE,
        F.when(complete, "complete").otherwise("dropped").alias("outcome"),
        F.when(complete, reason).otherwise("failed_page").alias("stop_reason"),
        F.when(complete, F.col("end_page")).alias("end_page"),
        F.when(complete, kept).otherwise(0).cast("bigint").alias("pages_kept"),
        F.when(complete, F.col("end_page") - 1).cast("bigint").alias("pages_reported"),
        "total_pages",
        "total_records",
    )


def _first_pages(condition: Column) -> Column:
    """Bits of the first pages for which the condition holds, page 1 the lowest; 0 if there is none."""
    bit = F.expr("shiftleft(1L, page - 1)")
    return F.bit_or(F.when(condition & (F.col("page") <= FIRST_PAGES), bit).otherwise(F.lit(0).cast("bigint")))


def _block(page: Column) -> Column:
    return F.floor((page - 1) / PAGE_BLOCK).cast("bigint")


def _blocks_up_to(page: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), _block(page))


def _pages_up_to(routes: DataFrame, last: str) -> DataFrame:
    """A row for each page of the given routes from page 1 to the route's page number `last`; long routes are spread by blocks."""
    blocks = routes.where(F.col(last) >= 1).withColumn("block", F.explode(_blocks_up_to(F.col(last)))).repartition(*ROUTE, "block")
    first = F.col("block") * PAGE_BLOCK + 1
    inside = F.sequence(first, F.least(last, first + (PAGE_BLOCK - 1)))
    return blocks.select(*ROUTE, F.explode(inside).alias("page")).withColumn("page", F.col("page").cast("int"))


def dropped_routes(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'dropped'").select(*ROUTE)


def kept_pages(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The page rows, with their winning attempt, whose records a route keeps.

    The kept pages of the routes go to where the page rows of their key are, so what keeps pages together is good for bodies too.
    """
    complete = outcomes.where("outcome = 'complete'").select(*ROUTE, "pages_kept")
    return pages.select(*PAGE, "attempt", "n_records").join(by_sort(_pages_up_to(complete, "pages_kept")), PAGE)


def records(responses: DataFrame, pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records of all kept pages: domain, route, out_name, page, idx, record_json.

    Bodies are shuffled once, by page, so a large route spreads over many tasks; those of a table in buckets of pages are not shuffled. A kept page was won with status 200 by
    a body that is no error, so those of failed tries stay where they are read.
    """
    kept = kept_pages(pages, outcomes).select(*PAGE, F.col("attempt").alias("won"))
    bodies = responses.where("kind = 'list' AND status = 200 AND error IS NULL").select(*PAGE, "attempt", "body")
    same = [bodies[c] == kept[c] for c in PAGE]
    # a page has few tries; as a difference the try is no key of the join, whose keys are then those of the buckets
    joined = bodies.join(by_sort(kept), same[0] & same[1] & same[2] & (F.col("attempt") - F.col("won") == 0))
    # the name is made once a page
    named = joined.select(*[bodies[c] for c in PAGE], "body").withColumn("out_name", urls.output_name(F.col("route"), F.lit("list")))
    return named.select(
        *ROUTE, "out_name", "page", F.posexplode(json_shapes.list_records(F.col("body"))).alias("idx", "record_json")
    )


def in_server_order(record_rows: DataFrame) -> DataFrame:
    return record_rows.orderBy("domain", "route", "page", "idx")


def dict_documents(responses: DataFrame) -> DataFrame:
    """Dict routes: one try; the body is kept on status 200, an error skips the route."""
    first = responses.where("kind = 'dict' AND attempt = 1")
    success = failures.is_success(F.col("status"), F.col("error"))
    return first.select(
        "domain",
        "route",
        urls.output_name(F.col("route"), F.lit("dict")).alias("out_name"),
        F.when(success, "processed").otherwise("skipped").alias("outcome"),
        F.when(success & (F.col("status") == 200), F.col("body")).alias("body"),
    )


def route_summary(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records and pages per list route; the announced total of records wins over the count."""
    # outcomes are read once: they go with their routes through the join that counts records
    blocks = F.when((F.col("outcome") == "complete") & (F.col("pages_kept") >= 1), _blocks_up_to(F.col("pages_kept")))
    told = ["pages_kept", "pages_reported", "total_records"]
    spread = outcomes.select(*ROUTE, "outcome", *told, F.explode_outer(blocks).alias("block"))
    numbered = pages.where("n_records IS NOT NULL").select(*PAGE, "n_records", _block(F.col("page")).alias("block"))
    # the outcome, a text, is a key: as a value it would have rows sorted before they are added up
    counted = spread.join(by_sort(numbered), [*ROUTE, "block"], "left").groupBy(*ROUTE, "outcome").agg(
        F.sum(F.when(F.col("page") <= F.col("pages_kept"), F.col("n_records"))).cast("bigint").alias("n_records"), *[F.first(c).alias(c) for c in told]
    )
    complete = F.col("outcome") == "complete"
    n_records = F.coalesce("n_records", F.lit(0))
    return counted.select(
        *ROUTE,
        "outcome",
        F.when(complete, n_records).otherwise(0).cast("bigint").alias("records_written"),
        F.when(complete, F.coalesce("total_records", n_records)).cast("bigint").alias("records_reported"),
        "pages_kept",
        "pages_reported",
    )


def run_statistics(dispatched: DataFrame, documents: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Per site the routes processed, skipped and in total, with the time taken.

    A list route counts as processed even when it was dropped; a dict route that failed counts as
    skipped. A dict route that was not captured has failed.
    """
    joined = dispatched.select("domain", "route", "action").join(
        by_sort(documents.select("domain", "route", "outcome")), ROUTE, "left"
    )
    processed = (F.col("action") == "list") | (
        (F.col("action") == "dict") & (F.coalesce("outcome", F.lit("skipped")) == "processed")
    )
    stats = joined.groupBy("domain").agg(
        F.count_if(processed).alias("routes_processed"),
        F.count_if(~processed).alias("routes_skipped"),
        F.count(F.lit(1)).alias("total_routes"),
    )
    if responses is None:
        return stats
    micros = F.unix_micros("fetched_at")
    times = responses.groupBy("domain").agg(((F.max(micros) - F.min(micros)) / 1e6).alias("elapsed"))
    timed = stats.join(by_sort(times), "domain", "left").withColumn("elapsed", F.coalesce("elapsed", F.lit(0.0)))
    return timed.withColumn("elapsed_text", text.duration_text(F.col("elapsed")))
