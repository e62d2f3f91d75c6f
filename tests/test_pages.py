import json
import random

from pyspark.sql import functions as F

from sitequarry import schemas
from sitequarry.operators import pages, routes
from sitequarry.operators.pages import assemble, resolve_retries

COLUMNS = schemas.RESPONSES


def capture(spark, answers):
    """Rows of (route, page, attempt, status, body[, headers[, error]]) as list responses."""
    full = []
    for route, page, attempt, status, body, *rest in answers:
        headers, error = (list(rest) + [None, None])[:2]
        full.append(("d", route, "list", "U", page, attempt, status, headers, body, error, None))
    return spark.createDataFrame(full, COLUMNS)


def outcomes(spark, answers, retry_count=5):
    return {r.route: r for r in assemble(resolve_retries(capture(spark, answers), retry_count)).collect()}


TOTAL = "x-wp-TotalPages"


def test_stops(spark):
    full = "[1,2]"
    answers = [
        ("empty", 1, 1, 200, full), ("empty", 2, 1, 200, full), ("empty", 3, 1, 200, "[]"),
        ("total", 1, 1, 200, full, {TOTAL: "2"}), ("total", 2, 1, 200, full), ("total", 3, 1, 200, full),
        ("dict", 1, 1, 200, '{"a":1}'),
        ("scalar", 1, 1, 200, full), ("scalar", 2, 1, 200, "3"),
        ("text", 1, 1, 200, full), ("text", 2, 1, 200, '"[]"'),
        ("status", 1, 1, 200, full), ("status", 2, 1, 204, ""),
        ("invalid", 1, 1, 200, full), ("invalid", 2, 1, 200, "[1"),
        ("zero", 1, 1, 200, full, {TOTAL: "0"}), ("zero", 2, 1, 200, "[]"),
        ("word", 1, 1, 200, full, {TOTAL: "abc"}), ("word", 2, 1, 200, "[]"),
        ("negative", 1, 1, 200, full, {TOTAL: "-3"}),
        ("one", 1, 1, 200, full, {TOTAL: " 1 "}), ("late", 1, 1, 200, full), ("late", 2, 1, 200, full, {TOTAL: "2"}),
        ("late", 3, 1, 200, "[]"),
        ("fails", 1, 1, 200, full, {TOTAL: "3"}), ("fails", 2, 1, 200, full), ("fails", 3, 1, 500, None),
        ("gap", 1, 1, 200, full, {TOTAL: "3"}), ("gap", 3, 1, 200, full),
        ("gap-after", 1, 1, 200, "[]"), ("gap-after", 5, 1, 200, full),
        ("no-first", 2, 1, 200, full), ("endless", 1, 1, 200, full), ("endless", 2, 1, 200, full),
        ("past-end", 1, 1, 200, full), ("past-end", 2, 1, 400, '{"code":"x"}'),
        ("short", 1, 1, 200, full, {TOTAL: "4"}),
    ]
    found = {k: (r.stop_reason, r.pages_kept, r.pages_reported) for k, r in outcomes(spark, answers).items()}
    dropped = ("failed_page", 0, None)
    assert found == {
        "empty": ("empty_list", 2, 2), "total": ("total_pages", 2, 1), "dict": ("dict", 0, 0), "scalar": ("other_type", 1, 1),
        "text": ("other_type", 1, 1), "status": ("status", 1, 1), "invalid": ("invalid_json", 1, 1),
        "zero": ("empty_list", 1, 1), "word": ("empty_list", 1, 1), "negative": ("total_pages", 1, 0),
        "one": ("total_pages", 1, 0), "late": ("empty_list", 2, 2), "fails": dropped, "gap": dropped,
        "gap-after": ("empty_list", 0, 0), "no-first": dropped, "endless": dropped, "past-end": dropped, "short": dropped,
    }


def test_retries(spark):
    answers = [("third", 1, 1, 503, None), ("third", 1, 2, None, None, None, "Timeout"), ("third", 1, 3, 200, "[]"),
               ("third", 1, 4, 200, "[1]")]
    answers += [("sixth", 1, a, 500, None) for a in range(1, 6)] + [("sixth", 1, 6, 200, "[]")]
    frame = capture(spark, answers)
    found = {r.route: (r.attempt, r.failed, r.tries) for r in resolve_retries(frame).collect()}
    assert found == {"third": (3, False, 4), "sixth": (None, True, 5)}
    assert {r.failed for r in resolve_retries(frame, retry_count=0).collect()} == {True}
    assert outcomes(spark, answers, retry_count=2)["third"].outcome == "dropped"


def walk(answers, retry_count):
    """One page after the other, as a crawl of one route sees the captured answers."""
    by_page = {}
    for _, page, attempt, status, body, headers in answers:
        by_page.setdefault(page, {})[attempt] = (status, body, headers)
    kept, page, total = [], 0, None
    while True:
        page += 1
        tries = [by_page.get(page, {}).get(a) for a in range(1, retry_count + 1)]
        got = next((t for t in tries if t and t[0] < 400), None)
        if got is None:
            return None
        status, body, headers = got
        if status != 200:
            return kept
        if page == 1 and headers:
            total = int(headers[TOTAL])
        data = json.loads(body)
        if not isinstance(data, list) or not data:
            return kept
        kept += [(page, i, json.dumps(x)) for i, x in enumerate(data)]
        if total and page >= total:
            return kept


def test_assembly_against_a_walk_over_random_captures(spark):
    draw = random.Random(5)
    by_route = {}
    for n in range(150):
        answers = []
        for page in range(1, draw.randint(1, 6) + 1):
            if draw.random() < 0.08:
                continue
            for attempt in range(1, draw.randint(1, 4) + 1):
                status = draw.choice([200, 200, 200, 503, 204])
                body = draw.choice(['[{"a":1},{"b":2}]', '[{"c":3}]', "[1,\"x\",null]", "[]", "{}", "3"])
                headers = {TOTAL: str(draw.randint(0, 5))} if draw.random() < 0.5 else None
                answers.append((f"r{n}", page, attempt, status, body, headers))
        if answers:
            by_route[f"r{n}"] = answers
    frame = capture(spark, [a for answers in by_route.values() for a in answers]).cache()
    for retry_count in (2, 5):
        resolved = resolve_retries(frame, retry_count)
        ends = assemble(resolved)
        wanted = {r: walk(a, retry_count) for r, a in by_route.items()}
        assert {r.route: r.outcome == "complete" for r in ends.collect()} == {r: w is not None for r, w in wanted.items()}
        found = {}
        for r in pages.in_server_order(pages.records(frame, resolved, ends)).collect():
            found.setdefault(r.route, []).append((r.page, r.idx, json.dumps(json.loads(r.record_json))))
        assert found == {r: w for r, w in wanted.items() if w}
        summary = {r.route: r.records_written for r in pages.route_summary(resolved, ends).collect()}
        assert summary == {r: len(w or []) for r, w in wanted.items()}


def test_long_routes_are_counted_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGE_BLOCK", 3)
    answers = [("whole", p, 1, 200, "[1]", {TOTAL: "10"} if p == 1 else None) for p in range(1, 11)]
    answers += [("holed", p, 1, 200, "[1]", {TOTAL: "10"} if p == 1 else None) for p in range(1, 11) if p != 7]
    answers += [("after", p, 1, 200, "[1]", {TOTAL: "5"} if p == 1 else None) for p in range(1, 11) if p != 7]
    frame = capture(spark, answers)
    resolved = resolve_retries(frame)
    ends = assemble(resolved)
    assert {r.route: r.pages_kept for r in ends.collect()} == {"whole": 10, "holed": 0, "after": 5}
    counts = pages.records(frame, resolved, ends).groupBy("route").count()
    assert {r.route: r["count"] for r in counts.collect()} == {"whole": 10, "after": 5}


def test_summary_prefers_the_announced_total(spark):
    frame = capture(spark, [("a", 1, 1, 200, "[1,2]", {TOTAL: "1", "X-WP-Total": "70"}), ("b", 1, 1, 200, "[1,2]", {TOTAL: "1"})])
    resolved = resolve_retries(frame)
    rows = {r.route: (r.records_reported, r.records_written) for r in pages.route_summary(resolved, assemble(resolved)).collect()}
    assert rows == {"a": (70, 2), "b": (2, 2)}


def test_dicts_and_run_statistics(spark):
    def dict_row(route, attempt, status, body, error=None):
        return ("d", route, "dict", "U", 1, attempt, status, None, body, error, None)

    frame = spark.createDataFrame(
        [dict_row("/ok", 1, 200, "{}"), dict_row("/moved", 1, 204, ""), dict_row("/gone", 1, 404, "{}"),
         dict_row("/net", 1, None, None, "Timeout"), dict_row("/net", 2, 200, "{}")], COLUMNS)
    documents = pages.dict_documents(frame)
    assert {r.route: (r.outcome, r.body) for r in documents.collect()} == {
        "/ok": ("processed", "{}"), "/moved": ("processed", None), "/gone": ("skipped", None), "/net": ("skipped", None),
    }
    planned = spark.createDataFrame(
        [("d", r, a) for r, a in [("/ok", "dict"), ("/moved", "dict"), ("/gone", "dict"), ("/net", "dict"), ("/dropped", "list"),
                                  ("/never", "dict"), ("/s", "skip")]], "domain string, route string, action string")
    stats = pages.run_statistics(planned, documents, frame).first()
    assert (stats.routes_processed, stats.routes_skipped, stats.total_routes) == (3, 4, 7)
    assert stats.elapsed_text == "0s"


def test_plan_of_the_literal_dump_case(spark):
    definition = {"_links": {"self": {"href": "U"}}, "endpoints": [{"args": {"page": {}, "per_page": {}}}]}
    table = spark.createDataFrame([("d", "/wp/v2/posts", 0, json.dumps(definition))],
                                  "domain string, route string, route_pos int, route_json string")
    known = spark.createDataFrame([("public-list", "/wp/v2/posts"), ("public-dict", "/wp/v2/types")], schemas.KNOWN_ROUTES)
    planned = routes.dispatch(table, known)
    assert [(r.route, r.action) for r in planned.collect()] == [("/wp/v2/posts", "list")]
    counts = spark.createDataFrame([("d", "/wp/v2/posts", 3)], "domain string, route string, total_pages bigint")
    plan = pages.request_plan(planned, counts, page_size=10)
    assert sorted(r.url for r in plan.collect()) == [f"U?page={p}&order=asc&orderby=id&per_page=10" for p in (1, 2, 3)]
    captured = capture(spark, [("/wp/v2/posts", 1, 1, 200, "[1]")])
    fetched = {r.page: r.fetched for r in pages.plan_against_captures(plan, captured).collect()}
    assert fetched == {1: True, 2: False, 3: False}


def test_next_requests_and_huge_headers(spark):
    kinds = "domain string, route string, action string, url string"
    routes = spark.createDataFrame([("d", r, "list", "https://d" + r) for r in ("/new", "/open", "/again", "/used", "/stopped", "/told", "/gap")], kinds)
    rows = [("/open", 1, False, None, 1, None), ("/open", 2, False, None, 1, None), ("/again", 1, True, None, 2, None), ("/used", 1, True, None, 5, None),
            ("/stopped", 1, False, None, 1, None), ("/stopped", 2, False, 3, 1, None), ("/told", 1, False, None, 1, 2), ("/told", 2, False, None, 1, None),
            ("/gap", 1, False, None, 1, None), ("/gap", 3, False, None, 1, None)]
    seen = spark.createDataFrame([("d", *r) for r in rows], "domain string, route string, page int, failed boolean, stop int, tries long, total_pages long")
    assert {(r.route, r.page, r.attempt) for r in pages.next_requests(routes, seen).collect()} == {("/new", 1, 1), ("/open", 3, 1), ("/again", 1, 3), ("/gap", 2, 1)}
    counts = spark.createDataFrame([("d", "/open", 9_000_000_000_000), ("d", "/told", 150_000), ("d", "/gap", 3)], "domain string, route string, total_pages long")
    planned = pages.request_plan(routes, counts).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last"))
    assert {r.route: (r.n, r["last"]) for r in planned.collect()} == {
        "/new": (1, 1), "/open": (1, 1), "/again": (1, 1), "/used": (1, 1), "/stopped": (1, 1), "/told": (150_000, 150_000), "/gap": (3, 3),
    }
