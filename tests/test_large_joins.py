"""Joins of tables that grow with the sites are never broadcast, however small Spark takes them for."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitequarry import schemas
from sitequarry.functions import json_shapes
from sitequarry.operators import pages, probe, routes
from sitequarry.plans import jobs, suite
from sitequarry.sources import fetch


@pytest.fixture
def index(spark):
    rows = spark.range(4).selectExpr("concat('d', id) AS domain", "200 AS status", "cast(NULL AS STRING) AS error")
    return rows.withColumn("body", F.lit('{"routes":{"/x":{"endpoints":[{"args":{}}]},"/wp/v2/posts":{"_links":{"self":"http://d/p"}}}}'))


@pytest.fixture
def captured(spark):
    return spark.range(4).selectExpr(
        "concat('d', id) AS domain", "'/wp/v2/posts' AS route", "'list' AS kind", "'http://d/p' AS url", "1 AS page", "1 AS attempt", "200 AS status",
        "map('X-WP-TotalPages', '1') AS headers", "'[{\"id\":1}]' AS body", "cast(NULL AS STRING) AS error", "timestamp_seconds(id) AS fetched_at")


def broadcasts(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_index_and_probe_joins_are_sorted(spark, index, rows):
    found = routes.explode_routes(index)
    wanted = found.select("domain", "route").where("route = '/x'")
    answers = wanted.selectExpr("domain", "route", "explode(array(1, 2)) AS probe", "200 AS status", "'{}' AS body", "cast(NULL AS STRING) AS error")
    present, classified = routes.present_in_index(wanted, found), probe.classify(found, answers)
    for frame in (present, routes.with_definitions(wanted, found), classified, probe.probe_plan(found, answers)):
        assert broadcasts(frame) == 0
    assert rows(present) == [(f"d{i}", "/x") for i in range(4)]
    assert rows(classified.where("route = '/x'"), "domain", "rule") == [(f"d{i}", "no_self_link") for i in range(4)]


def test_page_joins_are_sorted(spark, index, captured, rows):
    known = spark.createDataFrame([("public-list", "/wp/v2/posts")], schemas.KNOWN_ROUTES)
    resolved = pages.resolve_retries(captured)
    plan = captured.select("domain", "route", F.lit("list").alias("action"), "url")
    requests = pages.request_plan(plan, pages.assemble(resolved))
    got = pages.records(captured, resolved, pages.assemble(resolved))
    for frame in (pages.plan_against_captures(requests, captured), got, pages.next_requests(plan, resolved), pages.run_statistics(plan, pages.dict_documents(captured), captured)):
        assert broadcasts(frame) == 0
    assert rows(got, "domain", "record_json") == [(f"d{i}", '{"id":1}') for i in range(4)]
    done = jobs.dump(index, known, captured)
    assert all(broadcasts(done[name]) == 0 for name in ("records", "documents", "files", "statistics"))
    assert rows(done["records"], "domain", "record_json") == [(f"d{i}", '{"id":1}') for i in range(4)]


def test_text_of_definitions_is_not_shuffled(spark, index, rows, tmp_path, capsys):
    found = routes.explode_routes(index)
    wanted, definition = found.select("domain", "route"), json_shapes.route_definition(F.col("route_json"))
    read = routes.with_definitions(wanted, found, endpoints=json_shapes.endpoint_count(definition), args=json_shapes.args_kind(definition))
    assert rows(read) == sorted([(f"d{i}", "/x", 1, "dict") for i in range(4)] + [(f"d{i}", "/wp/v2/posts", None, "missing") for i in range(4)], key=str)
    spark.createDataFrame([(c,) for c in range(1, 40)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    for frame in (read, suite.route_definitions(spark, str(tmp_path))):
        frame.explain("formatted")
        moved = [part for part in capsys.readouterr().out.split("\n\n") if ") Exchange" in part and "hashpartitioning(domain" in part]
        assert len(moved) >= 2 and not any("route_json" in part for part in moved)


def test_pages_are_joined_only_behind_the_first_ones(spark, rows):
    """Routes of 1 to 130 pages with gaps, failures and stops against a plain walk over their pages."""
    many, found, ends, asked = random.Random(5), [], [], {1: [], 4: []}
    for k in range(160):
        length, total = many.choice([1, 3, 61, 62, 63, 64, 130]), many.choice([None, 0, 2, 62, 63, 70])
        missing = {many.randint(1, length + 1) for _ in range(many.choice([0, 1, 2]))}
        stops = {p: many.randint(0, 4) for p in {many.randint(1, length + 9), length} if many.random() < 0.6}
        failed = {many.randint(1, length + 9): many.randint(1, 5) for _ in range(many.choice([0, 0, 1]))}
        got = {p: (failed.get(p), stops.get(p)) for p in range(1, length + 1) if p not in missing}
        if not got:
            continue
        for p, (tries, stop) in got.items():
            found.append((f"d{k}", "/r", p, tries or 1, None if tries else 1, None if tries else 200, None if tries else stop, None if tries or stop else p % 7,
                          None if tries else total if p == 1 else None, None, bool(tries)))
        good = {p: stop for p, (tries, stop) in got.items() if not tries}
        total = total if 1 in good else None
        first_stop = min((p for p, stop in good.items() if stop is not None), default=None)
        end = min((x for x in (first_stop, total or None) if x), default=None)
        whole = end is not None and all(p in good for p in range(1, end + 1))
        kept = 0 if not whole else end - 1 if first_stop is not None and first_stop <= end else end
        ends.append((f"d{k}", "complete" if whole else "dropped", kept, sum(p % 7 for p in range(1, kept + 1) if not good[p])))
        page = next(p for p in range(1, length + 2) if p not in good)
        if (first_stop and first_stop < page) or (total and page > total) or (page in got and got[page][0] >= 5):
            continue
        for ahead, wanted in asked.items():
            last = page if ahead == 1 else max(page, min(x for x in (total or page + ahead - 1, first_stop and first_stop - 1) if x is not None))
            for p in range(page, last + 1):
                if p not in good and (got[p][0] if p in got else 0) < 5:
                    wanted.append((f"d{k}", p, (got[p][0] if p in got else 0) + 1))
    resolved = spark.createDataFrame(found, "domain string, route string, page int, tries bigint, attempt int, status int, stop int, n_records bigint, "
                                     "total_pages bigint, total_records bigint, failed boolean")  # fmt: skip
    outcomes, plan = pages.assemble(resolved), resolved.select("domain", "route", F.lit("list").alias("action"), F.lit("u").alias("url")).distinct()
    summary = pages.route_summary(resolved, outcomes)
    assert rows(summary, "domain", "outcome", "pages_kept", "records_written") == sorted(ends, key=str)
    for ahead, wanted in asked.items():
        assert rows(pages.next_requests(plan, resolved, ahead=ahead), "domain", "page", "attempt") == sorted(wanted, key=str)
    joins = summary._jdf.queryExecution().optimizedPlan().toString()
    # the pages are joined twice, once for those behind the first ones; outcomes are made once
    assert joins.count("Join LeftOuter") == 2 and "Join Inner" not in joins and joins.count(f"> {pages.FIRST_PAGES})") >= 1


def test_answers_leave_in_bounded_batches():
    schema = ["domain", "route", "kind", "url", "page", "attempt"]
    asked = pa.RecordBatch.from_pylist([dict(zip(schema, ("d", "/r", "list", str(i), i, 1), strict=True)) for i in range(3000)])
    short = list(fetch.gathered(iter([asked]), lambda url: (200, {"a": "b"}, url)))
    assert [b.num_rows for b in short] == [1024, 1024, 952]
    assert [x for b in short for x in b.column("body").to_pylist()] == [str(i) for i in range(3000)]
    long = list(fetch.gathered(iter([asked.slice(0, 9)]), lambda url: (200, {}, "x" * (1 << 19))))
    assert max(b.num_rows for b in long) == 2 and sum(b.num_rows for b in long) == 9
    tried = list(fetch.gathered(iter([asked.slice(0, 1)]), lambda url, n: (503 if n < 3 else 200, {}, ""), tell_attempt=True, tries=5))
    assert [n for b in tried for n in b.column("attempt").to_pylist()] == [1, 2, 3]
    one = list(fetch.answers(iter([asked.slice(0, 5)]), lambda url: (200, {}, url)))
    assert [b.num_rows for b in one] == [1] * 5


def test_a_dispatch_makes_columns_in_one_generator(spark, index, rows):
    known = spark.createDataFrame([("public-list", "/wp/v2/posts")], schemas.KNOWN_ROUTES)
    found = routes.explode_routes(index).localCheckpoint()
    done = routes.dispatch(found, known)
    # the other one deals the catalogue
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2
    assert rows(done.where("domain = 'd0'"), "route", "action", "skip_reason") == [("/wp/v2/posts", "list", None), ("/x", "skip", "no_self_link")]
