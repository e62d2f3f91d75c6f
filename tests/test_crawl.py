import shutil
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitequarry import schemas
from sitequarry.operators import pages
from sitequarry.plans import bindings as b
from sitequarry.plans import crawl, jobs
from sitequarry.sources import fetch
from sitequarry.sources.catalogue import seed_catalogue

KINDS = 5
ROUTES = b.CRAWL_ROUTES[:2]


@pytest.fixture
def index(spark):
    bodies = []
    for c in range(2 * KINDS):
        parts = ",".join(b._piece(r, "list", "paginated").replace("@", f"k{c}.example.org") for r in b.CRAWL_ROUTES)
        bodies.append((f"k{c}.example.org", 200, None, f'{{"routes":{{{parts}}}}}'))
    return spark.createDataFrame(bodies, "domain string, status int, error string, body string")


def one_after_the_other(index):
    """What a run of one site after the other asks for and gets, until it stops by itself."""
    rows = []
    for site in sorted(r.domain for r in index.collect()):
        for route in ROUTES:
            page, announced = 0, None
            while True:
                page += 1
                url = f"https://{site}/wp-json{route}?page={page}&order=asc&orderby=id&per_page=100"
                for attempt in range(1, 6):
                    try:
                        status, headers, body = b.answer(url, attempt)
                        rows.append((site, route, "list", url, page, attempt, status, headers, body, None))
                    except ConnectionError as failure:
                        status, body = None, None
                        rows.append((site, route, "list", url, page, attempt, None, None, None, f"ConnectionError: {failure}"))
                    if status == 200:
                        break
                if status != 200 or not body.startswith("[{"):
                    break
                announced = int(headers["X-WP-TotalPages"]) if page == 1 and headers else announced
                if announced and page >= announced:
                    break
    return rows


def results(done):
    records = Counter(tuple(r) for r in done["records"].select("domain", "route", "page", "idx", "record_json").collect())
    ends = Counter(tuple(r) for r in done["outcomes"].select("domain", "route", "outcome", "pages_kept").collect())
    documents = Counter(tuple(r) for r in done["documents"].select("domain", "route", "outcome", "body").collect())
    return records, ends, documents


def test_crawl_gives_what_full_captures_give(spark, index, tmp_path):
    captured = spark.createDataFrame(one_after_the_other(index), schemas.RESPONSES.replace(", fetched_at TIMESTAMP", ""))
    captured = captured.withColumn("fetched_at", F.current_timestamp())
    records, ends, _ = results(jobs.dump(index, seed_catalogue(spark), captured))
    assert len(records) == 2 * 2 * (3 * 14 + 10) and ends["k2.example.org", ROUTES[0], "dropped", 0] == 1
    straight = crawl.dump(index, seed_catalogue(spark), b.answer, str(tmp_path / "a"), tell_attempt=True)
    got = results(straight)
    assert got[0] == records and got[1] == ends
    assert got[2] == Counter({(f"k{c}.example.org", "/wp/v2/types", "processed", f'{{"site":{c}}}'): 1 for c in range(10)})
    # tries of a page are no more than the same run takes, and pages end soon behind what it asks for
    tries = captured.groupBy("domain", "route", "page").agg(F.count(F.lit(1)).alias("n"))
    found = crawl.crawl(index, seed_catalogue(spark), b.answer, str(tmp_path / "a"), tell_attempt=True)
    mine = found.where("kind = 'list'").groupBy("domain", "route", "page").agg(F.count(F.lit(1)).alias("m"))
    both = mine.join(tries, ["domain", "route", "page"], "full").collect()
    assert all(r.n is None or r.n == r.m for r in both) and max(r.page for r in both) <= 15


def test_crawl_goes_on_behind_the_last_whole_round(spark, index, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def noted(url, attempt):
        (asked / f"{abs(hash(url))}-{attempt}-{len(list(asked.iterdir()))}").touch()
        return b.answer(url, attempt)

    folder, known = str(tmp_path / "run"), seed_catalogue(spark)
    how = {"folder": folder, "tell_attempt": True, "tasks": 3, "per_site": 1}
    whole = crawl.crawl(index, known, noted, **{**how, "folder": str(tmp_path / "other")}).count()
    before = len(list(asked.iterdir()))
    assert crawl.crawl(index, known, noted, most_rounds=2, **how).count() < whole
    # the third round broke off while its answers were written
    crawl.crawl(index, known, noted, most_rounds=3, **how)
    shutil.rmtree(f"{folder}/pages/round-000002")
    (tmp_path / "run/responses/round-000002/_SUCCESS").unlink()
    seen = {p: (tmp_path / f"run/responses/round-00000{p}/_SUCCESS").stat().st_mtime_ns for p in (0, 1)}
    assert crawl.crawl(index, known, noted, **how).count() == whole
    assert {p: (tmp_path / f"run/responses/round-00000{p}/_SUCCESS").stat().st_mtime_ns for p in (0, 1)} == seen
    # nothing is open: another call asks for nothing
    after = len(list(asked.iterdir()))
    assert crawl.crawl(index, known, noted, **how).count() == whole and len(list(asked.iterdir())) == after > before


def test_requests_ahead(spark):
    routes = spark.createDataFrame([("d", r, "list", f"http://d{r}") for r in ("/new", "/told", "/untold", "/gap", "/shut", "/done")], "domain string, route string, action string, url string")
    state = [
        ("/told", 1, 1, 1, None, 70_000, False), ("/told", 3, 1, 1, None, None, False), ("/untold", 1, 2, 2, None, None, False),
        ("/gap", 1, 1, 1, None, None, False), ("/gap", 2, 3, None, None, None, True), ("/gap", 4, 1, 1, 3, None, False),
        ("/shut", 1, 5, None, None, None, True), ("/done", 1, 1, 1, None, 1, False),
    ]
    known = spark.createDataFrame([("d", r, p, t, a, stop, n, f) for r, p, t, a, stop, n, f in state],
                                  "domain string, route string, page int, tries long, attempt int, stop int, total_pages long, failed boolean")
    got = defaultdict(dict)
    for r in pages.next_requests(routes, known, ahead=4).collect():
        got[r.route][r.page] = r.attempt
    assert got["/new"] == dict.fromkeys(range(1, 5), 1) and got["/untold"] == dict.fromkeys(range(2, 6), 1)
    assert sorted(got["/told"]) == [2, *range(4, 70_001)] and got["/gap"] == {2: 4, 3: 1}
    assert not got["/shut"] and not got["/done"]
    first = {r.route: (r.page, r.attempt) for r in pages.next_requests(routes, known).collect()}
    assert first == {"/new": (1, 1), "/told": (2, 1), "/untold": (2, 1), "/gap": (2, 4)}


def plan_batch(n):
    return pa.RecordBatch.from_pylist([{"domain": "d", "route": "/r", "kind": "list", "url": str(i), "page": i, "attempt": 1} for i in range(n)])


def test_answers_leave_one_by_one():
    asked = []
    found = fetch.answers(iter([plan_batch(5000)]), lambda url: asked.append(url) or (200, {"a": "b"}, "x" * 1000))
    times = []
    for k, batch in zip(range(1, 50), found, strict=False):
        assert batch.num_rows == 1 and len(asked) == k
        times.append(batch.column("fetched_at")[0].value)
    assert times == sorted(times)
    tried = list(fetch.answers(iter([plan_batch(1)]), lambda url, n: (503 if n < 3 else 200, {}, ""), tell_attempt=True, tries=5))
    assert [t.column("attempt")[0].as_py() for t in tried] == [1, 2, 3]


def test_lanes_are_few_per_site_and_fair(spark):
    plan = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'big' ELSE concat('s', id % 50) END AS domain", "'/r' AS route", "'list' AS kind",
                                        "'u' AS url", "cast(id AS INT) AS page", "1 AS attempt")
    dealt = fetch.lanes(plan, tasks=8, per_site=2).collect()
    lanes = defaultdict(set)
    for r in dealt:
        lanes[r.domain].add(r.lane)
    assert max(len(x) for x in lanes.values()) <= 2 and len({r.lane for r in dealt}) == 8
    big = Counter(r.lane for r in dealt if r.domain == "big")
    assert len(big) == 2 and min(big.values()) > 800
    # in the big site's lanes the others' requests come among its first
    done = fetch.fetch(plan, lambda url: (200, {}, ""), tasks=8, per_site=2).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    order = defaultdict(list)
    for r in done.orderBy("place").collect():
        order[r.part].append(r.domain)
    for part in order.values():
        if "big" in part:
            others = [k for k, d in enumerate(part) if d != "big"]
            assert not others or max(others) < 800
