from datetime import datetime

from sitequarry import schemas
from sitequarry.operators import media
from sitequarry.plans import jobs

LINES = [
    '{"source_url": "http://example.com/file1.jpg"}', '{"source_url": "http://example.com/file2.jpg"}', '{"other":"data"}',
    "", "invalid json", '{"source_url":null}', "3", "[1]", '{"source_url":false}', '{"a":1,"source_url":"http://x/z.jpg","a":2}',
]


def lines(spark, raws, domain="d"):
    return spark.createDataFrame([(domain, i, r) for i, r in enumerate(raws)], schemas.MEDIA)


def files(spark, *paths):
    return spark.createDataFrame([("d", f"d/files/{p}", 1) for p in paths], schemas.EXISTING_FILES)


def checkpoint(spark, *paths):
    return spark.createDataFrame([("d", f"d/files/{p}", 1.0) for p in paths], schemas.MANIFEST)


def transfers(spark, **outcomes):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("d", f"http://x/{u}.jpg", ok, None if ok else "boom", 10 if ok else None, at) for u, ok in outcomes.items()],
        schemas.TRANSFERS,
    )


def urls(*names):
    return [f'{{"source_url":"http://x/{n}.jpg"}}' for n in names]


def test_lines(spark):
    frame = lines(spark, LINES)
    assert [r.source_url for r in media.media_urls(frame).orderBy("line_no").collect()] == [
        "http://example.com/file1.jpg", "http://example.com/file2.jpg", "http://x/z.jpg"]
    assert {r.line_no: r.reject_reason for r in media.media_rejects(frame).collect()} == {
        2: "no_source_url", 3: "blank", 4: "invalid_json", 5: "null_source_url", 6: "not_an_object", 7: "not_an_object",
        8: "source_url_is_no_text"}


def run(spark, raws, listed, existing, outcomes, resume=True):
    done = jobs.getfiles(lines(spark, raws), checkpoint(spark, *listed), files(spark, *existing), outcomes, now=9.0, resume=resume)
    stats = done["statistics"].first()
    counts = stats and (stats.downloaded, stats.failed, stats.skipped, stats.total)
    manifest = {r.path.split("/")[-1]: r.last_updated for r in done["manifest"].collect()}
    return counts, manifest, done


def test_resume_needs_a_checkpoint_that_is_not_empty(spark):
    ok = transfers(spark, a=True, b=True, c=False)
    # nothing listed: the file that exists counts as downloaded and is not added to the checkpoint
    assert run(spark, urls("a", "b"), [], ["a.jpg"], ok)[:2] == ((2, 0, 0, 2), {"b.jpg": 9.0})
    # something listed: what exists is skipped
    assert run(spark, urls("a", "b", "c"), ["z.jpg"], ["a.jpg"], ok)[:2] == ((1, 1, 1, 3), {"z.jpg": 9.0, "b.jpg": 9.0})
    # without resuming the checkpoint is neither read nor written
    assert run(spark, urls("a", "b"), ["b.jpg"], ["a.jpg"], ok, resume=False)[:2] == ((2, 0, 0, 2), {"b.jpg": 1.0})
    # nothing left: the checkpoint stays as it was
    assert run(spark, urls("a"), ["a.jpg"], [], ok)[:2] == ((0, 0, 1, 1), {"a.jpg": 1.0})


def test_repeats_count_and_failures_are_listed(spark):
    counts, _, done = run(spark, urls("a", "a", "c"), [], [], transfers(spark, a=True, c=False))
    assert counts == (2, 1, 0, 3)
    failed = done["failed"].collect()
    assert [(r.source_url, r.error) for r in failed] == [("http://x/c.jpg", "boom")]
    assert "Failed to download" in failed[0].error_message


def test_no_urls_give_no_statistics_row(spark):
    assert run(spark, ["", "3"], ["a.jpg"], [], transfers(spark, a=True))[:2] == (None, {"a.jpg": 1.0})


def test_last_transfer_counts(spark):
    rows = [("d", "http://x/a.jpg", False, "boom", None, datetime(2024, 1, 1)), ("d", "http://x/a.jpg", True, None, 5, datetime(2024, 1, 2))]
    assert run(spark, urls("a"), [], [], spark.createDataFrame(rows, schemas.TRANSFERS))[0] == (1, 0, 0, 1)


def test_targets(spark):
    table = spark.createDataFrame(
        [("d", 1, "http://a/x.jpg?1"), ("d", 2, "http://b/x.jpg"), ("d", 3, "http://b/x.jpg"), ("d", 4, "http://b/../y.jpg"), ("d", 5, "http://b")],
        "domain string, line_no bigint, source_url string")
    targets = media.with_targets(table)
    assert [tuple(r) for r in media.target_collisions(targets).collect()] == [("d", "d/files/x.jpg", 2)]
    flags = {r.line_no: (r.unsafe_path, r.empty_path) for r in targets.collect()}
    assert flags[4] == (True, False) and flags[5] == (False, True) and flags[1] == (False, False)


def test_missing_list_and_present_files(spark):
    sites = spark.createDataFrame([("d",), ("e",)], "domain string")
    missing = media.missing_media(sites, lines(spark, ["x"])).collect()
    assert [(r.domain, r.error_kind) for r in missing] == [("e", "media_missing")]
    targets = media.with_targets(media.media_urls(lines(spark, urls("a", "b", "c"))))
    present = media.present_but_not_checkpointed(targets, checkpoint(spark, "b.jpg"), files(spark, "a.jpg", "b.jpg"))
    assert [r.source_url for r in present.collect()] == ["http://x/a.jpg"]
    expected = spark.createDataFrame([("d", "d/files/a.jpg", 7)], "domain string, target_path string, bytes bigint")
    assert media.wrong_lengths(files(spark, "a.jpg", "b.jpg"), expected).first().expected_length == 7


def test_checkpoint_and_files_are_made_once_for_each_use(spark):
    """Plans over tables that are costly to make: no table is made again for counts of its sites."""
    paths = "concat('d', id % 2) AS domain", "concat('d', id % 2, '/files/', id) AS path"
    listed = spark.range(0, 31).selectExpr(*paths, "1.0D AS last_updated")
    there = spark.range(0, 37).selectExpr(*paths, "5L AS length")
    targets = spark.range(0, 41).selectExpr("concat('d', id % 2) AS domain", "concat('http://x/', id) AS source_url", "concat('d', id % 2, '/files/', id) AS target_path")

    def made(frame, size):
        return frame._jdf.queryExecution().optimizedPlan().toString().count(f"Range (0, {size},")

    plan = media.download_plan(targets, listed, there)
    assert (made(plan, 31), made(plan, 37), made(plan, 41)) == (2, 1, 1)
    assert {tuple(r) for r in plan.groupBy("skip_reason").count().collect()} == {("in_checkpoint", 31), ("file_exists", 6), (None, 4)}
    done = targets.selectExpr("domain", "target_path", "'downloaded' AS outcome", "true AS fetched")
    after = media.next_manifest(listed, done, now=2.0)
    assert (made(after, 31), made(after, 41)) == (1, 2)
    assert {tuple(r) for r in after.groupBy("last_updated").count().collect()} == {(2.0, 41)}


def test_getfiles_makes_outcomes_once(spark):
    lines_ = spark.range(0, 11).selectExpr("'d' AS domain", "id AS line_no", """concat('{"source_url":"http://x/', id, '.jpg"}') AS raw""")
    moved = spark.range(0, 13).selectExpr("'d' AS domain", "concat('http://x/', id, '.jpg') AS source_url", "true AS success",
                                          "cast(NULL AS string) AS error", "7L AS bytes", "timestamp_seconds(id) AS ts")
    found = jobs.getfiles(lines_, checkpoint(spark, "0.jpg"), files(spark, "1.jpg"), moved, now=2.0)
    for name in ("statistics", "manifest", "failed"):
        plan = found[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (0, 11," not in plan and "Range (0, 13," not in plan
    assert found["statistics"].first().downloaded == 9 and found["manifest"].count() == 10
