import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from sitequarry.functions import json_shapes
from sitequarry.operators import pages
from sitequarry.plans import bindings as b
from sitequarry.session import shared_dir, stored
from sitequarry.sources import captures, checkpoints, trees

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")
def test_bodies_in_buckets_are_not_shuffled(spark, tmp_path, rows):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        given = b.responses(spark, FOLDER)
        table = captures.store_responses(given, "responses_of_test", str(tmp_path / "table"), 4)
        resolved = pages.resolve_retries(table)
        # retries: no exchange at all
        assert "Exchange" not in plan_of(resolved) and "Bucketed: true" in plan_of(resolved)
        outcomes = pages.assemble(resolved)
        records = pages.records(table, resolved, outcomes)
        plan = plan_of(records)
        # the scan that brings bodies for records, and what stands above it up to their join
        lines = plan.splitlines()
        scan = max(k for k, line in enumerate(lines) if "FileScan" in line and "body#" in line and "headers#" not in line)
        depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
        above, level = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        joins = [k for k, line in enumerate(above) if "SortMergeJoin" in line]
        assert joins and not any("Exchange" in line for line in above[: joins[0]])
        plain = pages.resolve_retries(given)
        assert rows(pages.assemble(resolved)) == rows(pages.assemble(plain))
        want = pages.records(given, plain, pages.assemble(plain))
        assert rows(records, *want.columns) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("DROP TABLE IF EXISTS responses_of_test")


def outcomes(spark, rows_):
    return spark.createDataFrame(rows_, "domain string, target_path string, outcome string, fetched boolean")


def test_checkpoint_grows_by_additions(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert checkpoints.read(spark, folder).count() == 0
    checkpoints.compact(spark, folder)
    assert checkpoints.read(spark, folder).count() == 0
    checkpoints.start(spark.createDataFrame([("a", "a/1", 1.0), ("a", "a/1", 0.5), ("b", "b/1", 2.0), ("n", "n/1", None)], "domain string, path string, last_updated double"), folder)
    read = lambda: sorted((r.domain, r.path, r.last_updated) for r in checkpoints.read(spark, folder).collect())
    assert read() == [("a", "a/1", 1.0), ("b", "b/1", 2.0), ("n", "n/1", None)]
    assert checkpoints.add(outcomes(spark, [("a", "a/2", "downloaded", True), ("a", "a/1", "skipped", False), ("b", "b/1", "skipped", False)]), folder, 5.0) == 1
    first = [("a", "a/1", 5.0), ("a", "a/2", 5.0), ("b", "b/1", 2.0), ("n", "n/1", None)]
    assert read() == first
    # only what is new was written
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/paths-000001").select("domain", "path").collect()] == [("a", "a/2")]
    # a run that broke off before its times were there did not happen
    spark.createDataFrame([("x", "x/1", 1.0)], "domain string, path string, last_updated double").write.parquet(f"{folder}/paths-000002")
    assert read() == first
    checkpoints.compact(spark, folder)
    assert read() == first and checkpoints._versions(spark, folder, "base") == [0, 1]
    assert checkpoints.add(outcomes(spark, [("b", "b/2", "failed", False), ("c", "c/1", "downloaded", True), ("c", "c/1", "downloaded", True)]), folder, 7.0) == 2
    assert read() == [("a", "a/1", 5.0), ("a", "a/2", 5.0), ("b", "b/1", 7.0), ("c", "c/1", 7.0), ("n", "n/1", None)]


def test_trees_are_listed_by_tasks(spark, tmp_path, rows):
    files = {"a.com/files/x/y/z/1.bin": 3, "a.com/files/2.bin": 0, "b.com/files/.hidden": 2, "b.com/data/n.json": 5, "c.com/other": 1, "top.txt": 9}
    for path, n in files.items():
        place = tmp_path / "sites" / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"x" * n)
    top = str(tmp_path / "sites")
    assert rows(trees.files_below(spark, top)) == sorted(files.items(), key=str)
    assert rows(captures.file_inventory(spark, f"file://{top}")) == [("a.com", "a.com/files/2.bin", 0), ("a.com", "a.com/files/x/y/z/1.bin", 3), ("b.com", "b.com/files/.hidden", 2)]
    assert rows(trees.sites_below(spark, top)) == [("a.com",), ("b.com",), ("c.com",)]
    assert trees.files_below(spark, str(tmp_path / "none")).count() == 0 == captures.file_inventory(spark, str(tmp_path / "none")).count()


def test_checkpoints_under_a_name_with_a_dot(spark, tmp_path, rows):
    for site, text in {"a.com": {"downloaded_files": ["a.com/files/é"], "last_updated": 2.5}, "b.com": {}}.items():
        (tmp_path / site).mkdir()
        (tmp_path / site / ".own_checkpoint.json").write_text(json.dumps(text, ensure_ascii=False), encoding="utf8")
    (tmp_path / "c.com").mkdir()
    found = captures.read_checkpoints(spark, str(tmp_path), ".own_checkpoint.json")
    assert rows(found) == [("a.com", "a.com/files/é", 2.5)]
    assert found.where(F.col("domain") == "c.com").count() == 0


def test_shuffles_of_a_stored_table_are_gone(spark, tmp_path):
    def shuffle_bytes():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [top.apply(i) for i in range(top.length())]
        return sum(f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))

    spark.sparkContext._jvm.System.gc()
    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    texts = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("text"))
    before = shuffle_bytes()
    assert stored(texts.repartition(3, "text"), "freed").count() == 20_000
    deadline = time.time() + 20  # files go behind the query's back
    while shuffle_bytes() - before > 500_000 and time.time() < deadline:
        time.sleep(0.2)
    # the texts are 2.5 MB
    assert shuffle_bytes() - before < 500_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == held
    assert shared_dir(spark)


def test_responses_are_stored_in_rounds(spark, tmp_path, rows):
    given = spark.createDataFrame(
        [(f"d{i % 7}" if i % 11 else None, f"/r{i % 3}", i % 50 + 1, i % 2 + 1, "é" * (i % 5)) for i in range(500)] * 2,
        "domain string, route string, page int, attempt int, body string",
    )
    try:
        for _ in range(2):  # what was there before is replaced
            table = captures.store_responses(given, "responses_of_rounds", str(tmp_path / "t"), 3)
        assert rows(table) == rows(given)
        files = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
        assert 3 < len(files) <= 3 * captures.STORING_ROUNDS and all(".zstd." in f for f in files)
        # the tries of a page are in one bucket
        buckets = table.select("domain", "route", "page", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5})\.", 1).alias("bucket")).distinct()
        assert buckets.groupBy("domain", "route", "page").count().where("count > 1").count() == 0
        assert buckets.select("bucket").distinct().count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS responses_of_rounds")


def test_one_parse_tells_a_list(spark):
    texts = ["[]", " [1, [2]]\n", "[1],[2]", "[1] x", "[1]],[[2]", "['a']", "[NaN]", '["a\tb"]', '["it\'s", null]', "[1,]", "{}", "3", "", None, '["\\\'"]']
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, body string")
    body = F.col("body")
    found = frame.select("i", json_shapes.strict_list_length(body).alias("n"), json_shapes.json_shape(body).alias("shape"), json_shapes.list_length(body).alias("length")).collect()
    assert {r.i: r.n for r in found if r.n is not None} == {0: 0, 1: 2, 8: 2}
    assert all(r.shape == "list" and r.n == r.length for r in found if r.n is not None)
    # what only the other way takes is a list still
    odd = frame.where("i IN (1, 5, 14)").selectExpr(
        "'d' AS domain", "'/r' AS route", "'list' AS kind", "i + 1 AS page", "1 AS attempt", "200 AS status",
        "cast(NULL AS map<string,string>) AS headers", "body", "cast(NULL AS string) AS error",
    )
    assert {r.page: (r.stop, r.n_records) for r in pages.resolve_retries(odd).collect()} == {2: (None, 2), 6: (1, None), 15: (None, 1)}
