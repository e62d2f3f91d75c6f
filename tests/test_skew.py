import pytest
from pyspark.sql import functions as F

from sitequarry.operators import media, skew


@pytest.fixture
def shuffled(spark):
    """No broadcasts and nothing split at run time."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def large(spark):
    """One site holds half of all rows."""
    return spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'big' WHEN id % 997 = 1 THEN NULL ELSE concat('s', id % 300) END AS domain", "id", "concat('p', id) AS path")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("known", [True, False])
def test_spread_join_is_a_join(spark, shuffled, rows, how, known):
    rows_, small = large(spark), spark.createDataFrame([("big", 1), ("s7", 2), ("s9", 3), ("none", 4), (None, 5)], "domain string, n int")
    heavy = skew.heavy_keys(rows_, ["domain"], share=10) if known else None
    got = skew.spread_join(rows_, small, ["domain"], how, by=["id"], heavy=heavy)
    want = rows_.join(small, "domain", how)
    columns = [*rows_.columns, *(["n"] if how in ("left", "inner") else [])]
    assert got.columns == columns and rows(got) == rows(want, *columns)


def rows_of_tasks(joined):
    # the sum keeps the join from being left out
    return sorted(r.rows for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"), F.sum("n")).collect())


def test_no_task_has_much_more_than_others(spark, shuffled):
    rows_ = large(spark)
    small = rows_.select("domain").distinct().withColumn("n", F.lit(1))
    heavy = skew.heavy_keys(rows_, ["domain"])
    assert heavy.where("domain = 'big'").count() == 1 and heavy.count() < 1000
    for given in (heavy, None):
        got = skew.spread_join(rows_, small, ["domain"], "left", by=["id"], heavy=given, parts=128)
        n = rows_of_tasks(got)
        assert len(n) == 8 and n[-1] <= 2 * n[4], n
    assert rows_of_tasks(rows_.join(small, "domain", "left"))[-1] > 10_000


def test_unsafe_targets_are_not_downloaded(spark):
    lines = spark.createDataFrame([("d", f"http://c/{p}") for p in ("a.jpg", "x/../../b.jpg", "there/../c.jpg")], "domain string, source_url string")
    targets = media.with_targets(lines)
    there = spark.createDataFrame([("d", "d/files/there/../c.jpg", 1)], "domain string, path string, length bigint")
    empty = spark.createDataFrame([], "domain string, path string, last_updated double")
    plan = {r.source_url[9:]: (r.skip_reason, r.already_there, r.download) for r in media.download_plan(targets, empty, there).collect()}
    assert plan == {"a.jpg": (None, False, True), "x/../../b.jpg": ("unsafe_path", False, False), "there/../c.jpg": ("unsafe_path", False, False)}


def test_last_transfers_are_of_one_row(spark):
    rows_ = [("d", "u", False, "HTTP 500", None), ("d", "u", False, "HTTP 404", 7), ("d", "v", True, None, 3), ("d", "v", False, "late", 9)]
    moved = spark.createDataFrame(rows_, "domain string, source_url string, success boolean, error string, bytes bigint").withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    got = {r.source_url: (r.success, r.error, r.bytes) for r in media.last_transfers(moved).collect()}
    assert got == {"u": (False, "HTTP 404", 7), "v": (True, None, 3)}
