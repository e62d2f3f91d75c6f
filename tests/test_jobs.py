import os
import re

import pytest
from pyspark.sql import functions as F

from sitequarry.plans import bindings as b
from sitequarry.plans import jobs
from sitequarry.sources.catalogue import seed_catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")


def test_ping(spark):
    done = jobs.ping(b.sites(spark, FOLDER), b.site_index(spark, FOLDER))
    assert done["health"].where("ok").count() == 0 and done["health"].count() > 0
    assert done["rejected"].where("error_message IS NULL").count() == 0


def test_analyze_counts_add_up(spark):
    done = jobs.analyze(b.site_index(spark, FOLDER), seed_catalogue(spark), b.probes(spark, FOLDER))
    parts = sum((F.col(c) for c in ("public_list", "public_dict", "useless", "unknown")), F.col("protected"))
    assert done["statistics"].where(parts != F.col("total_routes")).count() == 0
    n_unknown = done["unknown"].count()
    assert done["statistics"].agg(F.sum("unknown")).first()[0] == n_unknown == done["proposed"].count()
    assert done["preview"].where("place > 10").count() == 0
    lines = done["catalogue_lines"].groupBy("is_route").count().collect()
    assert {r.is_route: r["count"] for r in lines}[1] == n_unknown


def test_dump_counts_add_up(spark):
    done = jobs.dump(b.site_index(spark, FOLDER), seed_catalogue(spark), b.responses(spark, FOLDER))
    stats = done["statistics"]
    assert stats.where("routes_processed + routes_skipped <> total_routes").count() == 0
    written = done["summary"].agg(F.sum("records_written")).first()[0]
    assert done["records"].count() == written
    # one file per name, and a name overwritten has a later writer
    files = done["files"]
    names = files.select("domain", "out_name").distinct().count()
    assert files.where("NOT overwritten").count() == names < files.count()
    # what is saved under a name comes from that writer only
    saved = done["documents"].where("body IS NOT NULL").select("domain", "out_name", "route")
    saved = saved.unionByName(done["records"].select("domain", "out_name", "route")).distinct()
    assert saved.groupBy("domain", "out_name").count().where("count > 1").count() == 0
    lost = files.where("overwritten").select("domain", "route")
    assert saved.join(lost, ["domain", "route"], "left_semi").count() == 0 < saved.count()


def test_getfiles_counts_add_up(spark):
    done = jobs.getfiles(b.item_media(spark, FOLDER), b.manifest(spark, FOLDER), b.existing_files(spark, FOLDER),
                         b.item_transfers(spark, FOLDER), now=2.0e9)
    assert done["statistics"].where("downloaded + failed + skipped <> total").count() == 0
    assert done["rejects"].count() == 0
    assert done["manifest"].count() >= b.manifest(spark, FOLDER).count()


def test_filters_on_responses_stay_small(spark):
    """A method of over 8000 bytes is left to the Java interpreter."""
    found = b.list_responses(spark, FOLDER).where("status = 200 AND error IS NULL").select("domain", "route", "page", "attempt", "body")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        debug = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug
        text = getattr(debug, "package$").__getattr__("MODULE$").codegenString(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_pages_of_routes_that_are_not_wanted_stay_out(spark, rows):
    known = seed_catalogue(spark)
    some = jobs.dump(b.site_index(spark, FOLDER), known, b.responses(spark, FOLDER), include_unknown=False)
    wanted = some["plan"].where("action = 'list'").select("domain", "route")
    assert some["pages"].join(wanted, ["domain", "route"], "left_anti").count() == 0 < some["pages"].count()
    assert some["outcomes"].join(wanted, ["domain", "route"], "left_anti").count() == 0
    assert some["records"].join(wanted, ["domain", "route"], "left_anti").count() == 0 < some["records"].count()
    # what is kept has no shuffle of page rows by route: the kept pages of routes go to the page rows
    plan = some["records"]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(domain" in line and "attempt" not in line]
    assert sum("page#" in line for line in moved) == 3
