"""Some registered queries next to their SQL at the smallest scale; check_results.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry_points
from check_results import compare

FOLDER = "/root/testdata/sf0.001"

NAMES = [
    "domain_cleaning", "site_health", "index_routes", "routes_dispatched", "category_statistics", "unknown_preview",
    "page_assembly", "archived_records", "run_statistics", "probe_classification", "catalogue_scan", "media_targets",
    "transfer_statistics", "next_manifest", "posts_view", "terms_with_counts", "progress_tumbling",
]


def test_every_query_has_sql_and_the_flagship_runs(spark):
    assert set(entry_points.QUERIES) == set(entry_points.ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    if os.path.isdir(FOLDER):
        assert "useless" in entry_points.entry(spark).columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    outcome = compare(spark, FOLDER, name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert outcome.startswith("same"), outcome
    assert "types" not in outcome
