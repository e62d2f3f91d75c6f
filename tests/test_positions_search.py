import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitequarry.operators import content, positions, search_index
from sitequarry.session import fresh_dir
from sitequarry.sources import captures, sinks


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_positions_over_ranges(spark, order):
    items = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 13).alias("k"), "id").repartition(5)
    rows = [(r.k, r.id) for r in items.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=order == "desc")
    keys = positions.sort_keys(["k", "id"], order)
    got = {r.id: r.position for r in positions.with_positions(items, keys, parts=7).collect()}
    assert got == {i: n for n, (_, i) in enumerate(rows, 1)}
    saved, before = positions.placed(items, keys, parts=7)
    for skip, count in ((0, 10), (137, 200), (495, 30), (500, 5), (0, 500), (3, 0)):
        page = positions.page_at(saved, before, skip, count)
        assert [r.id for r in page.orderBy("position").collect()] == [i for _, i in rows[skip : skip + count]]
    # only the ranges of the page are read
    plan = positions.page_at(saved, before, 137, 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert positions.with_positions(items.limit(0), keys).count() == 0
    assert content.page_by_position(items.withColumnRenamed("k", "date"), page=2, per_page=50, order=order).count() == 50


def test_search_index_finds_what_a_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 3)
    dice = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "été", "語語語", "a\nb c", "aaaa", "x", "\U00010348\U00010348\U00010348!"]
    rows = [(i, None if i % 11 == 0 else " ".join(dice.choices(words, k=dice.randint(0, 3))), None if i % 7 == 0 else "".join(dice.choices(words, k=dice.randint(0, 4)))) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, title string, content string").repartition(4)
    sought = ["alpha", "ALPHABETA", "ta GA", "aaa", "語語語", "語語", "\U00010348\U00010348\U00010348", "x", "", "nowhere", "été", "a\nb", "b c", "betaété"]
    index = search_index.build(items)
    got = sorted((r.word, r.id) for r in search_index.search(*index, sought).collect())
    want = sorted((w, r.id) for w in sought for r in content.search(items, w).collect())
    assert got == want and {w for w, _ in got} >= {"alpha", "x", "", "aaa"}
    assert index[1].agg(F.max("n")).first()[0] <= 3
    assert search_index.search(*index, []).count() == 0 == search_index.search(*index, ["nowhere"]).count()
    assert search_index.search(*search_index.build(items.limit(0)), ["alpha", "x"]).count() == 0


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    dice = random.Random(2)
    texts = {
        "a.com": "".join(f'{{"id":{i},"pad":"{"é" * dice.randint(0, 60)}"}}\n' for i in range(900)),
        "b.com": "\n\none\r\ntwo\n\nlast", "c.com": "", "d.com": "x\n" * 5,
    }
    for site, text in texts.items():
        folder = tmp_path / site / "data"
        folder.mkdir(parents=True)
        (folder / "wp_v2_media.jsonl").write_bytes(text.encode())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        lines = captures.read_media_lines(spark, str(tmp_path))
        got = {(r.domain, r.line_no): r.raw for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    want = {}
    for site, text in texts.items():
        with open(tmp_path / site / "data/wp_v2_media.jsonl", encoding="utf8") as file:
            want |= {(site, n): line.rstrip("\n") for n, line in enumerate(file, 1)}
    assert got == want and len(want) == 911


def test_files_are_written_to_their_paths(spark, tmp_path):
    rows = [("a.com/files/x/1.bin", b"one"), ("a.com/files/2.bin", b""), ("b.com/files/n.bin", None), ("a.com/files/../../out", b"no"), ("b.com/files/", b"no"), (None, b"no")]
    done = sinks.write_files(spark.createDataFrame(rows, "target_path string, content binary"), str(tmp_path / "top"))
    got = {r.target_path: (r.length, r.error) for r in done.collect()}
    assert got == {"a.com/files/x/1.bin": (3, None), "a.com/files/2.bin": (0, None), "b.com/files/n.bin": (0, None),
                   "a.com/files/../../out": (None, "unsafe path"), "b.com/files/": (None, "unsafe path"), None: (None, "unsafe path")}
    there = {str(p.relative_to(tmp_path / "top")): p.read_bytes() for p in (tmp_path / "top").rglob("*") if p.is_file()}
    assert there == {"a.com/files/x/1.bin": b"one", "a.com/files/2.bin": b"", "b.com/files/n.bin": b""}
    again = sinks.write_files(spark.createDataFrame([("a.com/files/2.bin", b"new")], "target_path string, content binary"), str(tmp_path / "top"))
    assert again.first().error is None and (tmp_path / "top/a.com/files/2.bin").read_bytes() == b"new"
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_lists_are_made_before_the_shuffle(spark, monkeypatch):
    dice = random.Random(4)
    letters = "abÉéİ\U0001f600\x00 "
    texts = [(i, "".join(dice.choices(letters, k=dice.randint(0, 30))), None if i % 5 == 0 else "ab" * dice.randint(0, 9)) for i in range(40)]
    monkeypatch.setattr(search_index, "HELD", 50)
    items = spark.createDataFrame([(i, t, c) for i, t, c in texts], "id int, title string, content string").coalesce(1)
    saved, lists = search_index.build(items)
    lowered = {(r.block, r.no): (r.t, r.c) for r in saved.selectExpr("block", "no", "lower(title) AS t", "lower(content) AS c").collect()}
    want = {}
    for (block, no), own in lowered.items():
        for text in own:
            for k in range(len(text or "") - 2):
                want.setdefault((text[k : k + 3], block), set()).add(no)
    got = {(r.gram, r.block): (r.n, r.nos) for r in lists.collect()}
    assert got == {key: (len(nos), sorted(nos)) for key, nos in want.items()} and len(got) > 100
    assert lists.count() == len(got)
    # one item: no more parts than grams, where each gram of each item was a row of the shuffle before
    batch = pa.RecordBatch.from_pydict({"block": [7, 7, 8], "no": [0, 1, 0], "t": ["abcabc", "abc", "abc"]})
    monkeypatch.setattr(search_index, "HELD", 1 << 21)
    rows = [r for part in search_index._lists(iter([batch])) for r in part.to_pylist()]
    assert sorted((r["gram"], r["block"], r["nos"]) for r in rows) == [("abc", 7, [0, 1]), ("abc", 8, [0]), ("bca", 7, [0]), ("cab", 7, [0])]
