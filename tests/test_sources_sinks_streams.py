from datetime import datetime, timedelta

from sitequarry import schemas
from sitequarry.operators import pages
from sitequarry.session import fresh_dir, shared_dir
from sitequarry.sources import captures, fetch, sinks
from sitequarry.streaming import ingest, progress, retries


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf8")


def test_saved_sites_are_read(spark, tmp_path, rows):
    write(tmp_path, "a.com/data/wp-json.json", '{"routes":\n{"/x":{}}}')
    write(tmp_path, "a.com/data/wp_v2_media.jsonl", '{"source_url":"http://x/1"}\n\n{"source_url":"http://x/2"}\n')
    write(tmp_path, "b.com/checkpoint.json", '{"downloaded_files": ["b.com/files/1", "b.com/files/2"], "last_updated": 5.5}')
    write(tmp_path, "c.com/checkpoint.json", '{"downloaded_files": ["c')
    write(tmp_path, "b.com/files/up/1.jpg", "12345")
    write(tmp_path, "sites.txt", "A.com\nb.com\n")
    path = str(tmp_path)
    assert rows(captures.read_sites(spark, f"{path}/sites.txt", "text")) == [("A.com",), ("b.com",)]
    index = captures.read_index_files(spark, path).first()
    assert (index.domain, index.status) == ("a.com", 200) and "routes" in index.body
    assert [r.raw for r in captures.read_media_lines(spark, path).orderBy("line_no").collect()][1] == ""
    assert rows(captures.read_checkpoints(spark, path)) == [("b.com", "b.com/files/1", 5.5), ("b.com", "b.com/files/2", 5.5)]
    inventory = captures.file_inventory(spark, path)
    assert rows(inventory) == [("b.com", "b.com/files/up/1.jpg", 5)]
    assert "content" not in inventory.columns


def test_fetch_keeps_failures_as_rows(spark):
    def transport(url):
        if url.endswith("bad"):
            raise TimeoutError("slow")
        return 200, {"X-WP-Total": "2"}, f"[{len(url)}]"

    plan = spark.createDataFrame([("d", "/a", "list", "http://a", 1, 1), ("d", "/b", "list", "http://bad", 1, 1)],
                                 "domain string, route string, kind string, url string, page int, attempt int")
    found = fetch.fetch(plan, transport, tasks=2)
    assert found.schema.simpleString() == spark.createDataFrame([], schemas.RESPONSES).schema.simpleString()
    by_route = {r.route: r for r in found.collect()}
    assert (by_route["/a"].status, by_route["/a"].body, by_route["/a"].headers) == (200, "[8]", {"X-WP-Total": "2"})
    assert (by_route["/b"].status, by_route["/b"].error) == (None, "TimeoutError: slow")


def test_files_are_fetched_and_stored(spark, tmp_path, rows):
    def transport(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return b"12345"

    plan = spark.createDataFrame([("d", "http://a/x", "d/files/x", True), ("d", "http://a/bad", "d/files/bad", True), ("d", "http://a/y", "d/files/y", False)],
                                 "domain string, source_url string, target_path string, download boolean")
    moved = fetch.fetch_files(plan, transport, tasks=2)
    assert rows(moved, "source_url", "success", "error", "bytes") == [("http://a/bad", False, "OSError: gone", None), ("http://a/x", True, None, 5)]
    sinks.write_media(moved.where("success"), str(tmp_path / "m"))
    assert bytes(spark.read.parquet(str(tmp_path / "m")).first().content) == b"12345"


def test_archive_folders_keep_order_and_replace_only_what_is_written(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(sinks, "PAGES_PER_FILE", 2)
    out = str(tmp_path / "archive")

    def records(*entries):
        return spark.createDataFrame([(d, "/r", n, p, i, t) for d, n, p, i, t in entries], schemas.RECORDS)

    sinks.write_records(records(("a", "x.jsonl", 3, 0, "5"), ("a", "x.jsonl", 1, 1, "2"), ("a", "x.jsonl", 1, 0, "1"),
                                ("a", "x.jsonl", 2, 0, "3"), ("b", "y.jsonl", 1, 0, "9")), out, folders=True)
    blocks = sorted((tmp_path / "archive/domain=a/out_name=x.jsonl").glob("block=*/part*"))
    assert [p.read_text() for p in blocks] == ["1\n2\n3\n", "5\n"]
    sinks.write_records(records(("b", "y.jsonl", 1, 0, "10")), out, folders=True)
    assert rows(captures.read_archive(spark, out, folders=True), "domain", "record_json") == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "5"), ("b", "10")]


def test_documents_and_snapshot_folders(spark, tmp_path, rows):
    documents = spark.createDataFrame([("a", "/", ".json", "processed", '{\n"x":1}'), ("a", "/y", "y.json", "skipped", None)],
                                      "domain string, route string, out_name string, outcome string, body string")
    sinks.write_documents(documents, str(tmp_path / "d"), folders=True)
    assert rows(spark.read.parquet(str(tmp_path / "d")), "out_name", "body") == [("root.json", '{\n"x":1}')]
    index = spark.createDataFrame([("a", None, 200, None, '{"é":\n1}'), ("b", None, 404, None, "{}")], schemas.SITE_INDEX)
    sinks.write_index_snapshot(index, str(tmp_path / "i"), folders=True)
    assert rows(spark.read.text(str(tmp_path / "i"))) == [('{"é": 1}', "a")]


def test_manifest_versions_and_catalogue_text(spark, tmp_path):
    manifest = spark.createDataFrame([("a", "a/files/1", 1.0)], schemas.MANIFEST)
    sinks.write_manifest(manifest, str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 1
    lines = spark.createDataFrame([(1, 1, "/b", "- /b"), (1, 0, "", "protected:"), (1, 1, "/a", "- /a"), (4, 0, "", "useless:")],
                                  "category_pos int, is_route int, route string, line string")
    sinks.write_catalogue_lines(lines, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert text == "protected:\n- /a\n- /b\nuseless:\n"


def test_shared_folder_comes_from_the_session(spark):
    assert fresh_dir(spark, "x").startswith(shared_dir(spark))
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)


T0 = datetime(2024, 1, 1)


def test_ingestion_resumes_without_repeats(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*names, when=T0):
        rows = [("d", f"http://x/{n}", True, None, 1, when) for n in names]
        spark.createDataFrame(rows, schemas.TRANSFERS).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schemas.TRANSFERS).parquet(source)
        ingest.save_batches(stream, out, state)
        saved = ingest.distinct_arrivals(spark.read.parquet(out), ["domain", "source_url"])
        return sorted(r.source_url[-1] for r in saved.collect())

    arrive("a", "b", "a")
    assert run() == ["a", "b"]
    arrive("b", "c")
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    arrive("l", when=T0 - timedelta(days=30))
    assert run() == ["a", "b", "c", "l"]


def test_progress_of_a_stream_equals_the_table(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = [("d", f"u{i}", i % 3 != 0, None, i, T0 + timedelta(minutes=i * 7)) for i in range(40)]
    table = spark.createDataFrame(data, schemas.TRANSFERS)
    table.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(schemas.TRANSFERS).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.save_batches(stream, out, str(tmp_path / "state"), lambda batch: progress.windowed_progress(batch, "1 hour", "30 minutes"))
    merged = progress.merge_progress(spark.read.parquet(out))
    assert rows(merged) == rows(progress.windowed_progress(table, "1 hour", "30 minutes"))
    assert [tuple(r) for r in progress.session_progress(table, 10).collect()] == [("d", T0, T0 + timedelta(minutes=39 * 7 + 10), 40, 14)]
    assert progress.session_progress(table, 6).count() == 40 and progress.session_progress(table, 7).count() == 1


def test_sessions_of_a_stream_equal_the_table(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    minutes = [0, 3, 13, 24, 60, 61, 99, 300]
    table = spark.createDataFrame([("d", f"u{m}", True, None, 1, T0 + timedelta(minutes=m)) for m in minutes], schemas.TRANSFERS)
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schemas.TRANSFERS).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.save_batches(stream, out, str(tmp_path / "state"), lambda batch: progress.session_slots(batch, 10))
    assert rows(progress.merge_sessions(spark.read.parquet(out), 10)) == rows(progress.session_progress(table, 10))


def test_retry_state_of_a_stream_equals_the_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = []
    for page in range(1, 30):
        for attempt in range(1, page % 7 + 2):
            status = 200 if attempt > page % 5 + 1 else 503
            data.append(("d", "/r", "list", "U", page, attempt, status, None, "[1]", None, T0 + timedelta(hours=page * 9 + attempt)))
    table = spark.createDataFrame(data, schemas.RESPONSES)
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schemas.RESPONSES).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.save_batches(stream, out, str(tmp_path / "state"), retries.retry_state)
    state = retries.merge_state(spark.read.parquet(out))
    batch = {r.page: r.attempt for r in pages.resolve_retries(table).collect()}
    assert {r.page: r.attempt for r in state.collect()} == batch
    settled = {r.page: r.outcome for r in retries.settled(state).collect()}
    assert settled == {p: "success" if a else "failed" for p, a in batch.items()
                       if a or max(r[5] for r in data if r[4] == p) >= 5}
