from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from sitequarry.functions import domains, failures, text, urls
from sitequarry.operators import sites


def table(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def pairs(frame, column):
    return {r[0]: r[1] for r in frame.select("v", column.alias("w")).collect()}


def test_bytes_as_text(spark):
    cases = {
        0: "0.00 B", 500: "500.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1152: "1.12 KB", 1536: "1.50 KB",
        1029: "1.00 KB", 1048575: "1024.00 KB", 1048576: "1.00 MB", 1073741824: "1.00 GB", 5 * 1024**4: "5.00 TB",
        1024**5: "1.00 PB", 2**62: "4096.00 PB", -5: "-5.00 B",
    }
    assert pairs(table(spark, cases, "bigint"), text.bytes_text(F.col("v"))) == cases


def test_bytes_round_like_exact_division(spark):
    values = [7, 1030, 1280, 3200, 1024 * 37 + 128, 10**6 + 7, 10**9 + 1, 10**12 + 123457, 10**15 + 5]

    def exact(n):
        power = min(5, (n.bit_length() - 1) // 10)
        amount = (Decimal(n) / Decimal(1024) ** power).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        return f"{amount} {['B', 'KB', 'MB', 'GB', 'TB', 'PB'][power]}"

    found = pairs(table(spark, values, "bigint"), text.bytes_text(F.col("v")))
    assert found == {n: exact(n) for n in values}


def test_duration_as_text(spark):
    cases = {
        0.0: "0s", 30.0: "30s", 59.9: "59s", 90.0: "1m 30s", 3600.0: "1h 0m 0s", 3661.0: "1h 1m 1s",
        86400.0: "1d 0h 0m", 90000.0: "1d 1h 0m", -1.5: "-1s",
    }
    assert pairs(table(spark, cases, "double"), text.duration_text(F.col("v"))) == cases


def test_domains(spark):
    same = ["example.com", "www.example.com", "subdomain.example.com", "localhost", "127.0.0.1", "999.999.999.999",
            "abcd:80", "[::1]", "a" * 63 + ".example.com"]
    changed = {
        "http://example.com": "example.com", "https://www.example.com": "www.example.com", "EXAMPLE.COM": "example.com",
        "  example.com  ": "example.com", " example.com\x1f": "example.com", "example.com/": "example.com",
        "example.com//": "example.com", "https://example.com/a/b?c#d": "example.com", "http://exa\tmple.com": "example.com",
    }
    refused = {
        "": domains.EMPTY, None: domains.EMPTY, "   ": domains.BAD_FORMAT, "invalid..domain.com": domains.BAD_FORMAT,
        "a" * 254: domains.TOO_LONG, "example.com:8080": domains.BAD_FORMAT, "u@example.com": domains.BAD_FORMAT,
        "example.c": domains.BAD_FORMAT, "a_b.com": domains.BAD_FORMAT, "http://": domains.BAD_FORMAT,
        "exa\tmple.com": domains.BAD_FORMAT, "http:///path": domains.BAD_FORMAT,
    }
    inputs = [*same, *changed, *refused]
    frame = sites.clean_domains(spark.createDataFrame([(v,) for v in inputs], "input string"))
    found = {r.input: r for r in frame.collect()}
    for name in same:
        assert (found[name].domain, found[name].reject_reason) == (name, None), name
    for name, domain in changed.items():
        assert (found[name].domain, found[name].reject_reason) == (domain, None), name
    for name, reason in refused.items():
        assert found[name].reject_reason == reason, name
        assert reason in found[name].error_message
    assert found["127.0.0.1"].domain_kind == "ipv4" and found["[::1]"].domain_kind == "ipv6"
    assert found["localhost"].domain_kind == "label" and found["example.com"].domain_kind == "host"
    # repeats after normalising collapse
    accepted = [r.domain for r in sites.accepted_domains(frame).collect()]
    assert accepted.count("example.com") == 1


def test_url_paths(spark):
    cases = {
        "http://a.com/b c.jpg?x#y": "/b c.jpg", "http://a_b.com/x%20y.jpg;p=1?q": "/x%20y.jpg", "//cdn.x/y.jpg": "/y.jpg",
        "http://a.com": "", "a/b.jpg": "a/b.jpg", "http://a.com/x;v=1/y.jpg": "/x;v=1/y.jpg", "/x;a;b": "/x",
        "custom:/x;p": "/x;p", "  http://a.com/z\n.jpg": "/z.jpg", "localhost:80/x": "80/x", "http://a.com#/b?c": "",
    }
    assert pairs(table(spark, cases, "string"), urls.url_path(F.col("v"))) == cases


def test_names_and_paths(spark):
    one = spark.range(1)
    out = one.select(
        urls.output_name(F.lit("/wp/v2/posts"), F.lit("list")), urls.output_name(F.lit("/"), F.lit("dict")),
        urls.target_path(F.lit("d"), F.lit("//a//b.jpg")), urls.directory_of(F.lit("d/files/a//b.jpg")),
        urls.file_of(F.lit("d/files/")), urls.index_url(F.lit("d"), https=False),
        urls.page_url(F.lit("U"), F.lit(3), 50), urls.probe_url(F.lit("U")),
    ).first()
    assert list(out) == [
        "wp_v2_posts.jsonl", ".json", "d/files/a//b.jpg", "d/files/a", "", "http://d/wp-json/",
        "U?page=3&order=asc&orderby=id&per_page=50", "U?per_page=1&page=1",
    ]


def test_messages(spark):
    url = F.lit("http://x")
    none = F.lit(None).cast("string")
    out = spark.range(1).select(
        failures.domain_message(F.lit("invalid"), F.lit("Invalid format")),
        failures.api_message(url, F.lit(404), none), failures.api_message(url, F.lit(500), none),
        failures.api_message(url, F.lit(None).cast("int"), F.lit("boom")), failures.ssl_message(url, none),
        failures.download_message(url, F.lit("Connection timeout")), failures.media_missing_message(F.lit("p")),
        failures.checkpoint_message(F.lit("Failed to save")),
    ).first()
    assert "invalid" in out[0] and "Invalid format" in out[0]
    assert "404" in out[1] and "Suggestion" in out[1] and "500" in out[2] and "Suggestion" in out[2]
    assert out[3] == "WordPress API error for http://x: boom"
    assert "SSL verification failed" in out[4] and "Suggestion" in out[4]
    assert "Failed to download" in out[5] and "timeout" in out[5] and "Suggestion" in out[5]
    assert "Media file not found" in out[6] and "Suggestion" in out[6]
    assert out[7] == "Checkpoint error: Failed to save"
