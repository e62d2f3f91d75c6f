"""Input tables of the engine, derived from the given tables by projections that DuckDB can repeat.

The arithmetic is kept as SQL text that both engines read, so that the oracle queries in
`oracles.py` build their own inputs from the same rules. Nothing here groups or sorts, except for
the distinct rows of manifest-like tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators.computed import with_computed
from sitequarry.session import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt over tasks by key: what follows makes much out of each, and a given file may be one split."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def arriving(spark: SparkSession, sf_dir: str, name: str, files: int = 6) -> DataFrame:
    """The same table as a stream of files that come two at a time, rows of all times in each of them."""
    rows, folder = table(spark, sf_dir, name), fresh_dir(spark, "arriving")
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


# --- site index: one site per order ------------------------------------------------------------

# Route templates: number, route, form of the self link, form of the endpoints.
TEMPLATES = [
    (0, "/", "list", "dict"),
    (1, "/wp/v2/posts", "list", "paginated"),
    (2, "/wp/v2/posts/(?P<id>[\\d]+)", None, "dict"),
    (3, "/wp/v2/media", "dict", "paginated"),
    (4, "/wp/v2/types", "text", "dict"),
    (5, "/wp/v2/settings", "list", "list"),
    (6, "/wp/v2/avada_faq", "list", "paginated"),
    (7, "/wp/v2/statuses", "empty", "dict"),
    (8, "/wp/v2/tags", None, "paginated"),
    (9, "/batch/v1", "list", "list"),
    (10, "/shop/v1/items", "list", "paginated"),
    (11, "/shop/v1/items/(?P<id>[\\d]+)", None, "dict"),
    (12, "/shop/v1/info", "list", "list"),
    (13, "/shop/v1/empty", "list", "none"),
    (14, "/shop/v1/bare", "dict", "absent"),
    (15, "/shop/v1/noargs", "list", "noargs"),
    (16, "/shop/v1/stock/7", "list", "dict"),
    (17, "/shop/v1/noself", None, "paginated"),
    (18, "/shop/v1/odd(?Pname)", "list", "paginated"),
    (19, "/shop/v1/feed", "dict", "paginated"),
    (20, "/shop/v1/a_b", "list", "list"),
    (21, "/shop_v1/a/b", "list", "dict"),
    (22, "/shop/v1/nullargs", "list", "null"),
]
LIST_TEMPLATES = [1, 3, 6, 10, 19]
DICT_TEMPLATES = [0, 4, 12, 16, 20, 21]
UNKNOWN_TEMPLATES = list(range(10, 23))

ENDPOINTS = {
    "dict": '"endpoints":[{"args":{"context":{}}}]',
    "paginated": '"endpoints":[{"args":{"page":{},"per_page":{}}}]',
    "list": '"endpoints":[{"args":[]}]',
    "none": '"endpoints":[]',
    "absent": '"methods":["GET"]',
    "noargs": '"endpoints":[{}]',
    "null": '"endpoints":[{"args":null}]',
}
NORMAL = "variant NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12)"
INDEX_STATUS = (
    "CASE WHEN variant = 0 THEN 404 WHEN variant IN (1, 2) THEN NULL WHEN variant = 6 THEN 500 "
    "WHEN variant = 7 THEN 403 WHEN variant = 8 THEN 401 ELSE 200 END"
)
INDEX_ERROR = (
    "CASE WHEN variant = 1 THEN 'SSLError: certificate verify failed' "
    "WHEN variant = 2 THEN 'ConnectionError: connection refused' END"
)
DOMAIN = "concat('shop', o_orderkey, '.example.org')"
VARIANT = "o_orderkey % 23"


def included(k: str | int) -> str:
    """Whether the index of an order has template k."""
    return f"(o_orderkey * ({k} + 3) + {k}) % 7 > 1"


def _piece(route: str, link: str | None, endpoints: str, base: str = "https://@/wp-json") -> str:
    url = json.dumps(base + route)
    forms = {"dict": f'{{"href":{url}}}', "text": url, "list": f'[{{"href":{url}}}]', "empty": "[]"}
    links = f',"_links":{{"self":{forms[link]}}}' if link else ""
    return f"{json.dumps(route)}:{{{ENDPOINTS[endpoints]}{links}}}"


def orders_numbered(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return orders.selectExpr("o_orderkey", f"{DOMAIN} AS domain", f"{VARIANT} AS variant")


def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = [F.when(F.expr(included(k)), F.lit(_piece(r, s, e))) for k, r, s, e in TEMPLATES]
    again = F.when(
        F.expr(f"variant = 9 AND {included(1)}"),
        F.lit(_piece("/wp/v2/posts", "list", "paginated", "https://@/again")),
    )
    listing = F.concat(F.lit('{"name":"@","routes":{'), F.concat_ws(",", *pieces, again), F.lit("}}"))
    refused = F.concat(
        F.lit('{"code":"rest_refused","message":"Refused","data":{"status":'), F.col("status"), F.lit("}}")
    )
    body = (
        F.when(F.col("variant").isin(0, 6, 7, 8), refused)
        .when(F.col("variant").isin(1, 2), None)
        .when(F.col("variant") == 3, "<html>busy</html>")
        .when(F.col("variant") == 4, '{"name":"x"}')
        .when(F.col("variant") == 5, '{"routes":[]}')
        .when(F.col("variant") == 11, "3")
        .when(F.col("variant") == 12, "[1]")
        .otherwise(F.replace(listing, F.lit("@"), F.col("domain")))
    )
    return (
        orders_numbered(spark, sf_dir)
        .where("variant <> 10")
        .withColumn("status", F.expr(INDEX_STATUS))
        .select(
            "domain",
            F.expr("timestamp_seconds(1700000000 + o_orderkey)").alias("fetched_at"),
            "status",
            F.expr(INDEX_ERROR).alias("error"),
            body.alias("body"),
        )
    )


def index_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites, those without a captured index included."""
    return orders_numbered(spark, sf_dir).select("domain")


# --- sites that answer by themselves: one per customer ---------------------------------------------

CRAWL_DOMAIN = "concat('k', c_custkey, '.example.org')"
#: Routes of each such site; the last is a dictionary.
CRAWL_ROUTES = ["/wp/v2/posts", "/wp/v2/pages", "/wp/v2/types"]
CRAWL_PAGES = 7


def crawl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = ",".join(_piece(r, "list", "paginated") for r in CRAWL_ROUTES)
    body = F.replace(F.lit(f'{{"routes":{{{routes}}}}}'), F.lit("@"), F.col("domain"))
    sites_ = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr(f"{CRAWL_DOMAIN} AS domain")
    return sites_.select(
        "domain", F.expr("timestamp_seconds(1700000000)").alias("fetched_at"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("error"), body.alias("body"),
    )


def answer(url: str, attempt: int) -> tuple[int, dict[str, str], str]:
    """What the site of customer c says, by c % 5. 0: announces its 7 pages, page 3 fails twice. 1: announces nothing, page 8 is
    an empty list. 2: page 4 always fails. 3: page 6 is no list. 4: announces, and every first try breaks off."""
    site = int(url.split("//k")[1].split(".")[0])
    if "?" not in url:
        return 200, {}, f'{{"site":{site}}}'
    page, kind = int(url.split("?page=")[1].split("&")[0]), site % 5
    if kind == 4 and attempt == 1:
        raise ConnectionError("reset")
    if (kind == 0 and page == 3 and attempt <= 2) or (kind == 2 and page == 4):
        return 503, {}, '{"code":"busy"}'
    if kind == 3 and page == 6:
        return 200, {}, '{"id":6}'
    headers = {"X-WP-TotalPages": str(CRAWL_PAGES)} if kind in (0, 4) else {}
    if page > CRAWL_PAGES:
        return 200, headers, "[]"
    return 200, headers, f'[{{"id":{page * 10 + 1}}},{{"id":{page * 10 + 2}}}]'


# --- routes by customer: sites with many routes --------------------------------------------------

# Routes by order number; @ stands for the order number, so these routes are all different.
CUSTOMER_ROUTES = [
    "/wp/v2/posts", "/wp/v2/pages", "/wp/v2/comments", "/wp/v2/types", "/", "/wp/v2/settings",
    "/wp/v2/users/me", "/wp/v2/avada_faq", "/batch/v1", "/wp/v2/posts/(?P<id>[\\d]+)",
    "/shop/v1/item-@", "/shop/v1/list-@", "/shop/v1/part/(?P<id>@)", "/shop/v2/item-@", "/news/v1/@",
    "/news/v1/feed", "/wp/v2/media",
]
CUSTOMER_DOMAIN = "concat('c', o_custkey, '.example.com')"


def customer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (domain, route) with route_pos, the first order that names it."""
    names = F.lit(CUSTOMER_ROUTES)
    route = F.get(names, (F.col("o_orderkey") % len(CUSTOMER_ROUTES)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.expr(CUSTOMER_DOMAIN).alias("domain"),
        F.replace(route, F.lit("@"), F.col("o_orderkey").cast("string")).alias("route"),
        "o_orderkey",
    )
    return rows.groupBy("domain", "route").agg(F.min("o_orderkey").alias("route_pos"))


# --- captured responses ------------------------------------------------------------------------

LIST_H = "o_orderkey * 31 + k * 17"
LIST_N = "1 + h % 5"
LIST_V = "(o_orderkey * 7 + k * 5) % 12"
LIST_PAGE_CAPTURED = "(page <= n OR v IN (1, 2, 7, 8)) AND NOT (v = 9 AND page = 2)"
LIST_TRIES = (
    "CASE WHEN v = 11 AND page = 1 THEN 3 WHEN v = 11 AND page = n THEN 7 WHEN v = 2 AND page = n + 1 THEN 5 "
    "WHEN (h + page) % 6 = 0 THEN 2 ELSE 1 END"
)
LIST_WIN = (
    "CASE WHEN v = 11 AND page = 1 THEN 3 WHEN v = 11 AND page = n THEN (CASE WHEN h % 2 = 0 THEN 6 ELSE 4 END) "
    "WHEN v = 2 AND page = n + 1 THEN 99 WHEN (h + page) % 6 = 0 THEN 2 ELSE 1 END"
)
LIST_STATUS = (
    "CASE WHEN v = 2 AND page = n + 1 THEN 400 "
    "WHEN attempt < win AND attempt % 2 = 1 THEN 503 WHEN attempt < win THEN NULL "
    "WHEN v = 3 AND page = n THEN 204 ELSE 200 END"
)
LIST_BODY = (
    "CASE WHEN status IS NULL THEN NULL WHEN status = 400 THEN '{\"code\":\"rest_invalid_page\",\"message\":\"Bad page\","
    "\"data\":{\"status\":400,\"params\":{\"page\":\"too high\"}}}' "
    "WHEN status = 503 THEN '{\"code\":\"busy\",\"message\":\"Busy\",\"data\":{\"status\":503}}' "
    "WHEN status = 204 THEN '' WHEN v IN (1, 7, 8) AND page = n + 1 THEN '[]' "
    "WHEN v = 4 AND page = n THEN '[{\"id\":1' WHEN v = 5 AND page = n THEN '{\"id\":1}' "
    "WHEN v = 6 AND page = n THEN '3' "
    "WHEN (h + page) % 3 = 0 THEN concat('[', r1, ']') WHEN (h + page) % 3 = 1 THEN concat('[', r1, ',', r2, ']') "
    "ELSE concat('[', r1, ', ', r2, ' ,', r3, ']') END"
)
LIST_TOTAL_PAGES = (
    "CASE WHEN v IN (1, 2) THEN NULL WHEN v = 7 THEN 'abc' WHEN v = 8 THEN '0' WHEN v = 10 THEN '2' "
    "ELSE concat('', n) END"
)
LIST_TOTAL = "CASE WHEN h % 3 = 0 THEN concat(' ', n * 100) END"
LIST_HEADERS = (
    f"CASE WHEN {LIST_TOTAL_PAGES} IS NULL AND {LIST_TOTAL} IS NULL THEN cast(map() AS MAP<STRING, STRING>) "
    f"WHEN {LIST_TOTAL} IS NULL THEN map('x-wp-totalpages', {LIST_TOTAL_PAGES}) "
    f"WHEN {LIST_TOTAL_PAGES} IS NULL THEN map('X-WP-Total', {LIST_TOTAL}) "
    f"ELSE map('x-wp-totalpages', {LIST_TOTAL_PAGES}, 'X-WP-Total', {LIST_TOTAL}) END"
)


def record_text(number: int) -> str:
    """SQL text of the JSON of a page's record 1, 2 or 3."""
    return (
        f"concat('{{\"id\":', o_orderkey * 100 + page * 10 + {number}, ',\"page\":', page, ',\"try\":', attempt, '}}')"
    )


def _with_template(rows: DataFrame, numbers: list[int]) -> DataFrame:
    """Orders with a usable index times those of the templates that their index has."""
    names = {k: r for k, r, _, _ in TEMPLATES}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(names[k]).alias("route")) for k in numbers])
    return rows.where(NORMAL).select("*", F.inline(entries)).where(included("k"))


def list_responses(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    orders = _with_template(orders_numbered(spark, sf_dir, read), LIST_TEMPLATES)
    tries = (
        orders.selectExpr("*", f"{LIST_H} AS h")
        .selectExpr("*", f"{LIST_N} AS n", f"{LIST_V} AS v")
        .selectExpr("*", "explode(sequence(1, cast(n + 1 AS INT))) AS page")
        .where(LIST_PAGE_CAPTURED)
        .selectExpr("*", f"{LIST_WIN} AS win", f"explode(sequence(1, {LIST_TRIES})) AS attempt")
    )
    # filters on the status would repeat its rules below, in a method too long for the Java compiler
    return (
        with_computed(tries, status=F.expr(LIST_STATUS))
        .selectExpr("*", *[f"{record_text(i)} AS r{i}" for i in (1, 2, 3)])
        .select(
            "domain",
            "route",
            F.lit("list").alias("kind"),
            F.concat(F.lit("https://"), "domain", F.lit("/wp-json"), "route").alias("url"),
            "page",
            "attempt",
            "status",
            F.expr(LIST_HEADERS).alias("headers"),
            F.expr(LIST_BODY).alias("body"),
            F.when(F.col("status").isNull(), "ConnectionError: reset").alias("error"),
            F.expr("timestamp_seconds(1700000000 + o_orderkey * 60 + page * 10 + attempt)").alias("fetched_at"),
        )
    )


DICT_D = "(o_orderkey + k) % 5"
DICT_STATUS = "CASE WHEN d = 0 THEN 404 WHEN d = 1 THEN 204 WHEN d = 2 THEN NULL ELSE 200 END"
DICT_BODY = (
    "CASE WHEN d = 0 THEN '{\"code\":\"rest_no_route\",\"message\":\"No route\",\"data\":{\"status\":404}}' "
    "WHEN d = 1 THEN '' WHEN d = 2 THEN NULL "
    "WHEN k = 4 THEN concat('{\"post\":{\"name\":\"Posts\",\"slug\":\"post\"},\"kind', o_orderkey % 10, "
    "'\":{\"name\":\"Kind\",\"slug\":\"kind\"}}') "
    "ELSE concat('{\"number\":', o_orderkey, '}') END"
)


def dict_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _with_template(orders_numbered(spark, sf_dir), DICT_TEMPLATES)
    return (
        orders.selectExpr("*", f"{DICT_D} AS d", "explode(array(1, 2)) AS attempt")
        .where("attempt = 1 OR d = 2")
        .selectExpr("*", f"CASE WHEN attempt = 2 THEN 200 ELSE {DICT_STATUS} END AS status")
        .select(
            "domain",
            "route",
            F.lit("dict").alias("kind"),
            F.concat(F.lit("https://"), "domain", F.lit("/wp-json"), "route").alias("url"),
            F.lit(1).alias("page"),
            "attempt",
            "status",
            F.lit(None).cast("map<string,string>").alias("headers"),
            F.expr(f"CASE WHEN attempt = 2 THEN '{{}}' ELSE {DICT_BODY} END").alias("body"),
            F.when(F.col("status").isNull(), "Timeout: read timed out").alias("error"),
            F.expr("timestamp_seconds(1700000000 + o_orderkey * 60 + 100 + attempt)").alias("fetched_at"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_responses(spark, sf_dir).unionByName(dict_responses(spark, sf_dir))


# --- probes of unknown routes ------------------------------------------------------------------

PROBE_P = "CASE WHEN probe = 1 THEN (o_orderkey + k) % 6 ELSE (o_orderkey * 3 + k) % 8 END"
PROBE_STATUS = (
    "CASE WHEN probe = 1 THEN (CASE p WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 4 THEN NULL ELSE 200 END) "
    "ELSE (CASE p WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 6 THEN 404 ELSE 200 END) END"
)
PROBE_BODY = (
    "CASE WHEN probe = 1 THEN (CASE p WHEN 2 THEN '[]' WHEN 3 THEN '{}' WHEN 5 THEN 'oops' END) "
    "ELSE (CASE p WHEN 3 THEN '{\"id\":5}' WHEN 4 THEN '[{\"id\":5}]' WHEN 5 THEN '{\"name\":\"x\"}' WHEN 7 THEN '[' END) END"
)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _with_template(orders_numbered(spark, sf_dir), UNKNOWN_TEMPLATES)
    return (
        orders.selectExpr("*", "explode(array(1, 2)) AS probe")
        .selectExpr("*", f"{PROBE_P} AS p")
        .selectExpr("*", f"{PROBE_STATUS} AS status", f"{PROBE_BODY} AS body")
        .selectExpr("domain", "route", "probe", "status", "body",
                    "CASE WHEN status IS NULL THEN 'ConnectionError: refused' END AS error")
    )


# --- catalogue documents -----------------------------------------------------------------------

# One small catalogue document per part.
CATALOGUE_DOCUMENT = (
    "concat('# catalogue\n', 'protected:\n- /p/v1/a', p_partkey % 40, '\n- ', '\"/p/v1/quoted', p_partkey % 7, '\"\n', "
    "'public-list:\n- /p/v1/b', p_partkey % 30, '\n- /p/v1/a', p_partkey % 50, '\n', "
    "CASE WHEN p_partkey % 3 = 0 THEN 'public-dict: []\n' ELSE concat('public-dict:\n  - /p/v1/c', p_partkey, '\n') END, "
    "'useless:\n- /p/v1/b', p_partkey % 30, '/(?P<id>[\\\\d]+)', '\n')"
)


def catalogue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{CATALOGUE_DOCUMENT} AS text")


# --- site names and media out of pages ---------------------------------------------------------

PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
SITE_INPUT = (
    "CASE page_id % 11 WHEN 0 THEN upper(host) WHEN 1 THEN concat('https://', host, '/x?y=1') "
    "WHEN 2 THEN concat(host, '//') WHEN 3 THEN concat('  ', host, chr(9)) WHEN 4 THEN concat('a..', host) "
    "WHEN 5 THEN concat(host, ':8080') WHEN 6 THEN concat('a_', host) WHEN 7 THEN '' "
    "WHEN 8 THEN concat('10.0.', page_id % 256, '.', page_id % 10) WHEN 9 THEN repeat('a', 250 + page_id % 10) "
    "ELSE host END"
)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{PAGE_HOST} AS host").selectExpr(
        f"{SITE_INPUT} AS input"
    )


PAGE_DOMAIN = "concat('m', page_id - page_id % 10, '.example.com')"
PAGE_MEDIA_LINE = (
    "CASE page_id % 17 WHEN 0 THEN '  ' WHEN 1 THEN '{\"source_url\":' WHEN 2 THEN '{\"other\":1}' "
    "WHEN 3 THEN '{\"source_url\":null}' WHEN 4 THEN '3' WHEN 5 THEN '[1]' WHEN 6 THEN '{\"source_url\":false}' "
    "WHEN 7 THEN '{\"source_url\":\"//cdn.example.com/a b;v=1/../shared.png;p=2?x#y\"}' "
    "WHEN 8 THEN '{\"source_url\":\"https://cdn.example.com\"}' "
    "ELSE concat('{\"source_url\":\"', url, '\",\"id\":', page_id, '}') END"
)


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        f"{PAGE_DOMAIN} AS domain", "page_id AS line_no", f"{PAGE_MEDIA_LINE} AS raw"
    )


# --- media, manifest, files and transfers out of lineitem ----------------------------------------

ITEM_DOMAIN = "concat('m', l_suppkey, '.example.com')"
ITEM_FILE = "concat('uploads/', l_partkey % 500, '/', l_linenumber, '.jpg')"
ITEM_URL = f"concat('https://cdn', l_orderkey % 2, '.example.com/', {ITEM_FILE}, '?v=1')"
ITEM_PATH = f"concat({ITEM_DOMAIN}, '/files/', {ITEM_FILE})"
MANIFEST_ROWS = "(l_partkey % 500) % 5 = 0 AND l_suppkey % 4 <> 0"
FILE_ROWS = "(l_partkey % 500) % 6 = 0"
TRANSFER_SUCCESS = "(l_partkey % 500 + l_linenumber) % 7 <> 0"
TRANSFER_BYTES = "(l_partkey % 500) * 1000 + l_linenumber"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return spread(items, "l_orderkey")


def item_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).selectExpr(
        f"{ITEM_DOMAIN} AS domain",
        "l_orderkey * 10 + l_linenumber AS line_no",
        f"concat('{{\"id\":', l_orderkey, ',\"source_url\":\"', {ITEM_URL}, '\"}}') AS raw",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).where(MANIFEST_ROWS)
    return rows.selectExpr(f"{ITEM_DOMAIN} AS domain", f"{ITEM_PATH} AS path", "1.7e9D AS last_updated").distinct()


def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).where(FILE_ROWS)
    return rows.selectExpr(
        f"{ITEM_DOMAIN} AS domain", f"{ITEM_PATH} AS path",
        f"CASE WHEN l_linenumber = 7 THEN 1 ELSE {TRANSFER_BYTES} END AS length",
    ).distinct()


def item_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per URL, with a failed earlier try for some."""
    rows = _items(spark, sf_dir).selectExpr("*", "explode(array(0, 1)) AS later")
    return rows.where("later = 1 OR l_linenumber = 3").selectExpr(
        f"{ITEM_DOMAIN} AS domain",
        f"{ITEM_URL} AS source_url",
        f"later = 1 AND {TRANSFER_SUCCESS} AS success",
        f"CASE WHEN later = 0 OR NOT ({TRANSFER_SUCCESS}) THEN 'HTTP 500' END AS error",
        f"CASE WHEN later = 1 AND {TRANSFER_SUCCESS} THEN {TRANSFER_BYTES} END AS bytes",
        "timestamp_seconds(1700000000 + (l_partkey % 500) * 10 + later) AS ts",
    )


EVENT_SUCCESS = "event_type <> 'error'"
EVENT_BYTES = "cast(floor(value * 1000) AS BIGINT)"


def event_transfers(events: DataFrame) -> DataFrame:
    """Transfers out of the events table or stream."""
    return events.selectExpr(
        "concat('u', user_id, '.example.com') AS domain",
        "concat('https://cdn.example.com/f', event_id, '.bin') AS source_url",
        f"{EVENT_SUCCESS} AS success",
        f"CASE WHEN NOT ({EVENT_SUCCESS}) THEN 'HTTP 500' END AS error",
        f"{EVENT_BYTES} AS bytes",
        "cast(ts AS TIMESTAMP) AS ts",
    )


#: Texts looked for through an index: common and rare ones, two words, another case, too short for a gram, found nowhere.
SEARCHED = ["The TH", "red", "ing ", "er", "LICENSE", "é", "qzxv", "nation", "e"]

# --- archived records --------------------------------------------------------------------------

DOC_DATE = "date_add(DATE '2020-01-01', cast(doc_id % 1000 AS INT))"


def _post_json(own_id: str) -> str:
    return (
        "to_json(named_struct("
        f"'id', {own_id}, "
        f"'date', CASE WHEN doc_id % 17 = 0 THEN 'soon' ELSE concat({DOC_DATE}, 'T10:00:00') END, "
        "'status', CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' WHEN 2 THEN NULL ELSE 'publish' END, "
        "'title', named_struct('rendered', concat(source, ' ', text)), "
        "'content', named_struct('rendered', text), "
        "'excerpt', named_struct('rendered', lang), "
        "'author', CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 97 END, "
        "'featured_media', doc_id % 11, "
        "'categories', array(doc_id % 25, doc_id % 7), "
        "'tags', array(doc_id % 40))) AS record_json"
    )


def post_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts out of documents, as JSON text; every 13th has no author, every 17th a bad date."""
    return table(spark, sf_dir, "documents").selectExpr(_post_json("doc_id"))


def site_post_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts dealt to three sites, which count their ids from the start each."""
    return table(spark, sf_dir, "documents").selectExpr("concat('s', doc_id % 3, '.example.com') AS domain", _post_json("doc_id div 3"))


def site_term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms at each of the three sites."""
    return table(spark, sf_dir, "nation").selectExpr("*", "explode(array(0, 1, 2)) AS site").selectExpr(
        "concat('s', site, '.example.com') AS domain",
        "to_json(named_struct('id', n_nationkey, 'name', n_name, 'slug', lower(n_name), "
        "'parent', n_regionkey, 'taxonomy', 'category')) AS record_json",
    )


def site_user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to the three sites, which count their ids from the start each."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('s', c_custkey % 3, '.example.com') AS domain",
        "to_json(named_struct('id', c_custkey div 3, 'name', c_name)) AS record_json",
    )


def comment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "to_json(named_struct("
        "'id', conv_id * 1000 + turn, "
        "'post', conv_id, "
        "'parent', CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 ELSE 0L END, "
        "'author', CASE WHEN role = 'user' THEN conv_id % 50 ELSE 0L END, "
        "'status', CASE WHEN turn % 4 = 3 THEN 'hold' ELSE 'approved' END, "
        "'content', named_struct('rendered', text))) AS record_json"
    )


def term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "to_json(named_struct('id', n_nationkey, 'name', n_name, 'slug', lower(n_name), "
        "'parent', n_regionkey, 'taxonomy', 'category')) AS record_json"
    )


def user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "to_json(named_struct('id', c_custkey, 'name', c_name, 'slug', lower(replace(c_name, '#', '-')), "
        "'roles', array(lower(c_mktsegment), 'reader'), 'registered_date', '2021-02-03T04:05:06')) AS record_json"
    )


def media_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "to_json(named_struct('id', p_partkey, 'title', named_struct('rendered', p_name), "
        "'media_type', CASE WHEN p_size % 3 = 0 THEN 'image' ELSE 'file' END, "
        "'mime_type', CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/pdf' END, "
        "'post', p_partkey % 100, 'author', p_partkey % 97, "
        "'source_url', concat('https://cdn.example.com/', p_partkey, '.png'))) AS record_json"
    )
