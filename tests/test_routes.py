import json

from pyspark.sql import functions as F

from sitequarry import schemas
from sitequarry.functions import json_shapes
from sitequarry.operators import routes, sites
from sitequarry.sources.catalogue import category_gaps, seed_catalogue

URL = "http://example.com/wp-json/wp/v2/posts/1"
SELF = {"_links": {"self": [{"href": "U"}]}}
PAGED = {"endpoints": [{"args": {"page": {}, "per_page": {}}}]}


def test_json_shapes(spark):
    cases = {
        "[1,2]": "list", "[]": "list", '{"a":1,"a":2}': "dict", "{}": "dict", "3": "other", '"x"': "string",
        "null": "other", "true": "other", "[1] x": "invalid", "[1],[2]": "invalid", "1],[2": "invalid", "": "invalid",
        " \n[1] ": "list", '{"a":}': "invalid", "NaN": "invalid", '[{"a":1,"a":2}]': "list", '{"a":1} {"b":2}': "invalid",
        "<html>": "invalid", None: "invalid", "[1,]": "invalid", "{'a':1}": "invalid", "['a']": "invalid",
        "[\"it's\"]": "list", "01": "invalid",
    }
    frame = spark.createDataFrame([(v,) for v in cases], "v string")
    found = {r[0]: r[1] for r in frame.select("v", json_shapes.json_shape(F.col("v"))).collect()}
    assert found == cases


def test_self_links(spark):
    cases = {
        json.dumps({"_links": {"self": {"href": URL}}}): URL,
        json.dumps({"_links": {"self": URL}}): URL,
        json.dumps({"_links": {"self": [{"href": URL}, {"href": "other"}]}}): URL,
        "{}": None, '{"_links":{}}': None, '{"_links":{"self":[]}}': None, '{"_links":[]}': None,
        '{"_links":{"self":5}}': None, '{"_links":{"self":null}}': None, '{"_links":{"self":{}}}': None,
    }
    frame = spark.createDataFrame([(v,) for v in cases], "v string")
    definition = json_shapes.route_definition(F.col("v"))
    assert {r[0]: r[1] for r in frame.select("v", json_shapes.self_link(definition)).collect()} == cases


def index_rows(spark, *rows):
    return spark.createDataFrame(
        [(d, None, s, e, b) for d, s, e, b in rows], schemas.SITE_INDEX
    )


def test_routes_keep_index_order_and_last_value(spark, rows):
    body = '{"routes":{"/b":{"n":1},"/a":{"n":2},"/b":{"n":3},"/c":null}}'
    index = index_rows(spark, ("x", 200, None, body), ("bad", 200, None, body + " trailing"), ("gone", 404, None, body))
    assert rows(routes.explode_routes(index)) == [
        ("x", "/a", 1, '{"n":2}'), ("x", "/b", 0, '{"n":3}'), ("x", "/c", 2, None),
    ]


def test_health_and_index_outcomes(spark):
    good = '{"routes":{"/wp/v2/posts":{},"/wp/v2/pages":{}}}'
    index = index_rows(
        spark, ("ok", 200, None, good), ("tls", None, "SSLError: bad", None), ("missing", 404, None, "{}"),
        ("net", None, "ConnectionError: refused", None), ("html", 200, None, "<html>"), ("none", 200, None, "{}"),
        ("list", 200, None, "[]"), ("number", 200, None, "3"), ("php", 200, None, '{"routes":[]}'),
    )
    names = spark.createDataFrame([(d,) for d in "ok tls missing net html none list number php absent".split()], "domain string")
    found = {r.domain: r for r in sites.site_health(names, index).collect()}
    assert found["ok"].ok and found["ok"].routes_count == 2 and found["ok"].url == "https://ok/wp-json/"
    assert found["tls"].error_kind == "ssl" and "Suggestion" in found["tls"].error_message
    assert (found["missing"].error_kind, found["missing"].error_status) == ("api", 404)
    assert (found["net"].error_kind, found["net"].error_status) == ("api", None)
    assert found["html"].error_kind == "api" and found["number"].error_kind == "api" and found["php"].error_kind == "api"
    assert (found["none"].ok, found["none"].error_kind) == (False, None) and found["list"].error_kind is None
    assert found["absent"].error_kind == "not_captured"
    outcomes = {r.domain: (r.ping_outcome, r.analyze_outcome, r.dump_outcome) for r in sites.index_outcomes(index).collect()}
    assert outcomes["none"] == ("empty", "zeros", "failure")
    assert outcomes["ok"] == ("routes", "routes", "routes")


def catalogue(spark):
    entries = [("public-list", "/wp/v2/posts"), ("public-dict", "/wp/v2/types"), ("protected", "/twice"),
               ("public-list", "/twice"), ("useless", "/useless"), ("protected", "/secret")]
    return spark.createDataFrame(entries, schemas.KNOWN_ROUTES)


def routes_table(spark, definitions):
    rows = [("d", r, i, None if j is None else json.dumps(j)) for i, (r, j) in enumerate(definitions.items())]
    return spark.createDataFrame(rows, "domain string, route string, route_pos int, route_json string")


DEFINITIONS = {
    "/wp/v2/posts": {**SELF, **PAGED}, "/wp/v2/types": SELF, "/twice": SELF, "/useless": SELF, "/secret": SELF,
    "/u/regex/(?P<id>x)": {**SELF, **PAGED}, "/u/list": {**SELF, **PAGED}, "/u/dict": {**SELF, "endpoints": [{"args": {}}]},
    "/u/args-list": {**SELF, "endpoints": [{"args": []}]}, "/u/none": {**SELF, "endpoints": []}, "/u/absent": SELF,
    "/u/no-args": {**SELF, "endpoints": [{}]}, "/u/null-args": {**SELF, "endpoints": [{"args": None}]}, "/u/no-self": PAGED,
    "/u/null": None,
}


def test_categories_and_dispatch_rank_differently(spark):
    table = routes_table(spark, DEFINITIONS)
    categorised = routes.categorise(table, catalogue(spark))
    category = {r.route: r.category for r in categorised.collect()}
    assert category["/twice"] == "protected" and category["/useless"] == "useless" and category["/u/list"] == "unknown"
    stats = routes.category_statistics(categorised).first().asDict()
    assert stats == {"domain": "d", "total_routes": 15, "protected": 2, "public_list": 1, "public_dict": 1, "useless": 1, "unknown": 10}
    planned = {r.route: (r.action, r.skip_reason) for r in routes.dispatch(table, catalogue(spark)).collect()}
    assert planned == {
        "/wp/v2/posts": ("list", None), "/wp/v2/types": ("dict", None), "/twice": ("list", None),
        "/useless": ("skip", "useless"), "/secret": ("skip", "protected"), "/u/regex/(?P<id>x)": ("skip", "regex"),
        "/u/list": ("list", None), "/u/dict": ("dict", None), "/u/args-list": ("dict", None),
        "/u/none": ("skip", "no_endpoints"), "/u/absent": ("skip", "no_endpoints"), "/u/no-args": ("skip", "no_args"),
        "/u/null-args": ("skip", "no_args"), "/u/no-self": ("skip", "no_self_link"), "/u/null": ("skip", "no_endpoints"),
    }
    known_only = routes.dispatch(table, catalogue(spark), include_unknown=False)
    assert {r.route for r in known_only.where("action <> 'skip'").collect()} == {"/wp/v2/posts", "/wp/v2/types", "/twice"}


def test_catalogue_without_a_category_fails_later_routes(spark):
    known = catalogue(spark).where("category <> 'public-dict'")
    assert category_gaps(known) == ["public-dict"] and category_gaps(seed_catalogue(spark)) == []
    planned = routes.dispatch(routes_table(spark, DEFINITIONS), known, absent_categories=category_gaps(known))
    found = {r.route: r.skip_reason for r in planned.collect()}
    assert found["/wp/v2/posts"] is None and found["/secret"] == "catalogue_incomplete" == found["/u/list"]


def test_missing_category_is_zero(spark):
    only = routes.categorise(routes_table(spark, {"/wp/v2/posts": SELF}), catalogue(spark))
    assert routes.category_statistics(only).first().useless == 0


def test_later_route_keeps_the_name(spark):
    table = routes_table(spark, {"/a/b_c": SELF, "/a_b/c": SELF, "/x": SELF})
    known = spark.createDataFrame([("public-list", r) for r in ("/a/b_c", "/a_b/c", "/x")], schemas.KNOWN_ROUTES)
    marked = routes.mark_overwritten(routes.dispatch(table, known))
    assert {r.route: r.overwritten for r in marked.collect()} == {"/a/b_c": True, "/a_b/c": False, "/x": False}


def test_preview_shows_ten_and_counts_the_rest(spark):
    table = routes_table(spark, {f"/n/{i}": None for i in range(13)})
    shown = routes.unknown_preview(routes.unknown_routes(table, catalogue(spark))).orderBy("place").collect()
    assert [r.route for r in shown] == [f"/n/{i}" for i in range(10)] and {r.n_more for r in shown} == {3}


def test_orders(spark):
    table = routes_table(spark, {"/b": None, "/Z": None, "/é": None, "/a": None})
    assert [r.route for r in routes.in_index_order(table).collect()] == ["/b", "/Z", "/é", "/a"]
    assert [r.route for r in routes.in_name_order(table).collect()] == sorted(["/b", "/Z", "/é", "/a"])


def test_strict_json(spark):
    import json

    texts = ['{"a":\'b\'}', '{"a":"x\ty"}', '{"a":1,"a":"it\'s"}', '[1] x', '1,0],[', '[1],0],[2', '1,"b":0},{', '{\n"a": "\\\\", "b\'": "\\"\'"}', "'a'", '["a\nb"]',
             "", " ", "1", '"x\'"', '[1,\t2]', '{"a":"\\u0009"}', '["\\""]', "{'a':1}", '["a","b\x01","c"]']

    def valid(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    got = {r.v: r.ok for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", json_shapes.is_json(F.col("v")).alias("ok")).collect()}
    assert got == {t: valid(t) for t in texts}


def test_odd_index_texts_are_judged_and_read_as_before(spark):
    bodies = {
        "whole": ('{"routes":{"/a":{"x":"it\'s"},"/b":null}}', ["/a", "/b"]),
        "listed": ('[{"routes":{"/a":1}}]', []),
        "again": ('{"routes":{"/a":1},"routes":{"/b":2}}', ["/b"]),
        "spaced": ('\n\t {"routes":{"/a":1}} \n', ["/a"]),
        "behind": ('{"routes":{"/a":1}},{"mark":"x"}', []),
        "closed": ('{"routes":{"/a":1}},{"mark":"x"}],[1', []),
        "quotes": ("{'routes':{'/a':1}}", []),
        "not_a_number": ('{"routes":{"/a":NaN}}', []),
        "control": ('{"routes":{"/a":"\x01"}}', []),
        "half": ('{"routes":{"/a":1}', []),
        "marked": ('{"mark":[1],"routes":{"/a":1}}', ["/a"]),
    }
    rows = [(name, None, 200, None, body) for name, (body, _) in bodies.items()]
    index = spark.createDataFrame(rows, "domain string, fetched_at timestamp, status int, error string, body string")
    found = routes.explode_routes(index).orderBy("domain", "route_pos").collect()
    assert {n: [r.route for r in found if r.domain == n] for n in bodies} == {n: names for n, (_, names) in bodies.items()}


def test_index_texts_are_parsed_once(spark):
    index = spark.createDataFrame([], "domain string, fetched_at timestamp, status int, error string, body string")
    plan = routes.explode_routes(index)._jdf.queryExecution().optimizedPlan().toString()
    # one parse of what begins with an object, with its judgement; for other texts a judgement and a parse
    assert plan.count("from_json(") == 2 and plan.count("get_json_object(") == 1 and "json_object_keys(" not in plan
