import json

from sitequarry import schemas
from sitequarry.operators import catalogue, probe
from sitequarry.sources.catalogue import parse_catalogue

SELF = {"_links": {"self": "U"}}
PAGED = [{"args": {"page": {}, "per_page": {}}}]
PLAIN = [{"args": {"context": {}}}]

# route, definition, first answer, second answer, category, rule; answers are (status, body) or an error
CASES = [
    ("/a/(?P<id>x)", {**SELF, "endpoints": PLAIN}, None, None, "useless", "regex"),
    ("/none", {**SELF, "endpoints": []}, None, None, None, "no_endpoints"),
    ("/absent", SELF, None, None, None, "no_endpoints"),
    ("/first-401", {**SELF, "endpoints": PAGED}, (401, ""), None, "protected", "first_protected"),
    ("/first-list", {**SELF, "endpoints": PAGED}, (200, "[]"), None, "public-list", "first_list"),
    ("/no-self", {"endpoints": PAGED}, (200, "[]"), (200, "[]"), None, "no_self_link"),
    ("/empty-self", {"_links": {"self": ""}, "endpoints": PLAIN}, None, (200, "[]"), None, "no_self_link"),
    ("/broken-paged", {**SELF, "endpoints": PAGED}, "Timeout", "Timeout", "public-list", "broken_paginated"),
    ("/broken-dict", {**SELF, "endpoints": PLAIN}, None, "Timeout", "public-dict", "broken_dict"),
    ("/broken-missing", {**SELF, "endpoints": [{}]}, None, "Timeout", "public-dict", "broken_dict"),
    ("/broken-list", {**SELF, "endpoints": [{"args": []}]}, None, "Timeout", None, "broken_other"),
    ("/broken-null", {**SELF, "endpoints": [{"args": None}]}, None, "Timeout", None, "broken_other"),
    ("/second-403", {**SELF, "endpoints": PLAIN}, None, (403, ""), "protected", "second_protected"),
    ("/x/v1/item/7", {**SELF, "endpoints": PLAIN}, None, (200, '{"id":1}'), "useless", "item"),
    ("/x/v1/other/7", {**SELF, "endpoints": PLAIN}, None, (200, '{"n":1}'), "public-dict", "second_dict"),
    ("/x/7", {**SELF, "endpoints": PLAIN}, None, (200, '{"id":1}'), "public-dict", "second_dict"),
    ("/second-list", {**SELF, "endpoints": PAGED}, (200, "{}"), (200, "[1]"), "public-list", "second_list"),
    ("/first-list-not-paged", {**SELF, "endpoints": PLAIN}, (200, "[]"), (200, "{}"), "public-dict", "second_dict"),
    ("/first-failed", {**SELF, "endpoints": PAGED}, "Timeout", (200, "{}"), "public-dict", "second_dict"),
    ("/bad-json", {**SELF, "endpoints": PLAIN}, None, (200, "<p>"), None, "undecided"),
    ("/teapot", {**SELF, "endpoints": PLAIN}, None, (418, "[]"), None, "undecided"),
    ("/odd?Pname", {**SELF, "endpoints": PLAIN}, None, (200, "[]"), "public-list", "second_list"),
]


def tables(spark):
    unknown = spark.createDataFrame(
        [("d", r, i, json.dumps(d)) for i, (r, d, *_) in enumerate(CASES)],
        "domain string, route string, route_pos int, route_json string",
    )
    answers = []
    for route, _, first, second, *_ in CASES:
        for number, answer in ((1, first), (2, second)):
            if isinstance(answer, tuple):
                answers.append(("d", route, number, answer[0], answer[1], None))
            elif answer:
                answers.append(("d", route, number, None, None, answer))
    return unknown, spark.createDataFrame(answers, schemas.PROBES)


def test_decision_table(spark):
    found = {r.route: (r.category, r.rule) for r in probe.classify(*tables(spark)).collect()}
    assert found == {route: (category, rule) for route, _, _, _, category, rule in CASES}


def test_probe_plans(spark):
    unknown, answers = tables(spark)
    first = {r.route: r.url for r in probe.first_probes(unknown).collect()}
    assert first["/first-401"] == "U?per_page=1&page=1" and "/broken-dict" not in first and "/no-self" not in first
    second = {r.route for r in probe.second_probes(unknown, answers).collect()}
    assert "/first-list" not in second and "/first-401" not in second and "/none" not in second
    assert {"/second-list", "/broken-dict", "/first-failed"} <= second


def test_undecided_is_useless_and_text_is_sorted(spark):
    settled = probe.settle(probe.classify(*tables(spark)))
    groups = {}
    for r in catalogue.category_groups(settled).collect():
        groups.setdefault(r.category, []).append(r.route)
    assert "/teapot" in groups["useless"] and sum(map(len, groups.values())) == len(CASES)
    expected = "\n".join(
        line for c in schemas.CATEGORIES for line in [f"{c}:", *[f"- {r}" for r in sorted(groups[c])]]
    )
    assert catalogue.update_text(settled).first().catalogue_text == expected
    lines = catalogue.update_lines(settled, ("domain",)).orderBy("category_pos", "is_route", "route").collect()
    assert "\n".join(r.line for r in lines) == expected


def test_empty_category_is_left_out(spark):
    proposed = spark.createDataFrame([("d", "useless", "/b"), ("d", "protected", "/a")], "domain string, category string, route string")
    assert catalogue.update_text(proposed).first().catalogue_text == "protected:\n- /a\nuseless:\n- /b"


def test_catalogue_text_is_read(spark, rows):
    text = (
        "# head\n- /lost\nprotected:\n- /a\n-   /b  \n\npublic-list:   # lists\r\n- '/c'\npublic-dict: []\nuseless:\n"
        "  - /d/(?P<id>[\\d]+)\n  - /e:f\n"
    )
    found = rows(parse_catalogue(spark.createDataFrame([(text,)], "text string")), "category", "route")
    assert found == sorted(
        [("protected", "/a"), ("protected", "/b"), ("public-list", "/c"), ("public-dict", None),
         ("useless", "/d/(?P<id>[\\d]+)"), ("useless", "/e:f")], key=str)


def test_conflicts_merge_difference(spark, rows):
    old = spark.createDataFrame([("protected", "/a"), ("public-list", "/a"), ("useless", "/b"), ("useless", "/c")], schemas.KNOWN_ROUTES)
    new = spark.createDataFrame([("protected", "/a"), ("useless", "/b"), ("useless", "/n")], schemas.KNOWN_ROUTES)
    assert rows(catalogue.catalogue_conflicts(old)) == [("/a", 2, "protected,public-list")]
    assert catalogue.merge_catalogue(old, new).count() == 5
    assert rows(catalogue.catalogue_difference(old, new), "route", "change") == [("/a", "moved"), ("/c", "dropped"), ("/n", "new")]
