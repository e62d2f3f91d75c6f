"""Shape tests on JSON text and on route definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.schemas import ROUTE_DEFINITION

# Stands behind a text that is read as an element of a list.
_MARK = uuid.uuid4().hex

# Options of a parser that takes nothing but JSON.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(body: Column) -> Column:
    """True when the whole text is one JSON value.

    The text is set into a list before a mark that no text holds, since each session draws its own: the mark is the second
    element only if the text is one complete value. Repeated keys are allowed. The parser
    also takes single-quoted strings and control characters in strings, which are not JSON. Without escapes and
    proper strings, texts with those still hold a quote.
    """
    behind = F.get_json_object(F.concat(F.lit("["), body, F.lit(f',"{_MARK}"]')), "$[1]")
    bare = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), r'"[^"\x00-\x1f]*"', "")
    strict = ~body.rlike(r"['\x00-\x1f]") | ~bare.rlike("[\"']")
    return F.coalesce((behind == _MARK) & strict, F.lit(False))


def _begins(body: Column, with_: str) -> Column:
    return F.ltrim(body, F.lit(" \t\n\r")).startswith(with_)


def json_shape(body: Column) -> Column:
    """list, dict, string, other or invalid."""
    return (
        F.when(body.isNull() | ~is_json(body), "invalid")
        .when(_begins(body, "["), "list")
        .when(_begins(body, "{"), "dict")
        .when(_begins(body, '"'), "string")
        .otherwise("other")
    )


def list_length(body: Column) -> Column:
    """Elements of a top-level list; NULL for anything else."""
    return F.when(_begins(body, "["), F.json_array_length(body))


def strict_list_length(body: Column) -> Column:
    """Elements of a text that is one JSON list, told by one strict parse; NULL for others and for what only is_json takes.

    The text and a mark are elements of one list, as in is_json.
    """
    listed = F.concat(F.lit("["), body, F.lit(f',["{_MARK}"]]'))
    read = F.when(_begins(body, "["), F.from_json(listed, "array<array<string>>", _STRICT))

    def counted(lists: Column) -> Column:
        whole = (F.size(lists) == 2) & (F.get(F.get(lists, 1), 0) == _MARK)
        return F.when(whole & F.get(lists, 0).isNotNull(), F.size(F.get(lists, 0)))

    return F.get(F.transform(F.array(read), counted), 0)


def index_read(body: Column) -> Column:
    """A site index whose text begins with `{`, read strictly and once; hand the result to index_routes_of.

    The document and a mark are elements of one list, as in is_json.
    """
    listed = F.concat(F.lit("["), body, F.lit(f',{{"mark":"{_MARK}"}}]'))
    return F.when(_begins(body, "{"), F.from_json(listed, "array<struct<routes:map<string,string>,mark:string>>", _STRICT))


def index_routes_of(read: Column) -> Column:
    """The routes in a document read by index_read; NULL if the text is not one JSON value."""
    whole = (F.size(read) == 2) & (F.get(read, 1)["mark"] == _MARK)
    return F.when(whole, F.get(read, 0)["routes"])


def list_records(body: Column) -> Column:
    """The elements of a JSON list, each as JSON text.

    Reading a list as strings keeps nested text but drops the quotes of plain strings and the word
    null, so lists with such elements are read as variants instead.
    """

    def written(texts: Column) -> Column:
        plain = F.exists(texts, lambda e: e.isNull() | ~(e.startswith("[") | e.startswith("{")))
        variants = F.try_parse_json(body).cast("array<variant>")
        return F.when(plain, F.transform(variants, lambda v: F.to_json(v))).otherwise(texts)

    # as the only element of a list, the texts are read once for both of their uses
    return F.get(F.transform(F.array(F.from_json(body, "array<string>")), written), 0)


def has_key(body: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), key), F.lit(False))


def route_definition(route_json: Column) -> Column:
    """The parsed parts of a route definition; hand the result to the functions below."""
    return F.from_json(route_json, ROUTE_DEFINITION)


def self_link(definition: Column) -> Column:
    """The route's own URL, given as an object, as text or as a list of objects."""
    link = definition["_links"]["self"]
    # only one of the paths can lead anywhere; the costly schema is left for links that are neither a list nor an object
    return F.coalesce(
        F.try_variant_get(link, "$[0].href", "string"),
        F.try_variant_get(link, "$.href", "string"),
        F.when(F.schema_of_variant(link) == "STRING", link.cast("string")),
    )


def endpoint_count(definition: Column) -> Column:
    return F.when(definition["endpoints"].isNotNull(), F.size(definition["endpoints"]))


def first_args(definition: Column) -> Column:
    return F.get(definition["endpoints"], 0)["args"]


def args_kind(definition: Column) -> Column:
    """dict, list, missing or other, for the arguments of the first endpoint."""
    args = first_args(definition)
    return (
        F.when(args.isNull(), "missing")
        .when(F.try_variant_get(args, "$", "array<variant>").isNotNull(), "list")
        .when(F.try_variant_get(args, "$", "map<string,variant>").isNotNull(), "dict")
        .otherwise("other")
    )


def is_paginated(definition: Column) -> Column:
    """True when the first endpoint takes both page and per_page."""
    args = first_args(definition)
    return (
        F.try_variant_get(args, "$.page", "variant").isNotNull()
        & F.try_variant_get(args, "$.per_page", "variant").isNotNull()
    )


def header(headers: Column, name: str) -> Column:
    """A response header by name, whatever its case."""
    matches = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(matches, 0)["value"]


def header_number(headers: Column, name: str) -> Column:
    """A whole-number header; NULL when absent or not a whole number."""
    text = F.trim(header(headers, name))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
