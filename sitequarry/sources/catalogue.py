"""The catalogue of known routes: loader for its text form and a small seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.schemas import CATEGORIES, PROTECTED, PUBLIC_DICT, PUBLIC_LIST, USELESS

# Core routes of the public REST API, by what an anonymous reader gets from them.
SEED_PROTECTED = [
    "/wp/v2/menus",
    "/wp/v2/menu-items",
    "/wp/v2/menu-locations",
    "/wp/v2/block-patterns/patterns",
    "/wp/v2/block-patterns/categories",
    "/wp/v2/block-types",
    "/wp/v2/font-collections",
    "/wp/v2/font-families",
    "/wp/v2/pattern-directory/patterns",
    "/wp/v2/plugins",
    "/wp/v2/settings",
    "/wp/v2/sidebars",
    "/wp/v2/template-parts",
    "/wp/v2/templates",
    "/wp/v2/themes",
    "/wp/v2/users/me",
    "/wp/v2/widget-types",
    "/wp/v2/widgets",
]
SEED_PUBLIC_LIST = [
    "/wp/v2/blocks",
    "/wp/v2/categories",
    "/wp/v2/comments",
    "/wp/v2/media",
    "/wp/v2/navigation",
    "/wp/v2/pages",
    "/wp/v2/posts",
    "/wp/v2/search",
    "/wp/v2/tags",
    "/wp/v2/users",
]
SEED_PUBLIC_DICT = [
    "/",
    "/oembed/1.0",
    "/wp-block-editor/v1",
    "/wp-site-health/v1",
    "/wp/v2",
    "/wp/v2/statuses",
    "/wp/v2/taxonomies",
    "/wp/v2/types",
]
SEED_USELESS = [
    "/batch/v1",
    "/oembed/1.0/embed",
    "/oembed/1.0/proxy",
    "/wp-block-editor/v1/url-details",
    "/wp/v2/block-directory/search",
]
# Listed both as protected and as public lists; analysis and dump differ on them.
SEED_TWICE = [
    "/wp/v2/avada_faq",
    "/wp/v2/avada_portfolio",
    "/wp/v2/faq_category",
    "/wp/v2/portfolio_category",
    "/wp/v2/portfolio_skills",
    "/wp/v2/portfolio_tags",
    "/wp/v2/wp_pattern_category",
]


def seed_entries() -> list[tuple[str, str]]:
    """(category, route) of the seed; single-item routes follow from the list routes by rule."""
    items = [f"/wp/v2/{name}/(?P<id>[\\d]+)" for name in
             ("blocks", "categories", "comments", "media", "navigation", "pages", "posts", "tags", "users")]
    for name in ("blocks", "navigation", "pages", "posts"):
        items += [
            f"/wp/v2/{name}/(?P<id>[\\d]+)/autosaves",
            f"/wp/v2/{name}/(?P<parent>[\\d]+)/autosaves/(?P<id>[\\d]+)",
            f"/wp/v2/{name}/(?P<parent>[\\d]+)/revisions",
            f"/wp/v2/{name}/(?P<parent>[\\d]+)/revisions/(?P<id>[\\d]+)",
        ]
    blocks = [
        (PROTECTED, SEED_PROTECTED + SEED_TWICE),
        (PUBLIC_LIST, SEED_PUBLIC_LIST + SEED_TWICE),
        (PUBLIC_DICT, SEED_PUBLIC_DICT),
        (USELESS, SEED_USELESS + items),
    ]
    return [(category, route) for category, routes in blocks for route in routes]


def seed_catalogue(spark: SparkSession) -> DataFrame:
    """The seed as known_routes(category, route), a local relation of known size."""
    rows = ", ".join(f"('{c}', r'{r}')" for c, r in seed_entries())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known_routes(category, route)")


def parse_catalogue(documents: DataFrame, text: str = "text") -> DataFrame:
    """Catalogue documents, one per row, to rows (category, route, section, entry) beside their other columns.

    A document lists routes ("- route") below category headers ("category:"). It is one cell, so the
    header is carried down by cutting the cell at its headers, without a shuffle. A header without
    routes gives one row with a NULL route, so that an empty category differs from an absent one.
    """
    keep = [c for c in documents.columns if c != text]
    header = r"(?m)^(" + "|".join(CATEGORIES) + r"):[ \t]*(?:\[[ \t]*\][ \t]*)?(?:#.*)?$"
    unix = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    sections = F.split(F.regexp_replace(unix, header, "\x01$1"), "\x01")
    # what stands before the first header belongs to no category
    named = F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0)))
    lines = F.split(F.col("_section"), "\n")
    entries = F.filter(
        F.transform(lines, lambda line: F.regexp_extract(line, r"^\s*-\s+(\S.*?)\s*$", 1)), lambda e: e != ""
    )
    unquoted = F.regexp_replace(F.col("_route"), r"""^(['"])(.*)\1$""", "$2")
    return (
        documents.select(*keep, F.posexplode(named).alias("section", "_section"))
        .select(*keep, "section", F.get(lines, 0).alias("category"), F.posexplode_outer(entries).alias("entry", "_route"))
        .select(*keep, "category", unquoted.alias("route"), "section", "entry")
    )


def category_gaps(known_routes: DataFrame) -> list[str]:
    """Categories the catalogue lacks altogether; at most four names reach the driver."""
    present = known_routes.where(F.col("category").isin(CATEGORIES)).select("category").distinct()
    found = {row["category"] for row in present.collect()}
    return [c for c in CATEGORIES if c not in found]
