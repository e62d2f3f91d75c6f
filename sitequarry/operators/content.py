"""Typed views of archived records, and the documented query parameters over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.operators import positions
from sitequarry.operators.computed import with_computed

POST = (
    "id bigint, date string, status string, title struct<rendered: string>, "
    "content struct<rendered: string>, excerpt struct<rendered: string>, author bigint, "
    "featured_media bigint, categories array<bigint>, tags array<bigint>"
)
MEDIA = (
    "id bigint, date string, title struct<rendered: string>, media_type string, mime_type string, "
    "post bigint, author bigint, source_url string"
)
COMMENT = (
    "id bigint, post bigint, parent bigint, author bigint, date string, status string, "
    "content struct<rendered: string>"
)
TERM = "id bigint, name string, slug string, parent bigint, taxonomy string, `count` bigint"
USER = "id bigint, name string, slug string, roles array<string>, registered_date string"


def _view(records: DataFrame, schema: str) -> DataFrame:
    """Fields of the records; a missing or ill-typed field is NULL. Each record is parsed once."""
    kept = [c for c in records.columns if c in ("domain", "out_name")]
    parsed = with_computed(records.select(*kept, "record_json"), r=F.from_json("record_json", schema))
    return parsed.select(*kept, "r.*")


def _timestamp(text: str) -> Column:
    return F.col(text).try_cast("timestamp_ntz")


def posts(records: DataFrame) -> DataFrame:
    """Posts and pages; status is `publish` when a record does not tell."""
    return (
        _view(records, POST)
        .withColumn("date", _timestamp("date"))
        .withColumn("status", F.coalesce("status", F.lit("publish")))
        .withColumn("title", F.col("title.rendered"))
        .withColumn("content", F.col("content.rendered"))
        .withColumn("excerpt", F.col("excerpt.rendered"))
    )


def media_items(records: DataFrame) -> DataFrame:
    return (
        _view(records, MEDIA)
        .withColumn("date", _timestamp("date"))
        .withColumn("title", F.col("title.rendered"))
        .withColumnRenamed("post", "parent")
    )


def comments(records: DataFrame) -> DataFrame:
    return (
        _view(records, COMMENT)
        .withColumn("date", _timestamp("date"))
        .withColumn("content", F.col("content.rendered"))
    )


def terms(records: DataFrame) -> DataFrame:
    return _view(records, TERM)


def users(records: DataFrame) -> DataFrame:
    return _view(records, USER).withColumn("registered_date", _timestamp("registered_date"))


def between_dates(items: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Items dated within the bounds, both exclusive."""
    if after:
        items = items.where(F.col("date") > F.lit(after).cast("timestamp_ntz"))
    if before:
        items = items.where(F.col("date") < F.lit(before).cast("timestamp_ntz"))
    return items


def with_values(items: DataFrame, column: str, wanted: Sequence | str | int) -> DataFrame:
    """Items whose column has one of the wanted values (one value, a list, or a comma list)."""
    if isinstance(wanted, str):
        wanted = [part.strip() for part in wanted.split(",")]
    elif not isinstance(wanted, Sequence):
        wanted = [wanted]
    return items.where(F.col(column).isin(list(wanted)))


def with_terms(items: DataFrame, column: str, wanted: Sequence[int] | str) -> DataFrame:
    """Items with any of the wanted term ids in the array column `categories` or `tags`."""
    ids = [int(part) for part in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    return items.where(F.arrays_overlap(F.col(column), F.lit(ids).cast("array<bigint>")))


def with_status(items: DataFrame, status: str = "publish") -> DataFrame:
    return items.where(F.col("status") == status)


def search(items: DataFrame, words: str, columns: Sequence[str] = ("title", "content")) -> DataFrame:
    """Items that contain the text, whatever its case, in one of the columns."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(words.lower())), F.lit(False))
    return items.where(found)


def ordered(items: DataFrame, orderby: str = "date", order: str = "desc") -> DataFrame:
    """Sorted by a field, ties by id in the same direction."""
    keys = [orderby] if orderby == "id" else [orderby, "id"]
    return items.orderBy(*[F.col(k).desc() if order == "desc" else F.col(k).asc() for k in keys])


def page_of(sorted_items: DataFrame, page: int = 1, per_page: int = 10, offset: int | None = None) -> DataFrame:
    """One page of the sorted collection of one site; an offset replaces the page number."""
    skip = offset if offset is not None else (page - 1) * per_page
    return sorted_items.offset(skip).limit(per_page)


def page_by_position(items: DataFrame, orderby: str = "date", order: str = "desc", page: int = 1, per_page: int = 10,
                     offset: int | None = None) -> DataFrame:
    """One page of the collection, however late, with `position` from 1: the collection is sorted into ranges, and only those that the page
    overlaps are read for it."""
    skip = offset if offset is not None else (page - 1) * per_page
    keys = [orderby] if orderby == "id" else [orderby, "id"]
    return positions.page_at(*positions.placed(items, positions.sort_keys(keys, order)), skip, per_page)


def page_per_site(items: DataFrame, orderby: str = "date", order: str = "desc", page: int = 1, per_page: int = 10,
                  offset: int | None = None) -> DataFrame:
    """One page of each site's collection, with `place` in that site's order (from 1).

    Rows are ranked in the tasks that read them first, so a site sends no more than the page's end from each.
    """
    skip = offset if offset is not None else (page - 1) * per_page
    keys = [orderby] if orderby == "id" else [orderby, "id"]
    window = Window.partitionBy("domain").orderBy(*[F.col(k).desc() if order == "desc" else F.col(k).asc() for k in keys])
    placed = items.withColumn("place", F.row_number().over(window)).where(F.col("place") <= skip + per_page)
    return placed.where(F.col("place") > skip)


def media_by(items: DataFrame, media_type: str | None = None, mime_type: str | None = None,
             parent: int | None = None) -> DataFrame:
    for column, value in (("media_type", media_type), ("mime_type", mime_type), ("parent", parent)):
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def comments_by(items: DataFrame, post: int | None = None, parent: int | None = None,
                author: int | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("post", post), ("parent", parent), ("author", author), ("status", status)):
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def _site(*views: DataFrame) -> list[str]:
    """The site as a join key: ids are unique within a site only. Views of one site may leave it out."""
    return ["domain"] if all("domain" in v.columns for v in views) else []


def comments_with_posts(comment_items: DataFrame, post_items: DataFrame) -> DataFrame:
    """Comments with title and author of their post, within a site when the views tell the site."""
    keys = _site(comment_items, post_items)
    post_side = post_items.select(
        *keys, F.col("id").alias("post"), F.col("title").alias("post_title"), F.col("author").alias("post_author")
    )
    return comment_items.join(post_side, [*keys, "post"])


def term_counts(post_items: DataFrame, column: str = "categories") -> DataFrame:
    """Posts per term, within a site when the view tells the site."""
    keys = _site(post_items)
    exploded = post_items.select(*keys, "id", F.explode(F.array_distinct(column)).alias("term"))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n_posts"))


def terms_with_counts(term_items: DataFrame, post_items: DataFrame, column: str = "categories") -> DataFrame:
    keys = _site(term_items, post_items)
    counts = term_counts(post_items if keys else post_items.drop("domain"), column).withColumnRenamed("term", "id")
    joined = term_items.drop("count").join(counts, [*keys, "id"], "left")
    return joined.withColumn("count", F.coalesce("n_posts", F.lit(0))).drop("n_posts")


def terms_by(term_items: DataFrame, parent: int | None = None) -> DataFrame:
    return term_items if parent is None else term_items.where(F.col("parent") == parent)


def terms_of_post(
    term_items: DataFrame, post_items: DataFrame, post: int, column: str = "categories", domain: str | None = None
) -> DataFrame:
    """Terms of a post; of the posts with this id on all sites where no site is named."""
    keys = _site(term_items, post_items)
    if domain is not None:
        post_items = post_items.where(F.col("domain") == domain)
    ids = post_items.where(F.col("id") == post).select(*keys, F.explode(column).alias("id"))
    return term_items.join(ids, [*keys, "id"], "left_semi")


def users_with_roles(user_items: DataFrame, roles: Sequence[str] | str) -> DataFrame:
    names = [r.strip() for r in roles.split(",")] if isinstance(roles, str) else list(roles)
    return user_items.where(F.arrays_overlap("roles", F.lit(names)))


def authors(user_items: DataFrame, post_items: DataFrame) -> DataFrame:
    """Users who wrote a post, on their own site when the views tell the site."""
    keys = _site(user_items, post_items)
    wrote = post_items.select(*keys, F.col("author").alias("id")).distinct()
    return user_items.join(wrote, [*keys, "id"], "left_semi")


def search_all(views: dict[tuple[str, str], DataFrame], words: str, types: Sequence[str] | None = None,
               subtypes: Sequence[str] | None = None) -> DataFrame:
    """Search over several views, keyed by (type, subtype): id, title, type, subtype of what is found.

    The site comes first when all views tell it.
    """
    found, keys = None, _site(*views.values())
    for (kind, subtype), items in views.items():
        if (types and kind not in types) or (subtypes and subtype not in subtypes):
            continue
        label = next(c for c in ("title", "name") if c in items.columns)
        columns = [label] + [c for c in ("content",) if c in items.columns]
        hits = search(items, words, columns).select(
            *keys, "id", F.col(label).alias("title"), F.lit(kind).alias("type"), F.lit(subtype).alias("subtype")
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("no view of the wanted types")
    return found


def dictionary_entries(documents: DataFrame) -> DataFrame:
    """Entries of saved dictionaries (types, taxonomies, statuses): domain, route, key, name, slug, entry."""
    entries = documents.where("body IS NOT NULL").select(
        "domain", "route", F.explode(F.from_json("body", "map<string,string>")).alias("key", "entry")
    )
    fields = F.from_json("entry", "name string, slug string")
    return entries.select("domain", "route", "key", fields["name"].alias("name"), fields["slug"].alias("slug"), "entry")


def error_bodies(responses: DataFrame) -> DataFrame:
    """Code, message, status and bad parameters out of error bodies."""
    parsed = F.from_json(
        "body", "code string, message string, data struct<status: int, params: map<string,string>>"
    )
    failed = responses.where("status >= 400").select("domain", "route", "status", "body")
    return with_computed(failed, e=parsed).where("e.code IS NOT NULL").select(
        "domain", "route", "status", F.col("e.code").alias("code"), F.col("e.message").alias("message"),
        F.col("e.data.status").alias("data_status"), F.map_keys("e.data.params").alias("bad_params"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code", "data_status").agg(F.count(F.lit(1)).alias("n_errors"))
