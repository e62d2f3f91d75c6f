"""URLs of the site index, of list pages and of media; names derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes whose last path segment may carry ;parameters.
PARAM_SCHEMES = [
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms",
    "sftp", "tel",
]

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"


def index_url(domain: Column, https: bool = True) -> Column:
    return F.concat(F.lit("https://" if https else "http://"), domain, F.lit("/wp-json/"))


def page_url(url: Column, page: Column, page_size: int) -> Column:
    return F.concat(
        url, F.lit("?page="), page.cast("string"), F.lit(f"&order=asc&orderby=id&per_page={page_size}")
    )


def probe_url(url: Column) -> Column:
    return F.concat(url, F.lit("?per_page=1&page=1"))


def output_stem(route: Column) -> Column:
    return F.replace(F.regexp_replace(route, "^/+|/+$", ""), F.lit("/"), F.lit("_"))


def output_name(route: Column, action: Column) -> Column:
    """Name of the file a route is saved to; the root route has an empty stem."""
    return F.concat(output_stem(route), F.when(action == "list", ".jsonl").otherwise(".json"))


def url_path(url: Column) -> Column:
    """Path of a URL without host, query, fragment and parameters; nothing is decoded."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, _SCHEME, 1))
    path = F.regexp_extract(text, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 2)
    takes_params = scheme.isin("", *PARAM_SCHEMES)
    return F.when(takes_params, F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)


def target_path(domain: Column, path: Column) -> Column:
    return F.concat(domain, F.lit("/files/"), F.regexp_replace(path, "^/+", ""))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")


def file_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
