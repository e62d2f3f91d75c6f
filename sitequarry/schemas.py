"""Schemas of the input tables, as DDL strings."""

SITES = "input STRING"

SITE_INDEX = "domain STRING, fetched_at TIMESTAMP, status INT, error STRING, body STRING"

KNOWN_ROUTES = "category STRING, route STRING"

RESPONSES = (
    "domain STRING, route STRING, kind STRING, url STRING, page INT, attempt INT, status INT, "
    "headers MAP<STRING, STRING>, body STRING, error STRING, fetched_at TIMESTAMP"
)

PROBES = "domain STRING, route STRING, probe INT, status INT, body STRING, error STRING"

MEDIA = "domain STRING, line_no BIGINT, raw STRING"

MANIFEST = "domain STRING, path STRING, last_updated DOUBLE"

EXISTING_FILES = "domain STRING, path STRING, length BIGINT"

TRANSFERS = (
    "domain STRING, source_url STRING, success BOOLEAN, error STRING, bytes BIGINT, ts TIMESTAMP"
)

RECORDS = "domain STRING, route STRING, out_name STRING, page INT, idx INT, record_json STRING"

# The parts of a route definition that any rule reads.
ROUTE_DEFINITION = "_links STRUCT<self: VARIANT>, endpoints ARRAY<STRUCT<args: VARIANT>>"

# Category names, in the order the analysis tries them.
PROTECTED = "protected"
PUBLIC_LIST = "public-list"
PUBLIC_DICT = "public-dict"
USELESS = "useless"
UNKNOWN = "unknown"
CATEGORIES = [PROTECTED, PUBLIC_LIST, PUBLIC_DICT, USELESS]

# The order in which a dump tries them.
DUMP_CATEGORIES = [PUBLIC_LIST, PUBLIC_DICT, PROTECTED, USELESS]

# Defaults of a run.
PAGE_SIZE = 100
RETRY_COUNT = 5
