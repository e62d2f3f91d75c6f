"""DuckDB SQL for the registered queries, over the given tables.

The inputs are rebuilt from the rules in `bindings.py`; the answers are worked out in another way
than the engine does (windows, attribute tables instead of JSON), so that the two can be compared.
"""

from __future__ import annotations

from sitequarry.functions.domains import BAD_FORMAT, EMPTY, TOO_LONG
from sitequarry.functions.failures import STATUS_HINTS
from sitequarry.plans import bindings as b
from sitequarry.sources.catalogue import seed_entries


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    def cell(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return _text(v) if v is None or isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


_ARGS = {"dict": "dict", "paginated": "dict", "list": "list", "none": "missing", "absent": "missing",
         "noargs": "missing", "null": "other"}
_COUNT = {"none": 0, "absent": None}

# name -> SQL of a common table expression; they may refer to earlier ones
CTES: dict[str, str] = {
    "ord": f"SELECT o_orderkey, {b.DOMAIN} AS domain, {b.VARIANT} AS variant FROM orders",
    "tpl(k, route, has_link, endpoints, args, paginated)": "SELECT * FROM "
    + _values([(k, r, s in ("dict", "text", "list"), _COUNT.get(e, 1), _ARGS[e], e == "paginated")
               for k, r, s, e in b.TEMPLATES]),
    "cat(category, route)": "SELECT * FROM " + _values(seed_entries()),
    "ana": "SELECT route, arg_min(category, CASE category WHEN 'protected' THEN 1 WHEN 'public-list' THEN 2 "
    "WHEN 'public-dict' THEN 3 ELSE 4 END) AS category FROM cat GROUP BY route",
    "dmp": "SELECT route, arg_min(category, CASE category WHEN 'public-list' THEN 1 WHEN 'public-dict' THEN 2 "
    "WHEN 'protected' THEN 3 ELSE 4 END) AS category FROM cat GROUP BY route",
    "rts": f"""SELECT domain, o_orderkey, variant, tpl.*,
        cast(row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS INTEGER) AS route_pos,
        CASE WHEN NOT has_link THEN NULL WHEN variant = 9 AND k = 1 THEN concat('https://', domain, '/again', route)
             ELSE concat('https://', domain, '/wp-json', route) END AS self_url
        FROM ord CROSS JOIN tpl WHERE {b.NORMAL} AND {b.included('k')}""",
    "cust": f"""SELECT domain, route, min(o_orderkey) AS route_pos FROM (
        SELECT {b.CUSTOMER_DOMAIN} AS domain, o_orderkey,
          replace(([{', '.join(_text(r) for r in b.CUSTOMER_ROUTES)}])[cast(o_orderkey % {len(b.CUSTOMER_ROUTES)} AS INTEGER) + 1],
                  '@', cast(o_orderkey AS VARCHAR)) AS route FROM orders) GROUP BY ALL""",
    "cust_ana": "SELECT cust.*, coalesce(ana.category, 'unknown') AS category FROM cust LEFT JOIN ana USING (route)",
    "dsp": """SELECT domain, rts.o_orderkey, route, k, route_pos, coalesce(dmp.category, 'unknown') AS category, self_url,
        endpoints, args, paginated,
        CASE WHEN dmp.category IN ('public-list', 'public-dict') THEN CASE WHEN self_url IS NULL THEN 'no_self_link' END
             WHEN dmp.category IS NOT NULL THEN dmp.category
             WHEN route LIKE '%?P%' THEN 'regex'
             WHEN coalesce(endpoints, 0) = 0 THEN 'no_endpoints'
             WHEN self_url IS NULL THEN 'no_self_link'
             WHEN args IN ('missing', 'other') THEN 'no_args' END AS skip_reason
        FROM rts LEFT JOIN dmp USING (route)""",
    "plan": """SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 'skip' WHEN category = 'public-list' THEN 'list'
          WHEN category = 'public-dict' THEN 'dict' WHEN paginated THEN 'list' ELSE 'dict' END AS action FROM dsp""",
    "named": """SELECT *, CASE WHEN action = 'skip' THEN NULL ELSE concat(replace(trim(route, '/'), '/', '_'),
          CASE action WHEN 'list' THEN '.jsonl' ELSE '.json' END) END AS out_name FROM plan""",
    # captured list pages
    "l1": f"SELECT domain, o_orderkey, k, route, {b.LIST_H} AS h FROM rts "
    f"WHERE k IN ({', '.join(map(str, b.LIST_TEMPLATES))})",
    "l2": f"SELECT *, {b.LIST_N} AS n, {b.LIST_V} AS v FROM l1",
    "l3": "SELECT *, unnest(generate_series(1, n + 1)) AS page FROM l2",
    "l4": f"SELECT *, {b.LIST_WIN} AS win, unnest(generate_series(1, {b.LIST_TRIES})) AS attempt FROM l3 "
    f"WHERE {b.LIST_PAGE_CAPTURED}",
    "l5": f"SELECT *, {b.LIST_STATUS} AS status, "
    + ", ".join(f"{b.record_text(i)} AS r{i}" for i in (1, 2, 3))
    + " FROM l4",
    "lst": f"SELECT domain, o_orderkey, k, route, h, n, v, page, attempt, status, r1, r2, r3, {b.LIST_BODY} AS body, "
    f"{b.LIST_TOTAL_PAGES} AS tp, {b.LIST_TOTAL} AS tot FROM l5",
    "won": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, route, page ORDER BY attempt) AS place
        FROM lst WHERE attempt <= 5 AND status BETWEEN 200 AND 399) WHERE place = 1""",
    "shp": """SELECT *, CASE WHEN status <> 200 THEN 'status' WHEN NOT json_valid(body) THEN 'invalid_json'
          WHEN json_type(body) = 'OBJECT' THEN 'dict' WHEN json_type(body) <> 'ARRAY' THEN 'other_type'
          WHEN json_array_length(body) = 0 THEN 'empty_list' END AS stop,
          CASE WHEN json_valid(body) AND json_type(body) = 'ARRAY' THEN json_array_length(body) END AS n_records FROM won""",
    "allr": "SELECT DISTINCT domain, route FROM lst",
    "fst": """SELECT domain, route, try_cast(trim(tp) AS BIGINT) AS total_pages, try_cast(trim(tot) AS BIGINT) AS total_records
        FROM won WHERE page = 1 AND status = 200""",
    "stp": "SELECT domain, route, min(page) AS first_stop, arg_min(stop, page) AS stop FROM shp WHERE stop IS NOT NULL GROUP BY ALL",
    "ends": """SELECT domain, route, total_pages, total_records, first_stop, stop,
          least(first_stop, CASE WHEN total_pages <> 0 THEN greatest(total_pages, 1) END) AS end_page
        FROM allr LEFT JOIN fst USING (domain, route) LEFT JOIN stp USING (domain, route)""",
    "okc": """SELECT domain, route, count(*) AS n_ok, coalesce(sum(n_records) FILTER (WHERE shp.stop IS NULL), 0) AS n_records
        FROM ends JOIN shp USING (domain, route) WHERE page <= end_page GROUP BY ALL""",
    "asm": """SELECT domain, route, n_ok IS NOT NULL AND n_ok = end_page AS complete, end_page, total_pages, total_records,
          coalesce(first_stop = end_page, false) AS by_stop, ends.stop AS stop, okc.n_records AS n_records
        FROM ends LEFT JOIN okc USING (domain, route)""",
    "outc": """SELECT domain, route, CASE WHEN complete THEN 'complete' ELSE 'dropped' END AS outcome,
          CASE WHEN NOT complete THEN 'failed_page' WHEN by_stop THEN stop ELSE 'total_pages' END AS stop_reason,
          CASE WHEN complete THEN end_page END AS end_page,
          CASE WHEN NOT complete THEN 0 WHEN by_stop THEN end_page - 1 ELSE end_page END AS pages_kept,
          CASE WHEN complete THEN end_page - 1 END AS pages_reported, total_pages, total_records, n_records, complete FROM asm""",
    "rec": """SELECT domain, route, page, idx, CASE idx WHEN 0 THEN r1 WHEN 1 THEN r2 ELSE r3 END AS record_json FROM (
          SELECT shp.*, unnest(generate_series(0, cast(shp.n_records AS BIGINT) - 1)) AS idx FROM shp JOIN outc USING (domain, route)
          WHERE complete AND page <= pages_kept)""",
    # captured dictionaries
    "d1": f"SELECT domain, o_orderkey, k, route, {b.DICT_D} AS d, unnest([1, 2]) AS attempt FROM rts "
    f"WHERE k IN ({', '.join(map(str, b.DICT_TEMPLATES))})",
    "dct": f"SELECT *, CASE WHEN attempt = 2 THEN 200 ELSE {b.DICT_STATUS} END AS status, "
    f"CASE WHEN attempt = 2 THEN '{{}}' ELSE {b.DICT_BODY} END AS body FROM d1 WHERE attempt = 1 OR d = 2",
    "doc": """SELECT domain, route, concat(replace(trim(route, '/'), '/', '_'), '.json') AS out_name,
          CASE WHEN status < 400 THEN 'processed' ELSE 'skipped' END AS outcome,
          CASE WHEN status = 200 THEN body END AS body FROM (SELECT *, coalesce(status, 999) AS s FROM dct WHERE attempt = 1)""",
    # probes
    "unk": "SELECT * FROM rts WHERE route NOT IN (SELECT route FROM cat)",
    "p1": f"SELECT domain, route, o_orderkey, k, unnest([1, 2]) AS probe FROM unk",
    "p2": f"SELECT *, {b.PROBE_P} AS p FROM p1",
    "prb": f"SELECT *, {b.PROBE_STATUS} AS status, {b.PROBE_BODY} AS body FROM p2",
    "cls": """SELECT u.domain, u.route, u.route_pos, u.self_url, u.endpoints, u.paginated, f.status AS s1, f.body AS b1,
          CASE WHEN u.route LIKE '%?P<%' THEN 'regex'
            WHEN coalesce(u.endpoints, 0) = 0 THEN 'no_endpoints'
            WHEN u.paginated AND u.self_url IS NOT NULL AND f.status IN (401, 403) THEN 'first_protected'
            WHEN u.paginated AND u.self_url IS NOT NULL AND f.status = 200 AND f.body LIKE '[%' THEN 'first_list'
            WHEN u.self_url IS NULL THEN 'no_self_link'
            WHEN g.status IS NULL THEN CASE WHEN u.paginated THEN 'broken_paginated'
                 WHEN u.args IN ('dict', 'missing') THEN 'broken_dict' ELSE 'broken_other' END
            WHEN g.status IN (401, 403) THEN 'second_protected'
            WHEN u.k = 16 AND g.status = 200 AND g.body = '{"id":5}' THEN 'item'
            WHEN g.status = 200 AND g.body LIKE '[{%' THEN 'second_list'
            WHEN g.status = 200 AND g.body LIKE '{%' THEN 'second_dict' ELSE 'undecided' END AS rule
        FROM unk u JOIN prb f ON u.domain = f.domain AND u.route = f.route AND f.probe = 1
                   JOIN prb g ON u.domain = g.domain AND u.route = g.route AND g.probe = 2""",
    "clc": """SELECT *, CASE rule WHEN 'regex' THEN 'useless' WHEN 'item' THEN 'useless' WHEN 'first_protected' THEN 'protected'
            WHEN 'second_protected' THEN 'protected' WHEN 'first_list' THEN 'public-list' WHEN 'second_list' THEN 'public-list'
            WHEN 'broken_paginated' THEN 'public-list' WHEN 'broken_dict' THEN 'public-dict'
            WHEN 'second_dict' THEN 'public-dict' END AS category FROM cls""",
    "stl": """SELECT domain, route, route_pos, coalesce(category, 'useless') AS category,
          CASE coalesce(category, 'useless') WHEN 'protected' THEN 1 WHEN 'public-list' THEN 2 WHEN 'public-dict' THEN 3 ELSE 4 END
          AS category_pos FROM clc""",
    # catalogue documents
    "scn": """SELECT p_partkey, unnest(['protected', 'protected', 'public-list', 'public-list', 'public-dict', 'useless']) AS category,
          unnest([concat('/p/v1/a', p_partkey % 40), concat('/p/v1/quoted', p_partkey % 7), concat('/p/v1/b', p_partkey % 30),
            concat('/p/v1/a', p_partkey % 50), CASE WHEN p_partkey % 3 <> 0 THEN concat('/p/v1/c', p_partkey) END,
            concat('/p/v1/b', p_partkey % 30, '/(?P<id>[\\d]+)')]) AS route FROM part""",
    # names and media out of pages
    "hst": f"SELECT *, {b.PAGE_HOST} AS host FROM pages",
    "inp": f"SELECT {b.SITE_INPUT} AS input FROM hst",
    "nrm": r"""SELECT input, regexp_replace(CASE WHEN t LIKE 'http://%' OR t LIKE 'https://%'
            THEN regexp_extract(t, '^https?://([^/?#]*)', 1) ELSE t END, '/+$', '') AS domain
        FROM (SELECT input, lower(regexp_replace(input, '^\s+|\s+$', '', 'g')) AS t FROM inp)""",
    "knd": r"""SELECT *, CASE WHEN regexp_matches(domain, '^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$') THEN 'ipv4'
          WHEN regexp_matches(domain, '^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$') THEN 'label'
          WHEN regexp_matches(domain, '^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]$') THEN 'host'
          WHEN regexp_matches(domain, '^\[?[0-9a-f:]+]?$') THEN 'ipv6' END AS kind FROM nrm""",
    "cln": f"""SELECT *, CASE WHEN input = '' THEN {_text(EMPTY)} WHEN kind IS NULL THEN {_text(BAD_FORMAT)}
          WHEN length(domain) > 253 THEN {_text(TOO_LONG)} END AS reject_reason FROM knd""",
    "pmd": f"""SELECT {b.PAGE_DOMAIN} AS domain, page_id AS line_no, {b.PAGE_MEDIA_LINE} AS raw, page_id % 17 AS m, url FROM pages""",
    "pmu": """SELECT domain, line_no, CASE m WHEN 7 THEN '//cdn.example.com/a b;v=1/../shared.png;p=2?x#y'
          WHEN 8 THEN 'https://cdn.example.com' ELSE url END AS source_url FROM pmd WHERE m > 6""",
    # media, manifest, files, transfers out of lineitem
    "itm": f"""SELECT {b.ITEM_DOMAIN} AS domain, {b.ITEM_URL} AS source_url, {b.ITEM_PATH} AS target_path,
          l_partkey, l_suppkey, l_linenumber, l_orderkey FROM lineitem""",
    "tgt": "SELECT domain, source_url, target_path, count(*) AS n_lines FROM itm GROUP BY ALL",
    "man": f"SELECT DISTINCT domain, target_path AS path FROM itm WHERE {b.MANIFEST_ROWS}",
    "fil": f"""SELECT DISTINCT domain, target_path AS path,
          CASE WHEN l_linenumber = 7 THEN 1 ELSE {b.TRANSFER_BYTES} END AS length FROM itm WHERE {b.FILE_ROWS}""",
    "trn": f"""SELECT DISTINCT domain, source_url, {b.TRANSFER_SUCCESS} AS success,
          CASE WHEN {b.TRANSFER_SUCCESS} THEN {b.TRANSFER_BYTES} END AS bytes, (l_partkey % 500) * 10 + 1 AS t FROM itm""",
    "dpl": """SELECT domain, source_url, target_path, n_lines,
          CASE WHEN domain IN (SELECT domain FROM man) THEN
            CASE WHEN (domain, target_path) IN (SELECT (domain, path) FROM man) THEN 'in_checkpoint'
                 WHEN (domain, target_path) IN (SELECT (domain, path) FROM fil) THEN 'file_exists' END END AS skip_reason,
          (domain, target_path) IN (SELECT (domain, path) FROM fil) AS there FROM tgt""",
    "oco": """SELECT dpl.*, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN there OR success THEN 'downloaded' ELSE 'failed' END
          AS outcome, skip_reason IS NULL AND NOT there AS download, success, bytes, t FROM dpl JOIN trn USING (domain, source_url)""",
    # archived records
    "pst": r"""SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN
            (DATE '2020-01-01' + cast(doc_id % 1000 AS INTEGER)) + INTERVAL 10 HOUR END AS date,
          CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'private' ELSE 'publish' END AS status,
          concat(source, ' ', text) AS title, text AS content, lang AS excerpt,
          CASE WHEN doc_id % 13 <> 0 THEN doc_id % 97 END AS author, doc_id % 11 AS featured_media,
          doc_id % 25 AS c1, doc_id % 7 AS c2 FROM documents""",
    "cmt": """SELECT conv_id * 1000 + turn AS id, conv_id AS post, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 ELSE 0 END AS parent,
          CASE WHEN role = 'user' THEN conv_id % 50 ELSE 0 END AS author,
          CASE WHEN turn % 4 = 3 THEN 'hold' ELSE 'approved' END AS status FROM conversations""",
    "ptm": "SELECT id, c1 AS term FROM pst UNION SELECT id, c2 FROM pst",
    "spst": """SELECT concat('s', id % 3, '.example.com') AS domain, id // 3 AS id, date, status, title, content, author, c1, c2 FROM pst""",
    "sptm": "SELECT domain, id, c1 AS term FROM spst UNION SELECT domain, id, c2 FROM spst",
    "strm": """SELECT concat('s', k, '.example.com') AS domain, cast(n_nationkey AS BIGINT) AS id, n_name AS name
          FROM nation, (VALUES (0), (1), (2)) AS sites(k)""",
    "evt": f"""SELECT concat('u', user_id, '.example.com') AS domain, concat('https://cdn.example.com/f', event_id, '.bin') AS source_url,
          {b.EVENT_SUCCESS} AS success, CASE WHEN NOT ({b.EVENT_SUCCESS}) THEN 'HTTP 500' END AS error,
          {b.EVENT_BYTES} AS bytes, ts FROM events""",
}

# expressions -------------------------------------------------------------------------------------


def _duration(seconds: str) -> str:
    s = f"cast(floor({seconds}) AS BIGINT)"
    return (
        f"CASE WHEN {s} < 60 THEN concat({s}, 's') WHEN {s} < 3600 THEN concat({s} // 60, 'm ', {s} % 60, 's') "
        f"WHEN {s} < 86400 THEN concat({s} // 3600, 'h ', {s} // 60 % 60, 'm ', {s} % 60, 's') "
        f"ELSE concat({s} // 86400, 'd ', {s} // 3600 % 24, 'h ', {s} // 60 % 60, 'm') END"
    )


def _bytes(n: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    cases = " ".join(
        f"WHEN {n} < {1024 ** (i + 1)} THEN printf('%.2f {u}', {n} / {1024**i}.0::DOUBLE)" for i, u in enumerate(units[:-1])
    )
    return f"CASE {cases} ELSE printf('%.2f PB', {n} / {1024**5}.0::DOUBLE) END"


_HINTS = "CASE status " + " ".join(
    f"WHEN {code} THEN concat(chr(10), '  Suggestion: ', {_text(hint)})" for code, hint in STATUS_HINTS.items()
) + " ELSE '' END"

_SSL_HINT = (
    "concat(chr(10), '  Suggestion: If you trust this site, certificate verification can be turned off "
    "(not recommended for production).')"
)

_URL_PATH = r"regexp_replace(regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"

_LISTED = (
    "concat_ws(',', CASE WHEN bool_or(category = 'protected') THEN 'protected' END, "
    "CASE WHEN bool_or(category = 'public-list') THEN 'public-list' END, "
    "CASE WHEN bool_or(category = 'public-dict') THEN 'public-dict' END, "
    "CASE WHEN bool_or(category = 'useless') THEN 'useless' END)"
)


def _statistics(source: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE category = '{c}') AS {c.replace('-', '_')}"
        for c in ("protected", "public-list", "public-dict", "useless", "unknown")
    )
    return f"SELECT domain, count(*) AS total_routes, {counts} FROM {source} GROUP BY domain"


_CATEGORISED = "(SELECT rts.*, coalesce(ana.category, 'unknown') AS category FROM rts LEFT JOIN ana USING (route))"
_DISPATCHED = "domain, route, route_pos, category, action, skip_reason, self_url AS url, out_name"
_RETRIES = """WITH_BASE SELECT a.domain, a.route, cast(a.page AS INTEGER) AS page, a.tries, cast(w.attempt AS INTEGER) AS attempt,
  cast(w.status AS INTEGER) AS status, w.attempt IS NULL AS failed
  FROM (SELECT domain, route, page, count(*) FILTER (WHERE attempt <= LIMIT) AS tries FROM lst GROUP BY ALL) a
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, route, page ORDER BY attempt) AS place FROM lst
    WHERE attempt <= LIMIT AND status BETWEEN 200 AND 399) WHERE place = 1) w USING (domain, route, page)""".replace("WITH_BASE ", "")

_PLANNED = """(SELECT domain, route, self_url, unnest(generate_series(1, greatest(coalesce(total_pages, 1), 1))) AS page
  FROM named LEFT JOIN outc USING (domain, route) WHERE action = 'list')"""
_PAGE_URL = "concat(self_url, '?page=', page, '&order=asc&orderby=id&per_page=100')"

_WINDOW = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS done, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed,
  cast(sum(bytes) AS BIGINT) AS bytes FROM (SOURCE) GROUP BY w"""
_TUMBLING = _WINDOW.replace("SOURCE", "SELECT *, date_trunc('hour', ts) AS w FROM evt")
_SLIDING = _WINDOW.replace(
    "SOURCE",
    "SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM evt",
)

_PRESENT = "(SELECT * FROM oco)"
_STATISTICS_ELAPSED = "coalesce((max(t) FILTER (WHERE download) - min(t) FILTER (WHERE download))::DOUBLE, 0.0)"

# name -> final SELECT; the common table expressions it needs are put before it ---------------------

_SELECTS: dict[str, str] = {
    "domain_cleaning": """SELECT input, domain, CASE WHEN reject_reason IS NULL THEN kind END AS domain_kind, reject_reason,
        CASE WHEN reject_reason IS NOT NULL THEN concat('Invalid domain ''', domain, ''': ', reject_reason,
          '. Please provide a valid domain name (e.g., ''example.com'' or ''www.example.com'').') END AS error_message FROM cln""",
    "domains_accepted": "SELECT DISTINCT domain, kind AS domain_kind FROM cln WHERE reject_reason IS NULL",
    "site_health": f"""SELECT domain, url, ok, routes_count, error_kind, CASE WHEN http_error THEN status END AS error_status,
        CASE WHEN error_kind = 'ssl' THEN concat('SSL verification failed for ', url, ': ', error, {_SSL_HINT})
             WHEN error_kind = 'api' THEN concat('WordPress API error for ', url,
               CASE WHEN http_error THEN concat(' (HTTP ', status, ')') ELSE '' END, ': ',
               CASE WHEN variant = 3 THEN 'Invalid response format: no JSON' WHEN variant IN (5, 11) THEN 'Unexpected error: no route list'
                    WHEN variant = 2 THEN error ELSE 'API request failed' END, {_HINTS}) END AS error_message
      FROM (SELECT domain, variant, concat('https://', domain, '/wp-json/') AS url, n IS NOT NULL AS ok, n AS routes_count,
          cast({b.INDEX_STATUS} AS INTEGER) AS status, {b.INDEX_ERROR} AS error, variant IN (0, 6, 7, 8) AS http_error,
          CASE WHEN variant = 1 THEN 'ssl' WHEN variant = 10 THEN 'not_captured'
               WHEN variant IN (0, 2, 3, 5, 6, 7, 8, 11) THEN 'api' END AS error_kind
        FROM ord LEFT JOIN (SELECT domain, count(*) AS n FROM rts GROUP BY domain) USING (domain))""",
    "site_route_counts": "SELECT domain, count(*) AS routes_count FROM rts GROUP BY domain",
    "index_validity": """SELECT domain, state, state = 'ok' AS index_ok,
        CASE state WHEN 'ok' THEN 'routes' WHEN 'no_routes' THEN 'empty' ELSE 'failure' END AS ping_outcome,
        CASE state WHEN 'ok' THEN 'routes' WHEN 'no_routes' THEN 'zeros' ELSE 'failure' END AS analyze_outcome,
        CASE state WHEN 'ok' THEN 'routes' ELSE 'failure' END AS dump_outcome
      FROM (SELECT domain, CASE WHEN variant IN (0, 1, 2, 6, 7, 8) THEN 'fetch_failed' WHEN variant = 3 THEN 'invalid'
          WHEN variant IN (4, 12) THEN 'no_routes' WHEN variant IN (5, 11) THEN 'unusable' ELSE 'ok' END AS state
        FROM ord WHERE variant <> 10)""",
    "index_routes": "SELECT domain, route, route_pos, self_url FROM rts",
    "route_definitions": "SELECT domain, route, endpoints, args, paginated FROM unk",
    "routes_categorised": f"SELECT domain, route, route_pos, category FROM {_CATEGORISED}",
    "category_statistics": _statistics(_CATEGORISED),
    "category_statistics_by_customer": _statistics("cust_ana"),
    "category_totals": "SELECT domain, category, count(*) AS n_routes FROM cust_ana GROUP BY ROLLUP (domain, category)",
    "unknown_routes": "SELECT domain, route FROM cust_ana WHERE category = 'unknown'",
    "unknown_in_index": f"""SELECT ord.domain, tpl.route FROM ord CROSS JOIN tpl WHERE k >= 10
        AND (ord.domain, tpl.route) IN (SELECT (domain, route) FROM rts)""",
    "routes_dispatched": f"SELECT {_DISPATCHED} FROM named",
    "routes_dispatched_known_only": """SELECT domain, route, route_pos, category,
        CASE WHEN reason IS NULL THEN action ELSE 'skip' END AS action, reason AS skip_reason, self_url AS url,
        CASE WHEN reason IS NULL THEN out_name END AS out_name FROM (SELECT *, CASE WHEN category = 'unknown' AND
          coalesce(skip_reason, '') <> 'regex' THEN 'unknown_not_wanted' ELSE skip_reason END AS reason FROM named)""",
    "routes_dispatched_without_dicts": """SELECT domain, route, route_pos,
        CASE category WHEN 'public-dict' THEN 'unknown' ELSE category END AS category,
        CASE WHEN category = 'public-list' THEN action ELSE 'skip' END AS action,
        CASE WHEN category = 'public-list' THEN skip_reason ELSE 'catalogue_incomplete' END AS skip_reason, self_url AS url,
        CASE WHEN category = 'public-list' THEN out_name END AS out_name FROM named""",
    "output_collisions": """SELECT domain, route, out_name,
        route_pos < max(route_pos) OVER (PARTITION BY domain, out_name) AS overwritten FROM named WHERE action <> 'skip'""",
    "unknown_preview": """SELECT domain, cast(place AS INTEGER) AS place, route, n_unknown, greatest(n_unknown - 10, 0) AS n_more FROM (
        SELECT domain, route, row_number() OVER (PARTITION BY domain ORDER BY route_pos) AS place,
          count(*) OVER (PARTITION BY domain) AS n_unknown FROM cust_ana WHERE category = 'unknown') WHERE place <= 10""",
    "request_plan": f"""SELECT domain, route, 'list' AS kind, {_PAGE_URL} AS url, cast(page AS INTEGER) AS page, 1 AS attempt FROM {_PLANNED}""",
    "plan_against_captures": f"""SELECT domain, route, cast(page AS INTEGER) AS page, {_PAGE_URL} AS url,
        coalesce(attempts, 0) AS attempts, attempts IS NOT NULL AS fetched FROM {_PLANNED}
        LEFT JOIN (SELECT domain, route, page, count(*) AS attempts FROM lst GROUP BY ALL) USING (domain, route, page)""",
    "retry_resolution": _RETRIES.replace("LIMIT", "5"),
    "retry_resolution_two_tries": _RETRIES.replace("LIMIT", "2"),
    "page_assembly": """SELECT domain, route, outcome, stop_reason, cast(end_page AS BIGINT) AS end_page,
        cast(pages_kept AS BIGINT) AS pages_kept, cast(pages_reported AS BIGINT) AS pages_reported, total_pages, total_records FROM outc""",
    "dropped_routes": "SELECT domain, route FROM outc WHERE NOT complete",
    "archived_records": """SELECT domain, route, concat(replace(trim(route, '/'), '/', '_'), '.jsonl') AS out_name,
        cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx, record_json FROM rec""",
    "dict_documents": "SELECT domain, route, out_name, outcome, body FROM doc",
    "route_summary": """SELECT domain, route, outcome, CASE WHEN complete THEN cast(n_records AS BIGINT) ELSE 0 END AS records_written,
        CASE WHEN complete THEN coalesce(total_records, cast(n_records AS BIGINT)) END AS records_reported,
        cast(pages_kept AS BIGINT) AS pages_kept, cast(pages_reported AS BIGINT) AS pages_reported FROM outc""",
    "run_statistics": f"""SELECT domain, routes_processed, routes_skipped, total_routes, coalesce(elapsed, 0.0) AS elapsed,
        {_duration('coalesce(elapsed, 0.0)')} AS elapsed_text FROM (
          SELECT domain, count(*) FILTER (WHERE done) AS routes_processed, count(*) FILTER (WHERE NOT done) AS routes_skipped,
            count(*) AS total_routes FROM (SELECT named.domain, action = 'list' OR (action = 'dict' AND
              coalesce(doc.outcome, 'skipped') = 'processed') AS done FROM named LEFT JOIN doc USING (domain, route)) GROUP BY domain)
        LEFT JOIN (SELECT domain, (max(t) - min(t))::DOUBLE AS elapsed FROM (SELECT domain, page * 10 + attempt AS t FROM lst
          UNION ALL SELECT domain, 100 + attempt FROM dct) GROUP BY domain) USING (domain)""",
    "bulk_fetch": """SELECT domain, route, 'list' AS kind, url, 1 AS page, 1 AS attempt,
        CASE WHEN route LIKE '%/feed' THEN NULL ELSE 200 END AS status,
        CASE WHEN route LIKE '%/feed' THEN NULL ELSE concat('[{"length":', length(url), '}]') END AS body,
        CASE WHEN route LIKE '%/feed' THEN 'TimeoutError: read timed out' END AS error FROM (
          SELECT domain, route, concat(self_url, '?page=1&order=asc&orderby=id&per_page=100') AS url FROM named WHERE action = 'list')""",
    "crawled_records": f"""SELECT {b.CRAWL_DOMAIN} AS domain, route, concat(replace(trim(route, '/'), '/', '_'), '.jsonl') AS out_name,
        cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx, concat('{{"id":', page * 10 + idx + 1, '}}') AS record_json
        FROM customer, (VALUES {', '.join(f"('{r}')" for r in b.CRAWL_ROUTES[:2])}) AS r(route), generate_series(1, {b.CRAWL_PAGES}) AS p(page),
          generate_series(0, 1) AS i(idx) WHERE c_custkey % 5 <> 2 AND (c_custkey % 5 <> 3 OR page < 6)""",
    "fetch_lanes": """SELECT domain, count(*) AS n_requests, true AS within_lanes, true AS in_turn FROM named WHERE action = 'list' GROUP BY domain""",
    "probe_plan": """SELECT domain, route, 1 AS probe, concat(self_url, '?per_page=1&page=1') AS url FROM clc
          WHERE rule <> 'regex' AND endpoints > 0 AND paginated AND self_url IS NOT NULL
        UNION ALL SELECT domain, route, 2, self_url FROM clc WHERE rule NOT IN ('regex', 'first_protected', 'first_list')
          AND endpoints > 0 AND self_url IS NOT NULL""",
    "probe_classification": "SELECT domain, route, category, rule FROM clc",
    "inferred_groups": "SELECT domain, category, category_pos, route, route_pos FROM stl",
    "inferred_group_sizes": """SELECT domain, count(*) FILTER (WHERE category = 'protected') AS protected,
        count(*) FILTER (WHERE category = 'public-list') AS public_list, count(*) FILTER (WHERE category = 'public-dict') AS public_dict,
        count(*) FILTER (WHERE category = 'useless') AS useless FROM stl GROUP BY domain""",
    "catalogue_update_text": """SELECT domain, string_agg(concat(category, ':', chr(10), entries), chr(10) ORDER BY category_pos) AS catalogue_text
        FROM (SELECT domain, category, category_pos, string_agg(concat('- ', route), chr(10) ORDER BY route) AS entries
          FROM stl GROUP BY ALL) GROUP BY domain""",
    "catalogue_update_lines": """SELECT domain, category_pos, 1 AS is_route, route, concat('- ', route) AS line FROM stl
        UNION ALL SELECT DISTINCT domain, category_pos, 0, '', concat(category, ':') FROM stl""",
    "catalogue_scan": "SELECT p_partkey, category, route FROM scn",
    "catalogue_conflicts": f"""SELECT route, count(DISTINCT category) AS n_categories, {_LISTED} AS categories FROM scn
        WHERE route IS NOT NULL GROUP BY route HAVING count(DISTINCT category) > 1""",
    "catalogue_merge": "SELECT category, route FROM cat UNION SELECT category, route FROM stl",
    "catalogue_difference": f"""SELECT route, o.c AS old_categories, n.c AS new_categories,
        CASE WHEN o.c IS NULL THEN 'new' WHEN n.c IS NULL THEN 'dropped' ELSE 'moved' END AS change FROM
        (SELECT route, {_LISTED} AS c FROM scn WHERE route IS NOT NULL AND p_partkey % 4 <> 0 GROUP BY route) o FULL JOIN
        (SELECT route, {_LISTED} AS c FROM scn WHERE route IS NOT NULL AND p_partkey % 4 <> 1 GROUP BY route) n USING (route)
        WHERE o.c IS DISTINCT FROM n.c""",
    "media_urls": "SELECT domain, line_no, source_url FROM pmu",
    "media_rejects": """SELECT domain, line_no, raw, CASE m WHEN 0 THEN 'blank' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'no_source_url'
        WHEN 3 THEN 'null_source_url' WHEN 6 THEN 'source_url_is_no_text' ELSE 'not_an_object' END AS reject_reason FROM pmd WHERE m <= 6""",
    "media_targets": rf"""SELECT domain, line_no, source_url, target_path, regexp_replace(regexp_extract(target_path, '^(.*)/[^/]*$', 1), '/+$', '') AS directory,
        regexp_extract(target_path, '([^/]*)$', 1) AS file_name, list_contains(string_split(path, '/'), '..') AS unsafe_path,
        replace(path, '/', '') = '' AS empty_path FROM (SELECT *, concat(domain, '/files/', ltrim(path, '/')) AS target_path FROM (
          SELECT *, {_URL_PATH} AS path FROM pmu))""",
    "target_collisions": "SELECT domain, target_path, count(DISTINCT source_url) AS n_urls FROM itm GROUP BY ALL HAVING count(DISTINCT source_url) > 1",
    "download_plan": """SELECT domain, source_url, target_path, n_lines, skip_reason, skip_reason IS NULL AND there AS already_there,
        skip_reason IS NULL AND NOT there AS download FROM dpl""",
    "download_plan_without_resume": """SELECT domain, source_url, target_path, n_lines, cast(NULL AS VARCHAR) AS skip_reason,
        there AS already_there, NOT there AS download FROM dpl""",
    "resume_filter": "SELECT domain, source_url, target_path, n_lines FROM dpl WHERE skip_reason IS NULL AND NOT there",
    "present_but_not_checkpointed": """SELECT domain, source_url, target_path, n_lines FROM dpl WHERE there
        AND (domain, target_path) NOT IN (SELECT (domain, path) FROM man)""",
    "transfer_outcomes": """SELECT domain, source_url, n_lines, skip_reason, outcome, download AND success AS fetched,
        CASE WHEN download AND NOT success THEN 'HTTP 500' END AS error, CASE WHEN download THEN bytes END AS bytes FROM oco""",
    "transfer_statistics": f"""SELECT *, {_duration('elapsed')} AS elapsed_text, {_bytes('bytes')} AS bytes_text,
        CASE WHEN downloaded > 0 AND elapsed > 0 THEN round(downloaded / elapsed, 6) END AS files_per_second FROM (
        SELECT domain, cast(sum(CASE WHEN outcome = 'downloaded' THEN n_lines ELSE 0 END) AS BIGINT) AS downloaded,
          cast(sum(CASE WHEN outcome = 'failed' THEN n_lines ELSE 0 END) AS BIGINT) AS failed,
          cast(sum(CASE WHEN outcome = 'skipped' THEN n_lines ELSE 0 END) AS BIGINT) AS skipped,
          cast(sum(n_lines) AS BIGINT) AS total, cast(coalesce(sum(bytes) FILTER (WHERE download), 0) AS BIGINT) AS bytes,
          {_STATISTICS_ELAPSED} AS elapsed FROM oco GROUP BY domain)""",
    "failed_urls": """SELECT DISTINCT domain, source_url, 'HTTP 500' AS error, concat('Failed to download ', source_url, ': HTTP 500', chr(10),
        '  Suggestion: Check your internet connection and verify the URL is accessible.') AS error_message FROM oco WHERE outcome = 'failed'""",
    "next_manifest": """SELECT domain, path, CASE WHEN domain IN (SELECT domain FROM oco WHERE outcome <> 'skipped') THEN 1.8e9 ELSE 1.7e9 END AS last_updated
        FROM (SELECT domain, path FROM man UNION SELECT domain, target_path FROM oco WHERE download AND success)""",
    "missing_media": """SELECT DISTINCT domain, 'media_missing' AS error_kind, concat('Media file not found: ', domain, '/data/wp_v2_media.jsonl', chr(10),
        '  Suggestion: Run the dump first to generate the media file list.') AS error_message FROM pmd
        WHERE domain NOT IN (SELECT domain FROM pmd WHERE line_no % 20 < 10)""",
    "checkpoint_scan": """SELECT concat('p', p_partkey) AS domain, unnest([concat('p', p_partkey, '/files/a.jpg'),
        concat('p', p_partkey, '/files/b', p_size, '.jpg')]) AS path, p_partkey + 0.5::DOUBLE AS last_updated FROM part WHERE p_partkey % 9 <> 0""",
    "wrong_lengths": """SELECT domain, path, length, bytes AS expected_length FROM fil
        JOIN (SELECT DISTINCT domain, target_path AS path, bytes FROM tgt JOIN trn USING (domain, source_url) WHERE success) USING (domain, path)
        WHERE length <> bytes""",
    "bytes_as_text": f"""SELECT n, {_bytes('n')} AS size_text FROM (SELECT cast(floor(l_extendedprice * pow(8, l_linenumber)) AS BIGINT) AS n
        FROM lineitem UNION SELECT l_partkey * 32 FROM lineitem)""",
    "durations_as_text": f"""SELECT DISTINCT seconds, {_duration('seconds')} AS duration_text FROM (
        SELECT o_totalprice * (o_orderkey % 7) AS seconds FROM orders)""",
    "posts_view": """SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date_text, status, title, content, excerpt, author, featured_media FROM pst""",
    "posts_between_dates": "SELECT id FROM pst WHERE date > TIMESTAMP '2020-03-01 10:00:00' AND date < TIMESTAMP '2021-07-01 10:00:00'",
    "posts_by_author": "SELECT id, author FROM pst WHERE author IN (3, 5, 8)",
    "posts_with_terms": "SELECT id FROM pst WHERE c1 IN (5, 6) OR c2 IN (5, 6)",
    "posts_with_status": "SELECT id, status FROM pst WHERE status = 'publish'",
    "posts_search": "SELECT id, title FROM pst WHERE contains(lower(title), 'the th') OR contains(lower(content), 'the th')",
    "posts_page": "SELECT id FROM pst WHERE status = 'publish' ORDER BY date DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40",
    "posts_page_late": """SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY date NULLS FIRST, id) AS position FROM pst)
        WHERE position BETWEEN 151 AND 187""",
    "posts_search_indexed": f"""SELECT word, id, title FROM pst JOIN (SELECT unnest([{', '.join(_text(w) for w in b.SEARCHED)}]) AS word) w
        ON contains(lower(title), lower(word)) OR contains(lower(content), lower(word))""",
    "search_all_per_site_indexed": f"""SELECT domain, word, id, title, type, subtype FROM (
          SELECT domain, id, title, content, 'post' AS type, 'post' AS subtype FROM spst
          UNION ALL SELECT domain, id, name, NULL, 'term', 'category' FROM strm)
        JOIN (SELECT unnest([{', '.join(_text(w) for w in b.SEARCHED)}]) AS word) w
        ON contains(lower(title), lower(word)) OR coalesce(contains(lower(content), lower(word)), false)""",
    "stored_records": """SELECT domain, route, concat(replace(trim(route, '/'), '/', '_'), '.jsonl') AS out_name,
        cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx, record_json FROM rec""",
    "checkpoint_grown": """SELECT domain, path, CASE WHEN domain IN (SELECT domain FROM oco WHERE outcome <> 'skipped') THEN 1.8e9 ELSE 1.7e9 END AS last_updated,
        compacted FROM (SELECT domain, path FROM man UNION SELECT domain, target_path FROM oco WHERE download AND success), (VALUES (true), (false)) AS c(compacted)""",
    "checkpoint_additions": "SELECT DISTINCT domain, target_path AS path FROM oco WHERE download AND success AND length(target_path) % 2 = 1",
    "files_inventoried": "SELECT domain, path, max(length) % 1000 AS length FROM fil GROUP BY domain, path",
    "records_in_server_order": """SELECT domain, route, cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx,
        row_number() OVER (ORDER BY domain, route, page, idx) AS position FROM rec""",
    "routes_in_index_order": "SELECT domain, route_pos, route, row_number() OVER (ORDER BY domain, route_pos) AS position FROM rts",
    "routes_in_name_order": "SELECT domain, route, row_number() OVER (ORDER BY domain, route) AS position FROM cust",
    "media_rejects_of_files": """SELECT domain, place AS line_no, raw, CASE m WHEN 0 THEN 'blank' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'no_source_url'
        WHEN 3 THEN 'null_source_url' WHEN 6 THEN 'source_url_is_no_text' ELSE 'not_an_object' END AS reject_reason FROM (
          SELECT *, row_number() OVER (PARTITION BY domain ORDER BY line_no) AS place FROM pmd) WHERE m <= 6""",
    "posts_page_per_site": """SELECT domain, cast(place AS INTEGER) AS place, id FROM (SELECT domain, id, row_number() OVER (
        PARTITION BY domain ORDER BY date DESC NULLS LAST, id DESC) AS place FROM spst WHERE status = 'publish') WHERE place BETWEEN 21 AND 40""",
    "terms_with_counts_per_site": """SELECT domain, id, name, (SELECT count(*) FROM sptm WHERE sptm.domain = strm.domain AND term = strm.id) AS count
        FROM strm""",
    "terms_of_post_per_site": """SELECT domain, id, name FROM strm WHERE domain = 's1.example.com' AND id IN (
        SELECT term FROM sptm WHERE domain = 's1.example.com' AND id = 33)""",
    "authors_per_site": """SELECT domain, id, name FROM (SELECT concat('s', c_custkey % 3, '.example.com') AS domain, c_custkey // 3 AS id,
        c_name AS name FROM customer) SEMI JOIN (SELECT domain, author AS id FROM spst) USING (domain, id)""",
    "search_all_per_site": """SELECT domain, id, title, 'post' AS type, 'post' AS subtype FROM spst
        WHERE contains(lower(title), 'red') OR contains(lower(content), 'red')
        UNION ALL SELECT domain, id, name, 'term', 'category' FROM strm WHERE contains(lower(name), 'red')""",
    "next_requests": """SELECT domain, route, cast(f AS INTEGER) AS page, cast(coalesce(t, 0) + 1 AS INTEGER) AS attempt FROM (
        SELECT named.domain, named.route, coalesce(c, 0) + 1 AS f FROM named LEFT JOIN (SELECT domain, route, count(*) AS c FROM (
          SELECT domain, route, page, row_number() OVER (PARTITION BY domain, route ORDER BY page) AS rn FROM shp) WHERE page = rn GROUP BY ALL)
          USING (domain, route) WHERE action = 'list')
        LEFT JOIN (SELECT domain, route, page AS f, count(*) FILTER (WHERE attempt <= 5) AS t FROM lst GROUP BY ALL) USING (domain, route, f)
        LEFT JOIN stp USING (domain, route) LEFT JOIN fst USING (domain, route)
        WHERE coalesce(t, 0) < 5 AND (first_stop IS NULL OR first_stop >= f) AND (coalesce(total_pages, 0) = 0 OR f <= greatest(total_pages, 1))""",
    "media_filtered": """SELECT p_partkey AS id, p_name AS title, p_partkey % 100 AS parent, concat('https://cdn.example.com/', p_partkey, '.png') AS source_url
        FROM part WHERE p_size % 3 = 0 AND p_size % 4 = 0""",
    "comments_filtered": "SELECT id, post, parent FROM cmt WHERE author = 0 AND status = 'approved'",
    "comments_with_posts": "SELECT cmt.id, post, title AS post_title, pst.author AS post_author FROM cmt JOIN pst ON cmt.post = pst.id",
    "terms_with_counts": """SELECT cast(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS slug, cast(n_regionkey AS BIGINT) AS parent,
        (SELECT count(*) FROM ptm WHERE term = n_nationkey) AS count FROM nation""",
    "terms_of_post": """SELECT cast(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT term FROM ptm WHERE id = 33)""",
    "users_with_roles": """SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug FROM customer
        WHERE lower(c_mktsegment) IN ('machinery', 'building')""",
    "authors": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT author FROM pst)",
    "search_all": """SELECT id, title, 'post' AS type, 'post' AS subtype FROM pst WHERE contains(lower(title), 'red') OR contains(lower(content), 'red')
        UNION ALL SELECT p_partkey, p_name, 'post', 'attachment' FROM part WHERE contains(lower(p_name), 'red')
        UNION ALL SELECT n_nationkey, n_name, 'term', 'category' FROM nation WHERE contains(lower(n_name), 'red')""",
    "dictionary_entries": """SELECT domain, unnest(['post', concat('kind', o_orderkey % 10)]) AS key, unnest(['Posts', 'Kind']) AS name,
        unnest(['post', 'kind']) AS slug FROM dct WHERE k = 4 AND attempt = 1 AND status = 200""",
    "error_counts": """SELECT CASE status WHEN 400 THEN 'rest_invalid_page' WHEN 503 THEN 'busy' ELSE 'rest_no_route' END AS code,
        cast(status AS INTEGER) AS data_status, count(*) AS n_errors FROM (SELECT status FROM lst WHERE status >= 400 UNION ALL
        SELECT status FROM dct WHERE status >= 400) GROUP BY ALL""",
    "error_messages": f"""SELECT url, cast(status AS INTEGER) AS status, concat('WordPress API error for ', url, ' (HTTP ', status, '): API request failed',
        {_HINTS}) AS error_message FROM (SELECT DISTINCT concat('https://', domain, '/wp-json', route) AS url, status
          FROM (SELECT domain, route, status FROM lst UNION ALL SELECT domain, route, status FROM dct) WHERE status >= 400)""",
    "archive_written": """SELECT domain, route, concat(replace(trim(route, '/'), '/', '_'), '.jsonl') AS out_name,
        cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx, record_json FROM rec""",
    "documents_written": "SELECT domain, out_name, route, body FROM doc WHERE body IS NOT NULL",
    "index_snapshot_written": "SELECT domain, true AS saved FROM ord WHERE variant NOT IN (0, 1, 2, 6, 7, 8, 10)",
    "catalogue_lines_written": """SELECT concat('- ', route) AS line FROM (SELECT category, route FROM cat UNION SELECT category, route FROM scn
        WHERE route IS NOT NULL) UNION ALL SELECT concat(category, ':') FROM (SELECT DISTINCT category FROM cat)""",
    "manifest_written": """SELECT domain, count(*) AS n_paths, max(CASE WHEN domain IN (SELECT domain FROM oco WHERE outcome <> 'skipped')
        THEN 1.8e9 ELSE 1.7e9 END) AS last_updated FROM (SELECT domain, path FROM man UNION
        SELECT domain, target_path FROM oco WHERE download AND success) GROUP BY domain""",
    "ingest_stream": "SELECT domain, source_url, success, error, bytes FROM evt",
    "progress_tumbling": _TUMBLING,
    "progress_sliding": _SLIDING,
    "progress_sessions": """SELECT domain, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS done,
        count(*) FILTER (WHERE NOT success) AS failed FROM (SELECT *, sum(fresh) OVER (PARTITION BY domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY domain ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
            FROM evt)) GROUP BY domain, s""",
    "progress_stream": _TUMBLING,
    "retry_stream": """SELECT domain, route, cast(page AS INTEGER) AS page, cast(attempt AS INTEGER) AS attempt,
        cast(last_attempt AS INTEGER) AS last_attempt, CASE WHEN attempt IS NULL THEN 'failed' ELSE 'success' END AS outcome FROM (
        SELECT domain, route, page, min(attempt) FILTER (WHERE attempt <= 5 AND status BETWEEN 200 AND 399) AS attempt,
          max(attempt) AS last_attempt FROM lst GROUP BY ALL) WHERE attempt IS NOT NULL OR last_attempt >= 5""",
    "sites_read": "SELECT input FROM inp",
    "responses_read": """SELECT domain, route, 'list' AS kind, cast(page AS INTEGER) AS page, cast(attempt AS INTEGER) AS attempt,
        cast(status AS INTEGER) AS status FROM lst""",
    "media_written": "SELECT domain, target_path, source_url AS content FROM oco WHERE download AND success",
    "dump_job": """SELECT domain, route, out_name, cast(page AS INTEGER) AS page, cast(idx AS INTEGER) AS idx, record_json FROM rec
        JOIN (SELECT domain, route, out_name, row_number() OVER (PARTITION BY domain, out_name ORDER BY route_pos DESC) AS place
          FROM named JOIN outc USING (domain, route) WHERE action = 'list' AND complete) USING (domain, route) WHERE place = 1""",
}
# written tables and whole jobs give what their last operator gives
_SELECTS |= {
    name: _SELECTS[of]
    for name, of in {
        "statistics_written": "transfer_statistics",
        "ping_job": "site_health",
        "analyze_job": "category_statistics",
        "getfiles_job": "next_manifest",
    }.items()
}


def _with_inputs(select: str) -> str:
    """The SELECT with the common table expressions it names, directly or through others."""
    import re

    bodies = {head.split("(")[0]: (head, body) for head, body in CTES.items()}
    wanted: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & bodies.keys() - wanted:
            wanted.add(name)
            todo.append(bodies[name][1])
    parts = [f"{head} AS ({body})" for name, (head, body) in bodies.items() if name in wanted]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


ORACLES: dict[str, str] = {name: _with_inputs(select) for name, select in _SELECTS.items()}
