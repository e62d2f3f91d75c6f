"""Bulk fetching of planned requests through a transport given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry import schemas

# A transport takes a URL (and, if asked for, the number of the try) and returns status, headers, body; what it raises
# becomes the error text.
Transport = Callable[..., tuple[int, dict[str, str], str]]

# A file transport takes a URL and returns the bytes; what it raises becomes the error text.
FileTransport = Callable[[str], bytes]

_FILES = (
    "domain STRING, source_url STRING, target_path STRING, success BOOLEAN, error STRING, bytes BIGINT, "
    "ts TIMESTAMP, content BINARY"
)


_ANSWER = pa.schema([
    ("domain", pa.string()), ("route", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("page", pa.int32()), ("attempt", pa.int32()),
    ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("error", pa.string()),
    ("fetched_at", pa.timestamp("us", tz="UTC")),
])


#: Bounds on answers that leave a task together: rows, and characters of what they hold.
TOGETHER, LETTERS = 1024, 1 << 20


def _answers(batches: Iterator[pa.RecordBatch], transport: Transport, tell_attempt: bool, tries: int) -> Iterator[dict]:
    """Asks for one row after the other, again after a failure up to the try numbered `tries`; each answer with its time."""
    for batch in batches:
        for row in batch.to_pylist():
            for attempt in range(row["attempt"], max(tries, row["attempt"]) + 1):
                status, headers, body, error = None, None, None, None
                try:
                    status, headers, body = transport(row["url"], attempt) if tell_attempt else transport(row["url"])
                except Exception as failure:  # every failure is data here
                    error = f"{type(failure).__name__}: {failure}"
                told = {"status": status, "headers": None if headers is None else list(headers.items()), "body": body, "error": error}
                yield {**row, **told, "attempt": attempt, "fetched_at": datetime.now(UTC)}
                if error is None and 200 <= status < 400:
                    break


def answers(batches: Iterator[pa.RecordBatch], transport: Transport, tell_attempt: bool = False, tries: int = 1) -> Iterator[pa.RecordBatch]:
    """Each answer by itself, before the next row is asked for."""
    for row in _answers(batches, transport, tell_attempt, tries):
        yield pa.RecordBatch.from_pylist([row], schema=_ANSWER)


def gathered(batches: Iterator[pa.RecordBatch], transport: Transport, tell_attempt: bool = False, tries: int = 1) -> Iterator[pa.RecordBatch]:
    """The same answers in the same order, in batches bounded by rows and letters."""
    held, letters = [], 0
    for row in _answers(batches, transport, tell_attempt, tries):
        held.append(row)
        letters += len(row["url"] or "") + len(row["body"] or "") + len(row["error"] or "")
        if len(held) == TOGETHER or letters >= LETTERS:
            yield pa.RecordBatch.from_pylist(held, schema=_ANSWER)
            held, letters = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ANSWER)


def lanes(plan: DataFrame, tasks: int, per_site: int) -> DataFrame:
    """The plan with `lane` and `turn`: a site's requests take turns in `per_site` of the lanes, which begin at a place of its own.

    In a lane every site's first request comes before anyone's second, so no site keeps the others waiting. A site with very many
    requests is as many sorted runs as it has lanes.
    """
    first = F.pmod(F.xxhash64("domain"), F.lit(tasks))
    spot = F.pmod(F.xxhash64("domain", "route", "page", "kind"), F.lit(min(per_site, tasks)))
    placed = plan.withColumn("lane", F.pmod(first + spot, F.lit(tasks)).cast("int"))
    within = Window.partitionBy("lane", "domain").orderBy("page", "route", "kind")
    return placed.withColumn("turn", F.row_number().over(within))


def fetch(
    plan: DataFrame, transport: Transport, tasks: int | None = None, per_site: int | None = None, tell_attempt: bool = False, tries: int = 1
) -> DataFrame:
    """One response row per plan row (domain, route, kind, url, page, attempt), each with the time of its answer.

    With `tries` a row that failed is asked for again at once, and each try up to that number is a row.
    `tasks` bounds how many tasks ask servers at the same time. A site's requests are spread by route
    and page over those tasks, so one large site does not end up in one task; with `per_site` they go to so many
    of them only, in turn with those of other sites. Answers leave their task in bounded batches. Write the result to a
    table before using it, since a plan that is evaluated twice asks twice.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, transport, tell_attempt, tries)

    wanted = plan.select(
        "domain", "route", "kind", "url", F.col("page").cast("int"), F.col("attempt").cast("int")
    )
    if tasks and per_site:
        dealt = lanes(wanted, tasks, per_site).repartitionById(tasks, "lane")
        wanted = dealt.sortWithinPartitions("turn", "domain").select(wanted.columns)
    elif tasks:
        wanted = wanted.repartition(tasks, "domain", "route", "page")
    return wanted.mapInArrow(ask, schemas.RESPONSES)


def fetch_files(plan: DataFrame, transport: FileTransport, tasks: int | None = None) -> DataFrame:
    """Transfers with their content for the rows of a download plan that need one.

    Files leave the task one by one, so that a batch of large files is never held together.
    """

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                content, error = None, None
                try:
                    content = transport(row.source_url)
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({
                    "domain": [row.domain], "source_url": [row.source_url], "target_path": [row.target_path],
                    "success": [error is None], "error": [error],
                    "bytes": pd.array([None if content is None else len(content)], dtype="Int64"),
                    "ts": [pd.Timestamp.now(tz="UTC")], "content": [content],
                })

    wanted = plan.where("download").select("domain", "source_url", "target_path").distinct()
    if tasks:
        wanted = wanted.repartition(tasks)
    return wanted.mapInPandas(move, _FILES)
