"""A dump driven to its end: rounds of requests, each saved whole before the next is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry import schemas
from sitequarry.operators import pages, routes
from sitequarry.plans import jobs
from sitequarry.session import stored, whole
from sitequarry.sources import fetch

#: Pages of a route without an announced number that one round asks for at most; rounds double up to it.
MOST_AHEAD = 1024


def crawl(
    site_index: DataFrame,
    known_routes: DataFrame,
    transport: fetch.Transport,
    folder: str,
    include_unknown: bool = True,
    retry_count: int = schemas.RETRY_COUNT,
    page_size: int = schemas.PAGE_SIZE,
    tasks: int | None = None,
    per_site: int | None = None,
    tell_attempt: bool = False,
    most_rounds: int | None = None,
) -> DataFrame:
    """The responses of all routes of the given sites, asked for until no route is open.

    Round 0 asks for the dictionaries and first pages, each later round for what next_requests plans behind the rounds before
    it: the rest of the announced pages, and twice as many pages as last time of other routes. A page that fails is asked for
    again at once, up to `retry_count` times, as one try follows the other in a run of one site.

    `folder` keeps for each round its requests, its responses and the numbers that planning needs, so bodies are read once, by
    their own round. What is there whole is not done again: a call with the folder of a run that broke off asks for the
    requests of the round it broke in, and goes on. `most_rounds` breaks off by itself.
    """
    spark = site_index.sparkSession
    if not whole(spark, f"{folder}/plan"):
        planned = routes.dispatch(routes.explode_routes(site_index), known_routes, include_unknown)
        planned.where("action <> 'skip'").select("domain", "route", "action", "url").write.mode("overwrite").parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    done = 0
    while most_rounds is None or done < most_rounds:
        asked, answered, counted = (_round(folder, part, done) for part in ("requests", "responses", "pages"))
        if not whole(spark, asked):
            ahead = 1 if not done else min(1 << done, MOST_AHEAD)
            wanted = pages.next_requests(plan, _known(spark, folder, done), retry_count, page_size, ahead)
            if not done:
                wanted = wanted.unionByName(_dictionaries(plan))
            wanted.write.mode("overwrite").parquet(asked)
        requests = spark.read.parquet(asked)
        if requests.isEmpty():
            break
        if not whole(spark, answered):
            # dictionaries have one try
            one = requests.where("kind = 'dict'"), requests.where("kind <> 'dict'")
            found = [fetch.fetch(r, transport, tasks, per_site, tell_attempt, n) for r, n in zip(one, (1, retry_count), strict=True)]
            (found[1] if done else found[0].unionByName(found[1])).write.mode("overwrite").parquet(answered)
        if not whole(spark, counted):
            new = spark.read.schema(schemas.RESPONSES).parquet(answered)
            pages.resolve_retries(new, retry_count).write.mode("overwrite").parquet(counted)
        done += 1
    return responses(spark, folder, done)


def _round(folder: str, part: str, number: int) -> str:
    return f"{folder}/{part}/round-{number:06d}"


def _dictionaries(plan: DataFrame) -> DataFrame:
    one = F.lit(1).cast("int")
    return plan.where("action = 'dict'").select("domain", "route", F.lit("dict").alias("kind"), "url", one.alias("page"), one.alias("attempt"))


def _known(spark: SparkSession, folder: str, rounds: int) -> DataFrame:
    """Pages resolved so far, out of the numbers that each round left; written once for all that plan with them."""
    if not rounds:
        return pages.resolve_retries(spark.createDataFrame([], schemas.RESPONSES))
    return stored(pages.merge_resolved(spark.read.parquet(*(_round(folder, "pages", k) for k in range(rounds)))), "known")


def responses(spark: SparkSession, folder: str, rounds: int) -> DataFrame:
    """All responses of the first rounds of a run."""
    reader = spark.read.schema(schemas.RESPONSES)
    if not rounds:
        return spark.createDataFrame([], schemas.RESPONSES)
    return reader.parquet(*(_round(folder, "responses", k) for k in range(rounds)))


def dump(site_index: DataFrame, known_routes: DataFrame, transport: fetch.Transport, folder: str, include_unknown: bool = True,
         retry_count: int = schemas.RETRY_COUNT, **how) -> dict[str, DataFrame]:
    """jobs.dump over the responses of a crawl."""
    found = crawl(site_index, known_routes, transport, folder, include_unknown, retry_count, **how)
    return jobs.dump(site_index, known_routes, found, include_unknown, retry_count)
