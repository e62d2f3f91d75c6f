"""A checkpoint that grows by additions: a base, a delta for each run, and compaction.

`<folder>/base-N` holds all paths as of version N; `<folder>/paths-N` and `<folder>/times-N` hold what run N added: new paths, and the
time of the sites that it worked on. A part counts when it is whole, and the newest base replaces all before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators.skew import spread_join
from sitequarry.session import children, whole

PATHS = "domain STRING, path STRING, last_updated DOUBLE"
TIMES = "domain STRING, last_updated DOUBLE"


def _versions(spark: SparkSession, folder: str, part: str) -> list[int]:
    names = [n for n in children(spark, folder) if n.startswith(f"{part}-")]
    return sorted(int(n.rpartition("-")[2]) for n in names if whole(spark, f"{folder}/{n}"))


def _newest(spark: SparkSession, folder: str) -> int:
    return max(_versions(spark, folder, "base") + _versions(spark, folder, "times"), default=-1)


def start(manifest: DataFrame, folder: str) -> None:
    """A base out of a manifest: version 0."""
    _write_base(manifest, folder, 0)


def add(outcomes: DataFrame, folder: str, now: float) -> int:
    """Writes what a run adds: the paths it fetched, and the time for sites that had something to do. Its version.

    Nothing that is there already is read or written again. The times come last, and a run whose times are not there did not happen.
    """
    spark = outcomes.sparkSession
    version = _newest(spark, folder) + 1
    added = outcomes.where("fetched").select("domain", F.col("target_path").alias("path"), F.lit(None).cast("double").alias("last_updated"))
    added.distinct().write.mode("overwrite").parquet(f"{folder}/paths-{version:06d}")
    active = outcomes.where("outcome <> 'skipped'").select("domain", F.lit(float(now)).alias("last_updated"))
    active.distinct().write.mode("overwrite").parquet(f"{folder}/times-{version:06d}")
    return version


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The checkpoint as of the newest version: domain, path, last_updated, each path once."""
    base = max(_versions(spark, folder, "base"), default=-1)
    runs = [v for v in _versions(spark, folder, "times") if v > base]
    parts = [f"{folder}/base-{base:06d}"] * (base >= 0) + [f"{folder}/paths-{v:06d}" for v in runs]
    if not parts:
        return spark.createDataFrame([], PATHS)
    rows = spark.read.schema(PATHS).parquet(*parts)
    paths = rows.groupBy("domain", "path").agg(F.max("last_updated").alias("last_updated"))
    if not runs:
        return paths
    times = None
    for v in runs:
        of_run = spark.read.schema(TIMES).parquet(f"{folder}/times-{v:06d}").withColumn("version", F.lit(v))
        times = of_run if times is None else times.unionByName(of_run)
    last = times.groupBy("domain").agg(F.max_by("last_updated", "version").alias("moved"))
    joined = spread_join(paths, last, ["domain"], "left", by=["path"])
    return joined.select("domain", "path", F.coalesce("moved", "last_updated").alias("last_updated"))


def compact(spark: SparkSession, folder: str) -> None:
    """Writes a base of the newest version; what it replaces stays until someone removes it, so readers are not disturbed."""
    version = _newest(spark, folder)
    if version >= 0 and version not in _versions(spark, folder, "base"):
        _write_base(read(spark, folder), folder, version)


def _write_base(manifest: DataFrame, folder: str, version: int) -> None:
    """Files are buckets of path hashes, so that equal paths lie together."""
    rows = manifest.select("domain", "path", F.col("last_updated").cast("double"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "path").sortWithinPartitions("domain", "path").write.mode("overwrite").parquet(f"{folder}/base-{version:06d}")
