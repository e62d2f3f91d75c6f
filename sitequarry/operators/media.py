"""Media: URLs out of records, target paths, download plans with resume, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import failures, json_shapes, text, urls
from sitequarry.operators.computed import with_computed
from sitequarry.operators.skew import spread_join

TARGET = ["domain", "target_path"]
URL = ["domain", "source_url"]


def media_lines(media: DataFrame) -> DataFrame:
    """Media lines with their source_url, or the reason why they have none.

    `dropped` lines are passed over silently by a run, the other reasons are warned of or break it.
    """
    raw = F.col("raw")
    shape = json_shapes.json_shape(raw)
    # the last of repeated keys counts
    found = F.from_json("raw", "source_url variant")["source_url"]
    # two plain columns, each parsed once; the reason comes from a generator, and filters on it stay above that
    checked = media.withColumn("shape", shape).withColumn("found", F.when(F.col("shape") == "dict", found))
    reason = (
        F.when(raw.isNull() | raw.rlike(r"(?U)^[\s\x1c-\x1f]*$"), "blank")
        .when(F.col("shape") == "invalid", "invalid_json")
        .when(F.col("shape") != "dict", "not_an_object")
        .when(F.col("found").isNull(), "no_source_url")
        .when(F.is_variant_null("found"), "null_source_url")
        .when(F.schema_of_variant("found") != "STRING", "source_url_is_no_text")
    )
    return with_computed(checked, reject_reason=reason).select(
        "domain",
        "line_no",
        "raw",
        F.when(F.col("reject_reason").isNull(), F.col("found").cast("string")).alias("source_url"),
        "reject_reason",
    )


def media_urls(media: DataFrame) -> DataFrame:
    """domain, line_no, source_url of the usable lines; repeats are kept."""
    return media_lines(media).where("reject_reason IS NULL").select("domain", "line_no", "source_url")


def media_rejects(media: DataFrame) -> DataFrame:
    return media_lines(media).where("reject_reason IS NOT NULL").drop("source_url")


def with_targets(media_url_rows: DataFrame) -> DataFrame:
    """URLs with target path, folder and file name, and flags for targets that need care."""
    path = urls.url_path(F.col("source_url"))
    target = F.col("target_path")
    return (
        with_computed(media_url_rows, _path=path)
        .withColumn("target_path", urls.target_path(F.col("domain"), F.col("_path")))
        .withColumn("directory", urls.directory_of(target))
        .withColumn("file_name", urls.file_of(target))
        .withColumn("unsafe_path", F.col("_path").rlike(r"(^|/)\.\.(/|$)"))
        .withColumn("empty_path", F.regexp_replace("_path", "/", "") == "")
        .drop("_path")
    )


def target_collisions(targets: DataFrame) -> DataFrame:
    """Targets that more than one URL is saved to.

    URLs are made distinct before they are counted, so a target with many repeats of few URLs is
    reduced before the shuffle.
    """
    distinct = targets.select(*TARGET, "source_url").distinct()
    return distinct.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")


def missing_media(sites: DataFrame, media: DataFrame) -> DataFrame:
    """Sites without a media list."""
    path = F.concat("domain", F.lit("/data/wp_v2_media.jsonl"))
    return sites.select("domain").join(media.select("domain").distinct(), "domain", "left_anti").select(
        "domain",
        F.lit("media_missing").alias("error_kind"),
        failures.media_missing_message(path).alias("error_message"),
    )


def distinct_urls(media_url_rows: DataFrame) -> DataFrame:
    """One row per (domain, source_url) with the number of lines that name it."""
    return media_url_rows.groupBy(*URL).agg(F.count(F.lit(1)).alias("n_lines"))


def _presence(manifest: DataFrame, existing_files: DataFrame) -> DataFrame:
    """Per target whether it is in the checkpoint and whether the file exists."""
    listed = manifest.select("domain", F.col("path").alias("target_path"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    stored = existing_files.select("domain", F.col("path").alias("target_path"), F.lit(0).alias("c"), F.lit(1).alias("f"))
    return (
        listed.unionByName(stored)
        .groupBy(*TARGET)
        .agg((F.max("c") == 1).alias("in_checkpoint"), (F.max("f") == 1).alias("file_exists"))
    )


def download_plan(
    targets: DataFrame, manifest: DataFrame, existing_files: DataFrame, resume: bool = True
) -> DataFrame:
    """Each row of `targets` with `download`, or the reason it is skipped or needs no transfer.

    Only a site with a checkpoint that is not empty skips what is there (`skip_reason`). Otherwise a
    file that exists is not skipped but done without a transfer (`already_there`). Where the targets tell that a path leads out of its
    site's folder (`unsafe_path`), it is skipped too.
    """
    active = manifest if resume else manifest.limit(0)
    resumed = active.select("domain").distinct().withColumn("resumed", F.lit(True))
    # only targets that a checkpoint or a file tells of need to know whether their site is resumed; every site is dealt, since a look for
    # the busy ones would make both tables again for each count
    known = spread_join(_presence(active, existing_files), resumed, ["domain"], "left", by=["target_path"])
    joined = targets.join(known, TARGET, "left")
    in_checkpoint = F.coalesce("in_checkpoint", F.lit(False))
    file_exists = F.coalesce("file_exists", F.lit(False))
    resumed_site = F.coalesce("resumed", F.lit(False))
    unsafe = F.col("unsafe_path") if "unsafe_path" in targets.columns else F.lit(False)
    reason = F.when(resumed_site & in_checkpoint, "in_checkpoint").when(resumed_site & file_exists, "file_exists").when(unsafe, "unsafe_path")
    return joined.select(
        *targets.columns,
        reason.alias("skip_reason"),
        (reason.isNull() & file_exists).alias("already_there"),
        (reason.isNull() & ~file_exists).alias("download"),
    )


def to_download(plan: DataFrame) -> DataFrame:
    """The resume filter: rows that still need a transfer."""
    return plan.where("download")


def present_but_not_checkpointed(targets: DataFrame, manifest: DataFrame, existing_files: DataFrame) -> DataFrame:
    """Rows whose file is there although no checkpoint lists it; a run counts them as successes."""
    stored = existing_files.select("domain", F.col("path").alias("target_path"))
    listed = manifest.select("domain", F.col("path").alias("target_path"))
    return targets.join(stored, TARGET, "left_semi").join(listed, TARGET, "left_anti").select(targets.columns)


def last_transfers(transfers: DataFrame) -> DataFrame:
    """The latest outcome per URL; at the same time a success goes before a failure, and of equal outcomes the larger in bytes
    and then by its error, so that all columns are of one row."""
    last = F.max(F.struct("ts", "success", "bytes", "error")).alias("t")
    return transfers.groupBy(*URL).agg(last).select(*URL, "t.success", "t.error", "t.bytes", "t.ts")


def with_outcomes(plan: DataFrame, transfers: DataFrame) -> DataFrame:
    """Plan rows with `outcome`: skipped, downloaded, failed, or pending without a transfer row."""
    joined = plan.join(last_transfers(transfers), URL, "left")
    outcome = (
        F.when(F.col("skip_reason").isNotNull(), "skipped")
        .when(F.col("already_there"), "downloaded")
        .when(F.col("success"), "downloaded")
        .when(F.col("success").isNull(), "pending")
        .otherwise("failed")
    )
    transferred = F.col("download") & F.col("success").isNotNull()
    return joined.select(
        *plan.columns,
        outcome.alias("outcome"),
        (F.col("download") & F.coalesce("success", F.lit(False))).alias("fetched"),
        *[F.when(transferred, F.col(c)).alias(c) for c in ("error", "bytes", "ts")],
    )


def failed_urls(outcomes: DataFrame) -> DataFrame:
    """Failed URLs with their message, one row each."""
    return outcomes.where("outcome = 'failed'").select(
        *URL, F.col("error"), failures.download_message(F.col("source_url"), F.col("error")).alias("error_message")
    ).distinct()


def transfer_statistics(outcomes: DataFrame) -> DataFrame:
    """Per site what was downloaded, failed and skipped, the time taken and the speed.

    `outcomes` has one row per URL with n_lines, or one row per line.
    """
    lines = F.col("n_lines") if "n_lines" in outcomes.columns else F.lit(1)

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("outcome") == name, lines).otherwise(0)).cast("bigint")

    micros = F.unix_micros("ts")
    stats = outcomes.groupBy("domain").agg(
        total("downloaded").alias("downloaded"),
        total("failed").alias("failed"),
        total("skipped").alias("skipped"),
        F.sum(lines).cast("bigint").alias("total"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce((F.max(micros) - F.min(micros)) / 1e6, F.lit(0.0)).alias("elapsed"),
    )
    speed = F.when(F.col("downloaded") > 0, F.try_divide(F.col("downloaded").cast("double"), F.col("elapsed")))
    return stats.select(
        "*",
        text.duration_text(F.col("elapsed")).alias("elapsed_text"),
        text.bytes_text(F.col("bytes")).alias("bytes_text"),
        speed.alias("files_per_second"),
    )


def next_manifest(manifest: DataFrame, outcomes: DataFrame, now: float, resume: bool = True) -> DataFrame:
    """The checkpoint after a run: the old paths and those fetched by this run, each once.

    Files found to exist are not added. The time moves only for sites that had something to do:
    a run without resuming, without URLs or with nothing left leaves the checkpoint as it was. `outcomes` is read twice: store what is
    costly to make.
    """
    old = manifest.select("domain", "path", "last_updated")
    if not resume:
        return old
    active = outcomes.where("outcome <> 'skipped'").select("domain").distinct().withColumn("active", F.lit(True))
    added = outcomes.where("fetched").select("domain", F.col("target_path").alias("path"))
    added = added.withColumn("last_updated", F.lit(None).cast("double"))
    merged = old.unionByName(added).groupBy("domain", "path").agg(F.max("last_updated").alias("last_updated"))
    updated = F.when(F.col("active"), F.lit(now)).otherwise(F.col("last_updated"))
    joined = spread_join(merged, active, ["domain"], "left", by=["path"])
    return joined.select("domain", "path", updated.alias("last_updated"))


def wrong_lengths(existing_files: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored files whose length differs from the expected bytes: transfers that broke midway."""
    wanted = expected.select("domain", F.col("target_path").alias("path"), F.col("bytes").alias("expected_length"))
    return existing_files.join(wanted, ["domain", "path"]).where("length <> expected_length")
