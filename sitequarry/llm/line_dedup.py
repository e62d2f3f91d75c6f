"""Removal of repeated passages of lines, found by overlapping windows of three lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import saved

HEIGHT = 3


def line_windows(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, mark (of the text), pos (from 0) and digest of every run of `height` consecutive lines."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), lines.alias("lines")).where(F.size("lines") >= height)
    return cut.select(
        "doc_id",
        "mark",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("lines") - (height - 1)),
                lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, height), "\n").cast("binary"))),
            )
        ).alias("pos", "digest"),
    )


def later_windows(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, mark and pos of all windows but the first of each digest in the order of (doc_id, mark, pos).

    Firsts are found with counts combined in the map tasks and written, so that the join that follows has two
    shuffled sides and a digest of any frequency can be split.
    """
    firsts = (
        line_windows(docs, height)
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    firsts = saved(firsts, "window-firsts")
    every = line_windows(docs, height)
    return (
        every.join(firsts, "digest")
        .where(~F.struct(F.col("doc_id"), F.col("mark"), F.col("pos")).eqNullSafe(F.col("first")))
        .select("doc_id", "mark", "pos")
    )


def line_dedup(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed: lines covered by a later occurrence of a window are removed.

    Lines end at "\\n" alone and are compared exactly, empty ones too. Texts under `height` lines are left as they
    are; a null text is an empty one, which is one empty line. Windows are judged on the input. Rows that repeat a
    doc_id with other texts are documents of their own, in the order of a hash of their texts; rows that repeat both are one document, and all of
    them get the same lines removed.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    places = later_windows(own, height).groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("by")).agg(F.collect_set("pos").alias("places"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("by"))
    joined = own.join(places, same, "left").select("doc_id", "text", "places")
    kind = own.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                lines = text.split("\n")
                counts.append(len(lines))
                if at:
                    edges = np.zeros(len(lines) + height + 1, dtype=np.int64)
                    np.add.at(edges, np.asarray(at), 1)
                    np.add.at(edges, np.asarray(at) + height, -1)
                    covered = np.cumsum(edges)[: len(lines)] > 0
                    text = "\n".join(x for x, c in zip(lines, covered, strict=True) if not c)
                    gone.append(int(covered.sum()))
                else:
                    gone.append(0)
                texts.append(text)
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(digest, pa.string())],
                names=["doc_id", "kept_text", "n_lines", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(cut, f"doc_id {kind}, kept_text string, n_lines long, n_removed long, kept_sha256 string")


SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS p, ls FROM l WHERE len(ls) >= 3),
h AS (SELECT doc_id, p, md5(ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2]) AS h FROM w),
d AS (SELECT doc_id, p FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM d),
e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l)
SELECT e.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY e.i) FILTER (c.i IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id
"""
