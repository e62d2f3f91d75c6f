"""Hard negatives by exact inner products, several candidates at a time: Kronecker-packed products.

Components are whole numbers. Those of several candidates, each raised by a bias so that none is negative, lie side by side in separated bit fields
of one wide integer per dimension. One product with an anchor's component multiplies all of them, the sum over the dimensions
holds all inner products, and no field runs over into the next, since its width is taken from the largest sum that can occur.

Anchors and rows meet in blocks: every block of anchors with every block of rows, each pair a row of its own, so memory is bounded by two blocks
and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequarry.llm.common import saved
from sitequarry.llm.whole_vectors import matrix, whole_vectors

#: Rows and anchors of a block: their scores take 8 MB.
ROWS, ANCHORS = 4096, 256


@dataclass(frozen=True)
class Fields:
    """Fields of `width` bits, `each` of them in an integer: 64-bit ones where a field fits, integers of any size elsewhere."""

    bias: int
    width: int
    each: int

    @staticmethod
    def of(largest: int, anchor_sum: int) -> Fields:
        """For components up to `largest` and anchors whose absolute components add up to `anchor_sum` at most."""
        # a field holds a sum of anchor * (component + bias), between -half and half, with half added
        width = max(2, (2 * anchor_sum * max(1, largest)).bit_length() + 1)
        return Fields(largest, width, 62 // width if width <= 62 else 8)

    @property
    def kind(self):
        return np.int64 if self.width * self.each <= 62 else object

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Integers by (dimension, place) from candidates (rows of x); field f of place p is candidate p * each + f."""
        n, d = x.shape
        whole = np.zeros((-(-n // self.each) * self.each, d), dtype=self.kind)
        whole[:n] = x.astype(self.kind) + self.bias
        whole = whole.reshape(-1, self.each, d)
        out = np.zeros(whole.shape[::2], dtype=self.kind)
        for f in range(self.each):
            out += whole[:, f] * (1 << (f * self.width))
        return out.T

    def products(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Inner products of all anchors with the n candidates that are packed in words: one product per anchor component and integer."""
        a = anchors.astype(self.kind)
        half = 1 << (self.width - 1)
        sums = np.full((len(a), words.shape[1]), sum(half << (f * self.width) for f in range(self.each)), dtype=self.kind)
        for j in range(a.shape[1]):
            sums += a[:, j, None] * words[j]
        out = np.empty((len(a), words.shape[1], self.each), dtype=self.kind)
        for f in range(self.each):
            out[:, :, f] = (sums >> (f * self.width)) & ((1 << self.width) - 1)
        out -= half + self.bias * a.sum(axis=1)[:, None, None]
        return out.reshape(len(a), -1)[:, :n].astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k largest allowed scores of each anchor; of equal ones the first rows."""
    n = scores.shape[1]
    low, high = int(scores.min(initial=0)), int(scores.max(initial=0))
    if (high - low + 2) * n < 1 << 62:
        rank = (scores - low) * n + np.arange(n - 1, -1, -1)
    else:
        rank = n - 1 - np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    rank = np.where(allowed, rank, -1)
    if k < n:
        top = np.argpartition(rank, n - k, axis=1)[:, n - k :]
    else:
        top = np.broadcast_to(np.arange(n), rank.shape)
    a, t = np.nonzero(np.take_along_axis(rank, top, axis=1) >= 0)
    return a, top[a, t]


def blocks(rows: DataFrame, d: int, most: int, kind: str, asked: bool = False) -> tuple[DataFrame, int]:
    """Blocks of at most `most` rows, a row each, and how many there are; numbered from 0 by `block`.

    Packed arrays in the order of vec_id: row, vec_id, label, x (of `kind`) and, if asked, the scores of each row's positives one
    behind the other (`wanted`) and their numbers (`n_wanted`).
    """
    names = ["row", "vec_id", "label", "x", *(["wanted"] if asked else [])]

    def block(table: pa.Table, part: int, k: int) -> pa.RecordBatch:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        column = {c: table.column(c).combine_chunks() for c in names}
        flat = [column[c].to_numpy().astype("<i8") for c in ("row", "vec_id", "label")] + [matrix(column["x"], d).astype(kind)]
        if asked:
            flat += [column["wanted"].flatten().to_numpy().astype("<i8"), column["wanted"].value_lengths().to_numpy().astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), *(pa.array([f.tobytes()], pa.binary()) for f in flat)], names=["part", "k", *names, *(["n_wanted"] if asked else [])])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, k, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, most), part, k)
                held, n, k = whole.slice(most).to_batches(), n - most, k + 1
        if n:
            yield block(pa.Table.from_batches(held), part, k)

    kinds = "part long, k long, row binary, vec_id binary, label binary, x binary" + (", wanted binary, n_wanted binary" if asked else "")
    made = saved(rows.select(*names).mapInArrow(each, kinds), "vector-blocks")
    # a row per task that made blocks
    per = made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    numbered = made.join(per.select("part", "before"), "part").withColumn("block", F.col("before") + F.col("k")).drop("part", "k", "before")
    return saved(numbered, "numbered-blocks"), made.count()


def meet(rows: tuple[DataFrame, int], anchors: tuple[DataFrame, int], each, kinds: str) -> DataFrame:
    """each(block of rows, block of anchors), dictionaries of one block's columns, for every two blocks."""
    (ours, n_ours), (theirs, n_theirs) = rows, anchors
    left = ours.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_theirs - 1)))).withColumn("cell", F.struct(F.col("block").cast("long"), F.col("other").cast("long")))
    right = theirs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_ours - 1)))).withColumn("cell", F.struct(F.col("other").cast("long"), F.col("block").cast("long")))
    left, right = (f.select(F.col("cell.col1").alias("r"), F.col("cell.col2").alias("a"), *(c for c in f.columns if c not in ("block", "other", "cell"))) for f in (left, right))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return each(*({c: t.column(c)[0].as_py() for c in t.column_names} for t in (a, b)))

    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(both, kinds)


def longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8")


FOUND = "anchor long, anchor_id long, wanted long, row long, vec_id long, score long"


def hard_negatives(vectors: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, per_block: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * c), scores are inner products. Anchors are the rows whose vec_id is divisible by `every`, their positives the first
    rows of their label by score. The negatives of a positive are the first rows of other labels whose score is `low` to `high` hundredths of
    the positive's. Ties go to the smaller vec_id. whole_vectors says which vectors are usable, with a limit at which scores stay exact; rows
    without label or vec_id take no part. Rows that repeat a vec_id are rows of their own: an anchor's repeat may be its positive, and
    results of repeated anchors are there for each. A positive without negatives has no row, and no usable row gives none.
    """
    d = 1 + (vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    rows, d = whole_vectors(vectors, scale, limit=float(int((2**55 / max(1, d)) ** 0.5)), vec_id=F.col("vec_id").cast("long"), label=F.col("label").cast("long"))
    rows = saved(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = lambda x: F.abs(x)
    largest = rows.agg(F.max(F.array_max(F.transform("x", size)))).first()[0] or 0
    summed = anchors.agg(F.max(F.aggregate(F.transform("x", size), F.lit(0).cast("long"), lambda s, x: s + x))).first()[0]
    if summed is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    fields = Fields.of(largest, summed)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"

    def scores(ours: dict, theirs: dict) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the anchors and the rows of two blocks, and whether their labels are equal."""
        x, a = (np.frombuffer(b["x"], kind).reshape(-1, d).astype(np.int64) for b in (ours, theirs))
        return fields.products(a, fields.pack(x), len(x)), longs(theirs["label"])[:, None] == longs(ours["label"])

    def found(ours: dict, theirs: dict, hits: list) -> pa.Table:
        a, w, r, s = (np.concatenate(h) if h else np.empty(0, np.int64) for h in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64),) * 4
        return pa.table([longs(theirs["row"])[a], longs(theirs["vec_id"])[a], w, longs(ours["row"])[r], longs(ours["vec_id"])[r], s], names=[k.split()[0] for k in FOUND.split(", ")])

    def near(ours: dict, theirs: dict) -> pa.Table:
        s, same = scores(ours, theirs)
        a, r = best_of(s, same & (longs(theirs["row"])[:, None] != longs(ours["row"])), positives)
        return found(ours, theirs, [(a, np.zeros(len(a), np.int64), r, s[a, r])])

    def hard(ours: dict, theirs: dict) -> pa.Table:
        s, same = scores(ours, theirs)
        counts, wanted, hits = longs(theirs["n_wanted"]), longs(theirs["wanted"]), []
        first = np.cumsum(counts) - counts
        for k in range(int(counts.max(initial=0))):
            own = np.flatnonzero(counts > k)
            w, t = wanted[first[own] + k], s[own]
            a, r = best_of(t, ~same[own] & (100 * t >= low * w[:, None]) & (100 * t <= high * w[:, None]), negatives)
            hits.append((own[a], w[a], r, t[a, r]))
        return found(ours, theirs, hits)

    def first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    ours = blocks(rows, d, per_block[0], kind)
    pairs = saved(first(meet(ours, blocks(anchors, d, per_block[1], kind), near, FOUND), ["anchor"], positives), "positives")
    asked = anchors.join(pairs.groupBy("anchor").agg(F.collect_set("score").alias("wanted")), F.col("row") == F.col("anchor")).drop("anchor")
    asking = blocks(asked, d, per_block[1], kind, asked=True)
    if not asking[1]:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    mined = first(meet(ours, asking, hard, FOUND), ["anchor", "wanted"], negatives)
    mined = mined.select("anchor", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(mined, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Of the query: labels of rows whose vec_id is divisible by 7 go up by one, as digits do.
SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(range(1, len(r.x) + 1), lambda i: a.x[i] * r.x[i])) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
