"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequarry.llm.common import let_go, parts, saved

DEGREE = 20
#: Rows of starting edges that a partition should have at least, in blocks.
BLOCKS = 4
EDGES = "node long, other long, distance double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows whose vector is not null, not empty, not all zero and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", v.alias("v")).where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())


def points(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Different vectors (node, v), named by their smallest vec_id, and the `keep` smallest vec_ids of each (node, vec_id).

    Equal vectors are one point of the graph. A search needs no more than its `keep` smallest ids of a point, so
    ranks stop there before rows are shuffled. Ids are read as they are; a vec_id that occurs twice is two rows. Vectors of
    another length than most (than the longest of equally common ones) take no part.
    """
    own = usable(vectors).withColumn("key", F.md5(F.to_binary(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), F.lit("utf-8"))))
    own = saved(own, "vectors")
    # a row per length
    length = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    own = own.where(F.size("v") == (length["d"] if length else 0))
    nodes = saved(own.groupBy("key").agg(F.min("vec_id").alias("node"), F.min("v").alias("v")), "points")
    ranked = own.select("key", "vec_id").withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("turn") <= keep)
    members = ranked.join(nodes.select("key", "node").hint("merge"), "key").select("node", "vec_id")
    return nodes.select("node", "v"), saved(members, "members")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def edge_batch(node: np.ndarray, other: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(distance)], names=["node", "other", "distance"])


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a bounded block."""
    n = (x * x).sum(axis=1)
    return np.maximum(n[:, None] + n[None, :] - 2 * x @ x.T, 0)


def first_guess(nodes: DataFrame, dim: int, tables: int, block: int, seed: int) -> DataFrame:
    """Starting edges: points in the order of their signs against random planes, compared in runs of `block` points.

    Runs are cut by position, so that many points with one code are no large group. A partition holds several blocks, so no
    point is alone in its run; few points make one partition, and up to 2 * block rows make one run, whatever the session's settings are.
    """
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, 12, dim))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            for t in range(tables):
                s = x @ planes[t].T
                bits = (s[:, :-1] > 0) @ (1 << np.arange(planes.shape[1] - 2, -1, -1))
                place = bits + 1 / (1 + np.exp(-s[:, -1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(place), batch.column("node"), batch.column("v")], names=["t", "place", "node", "v"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def runs() -> Iterator[pa.Table]:
            nonlocal held
            n = 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= 2 * block:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    full = (n // block - 1) * block
                    for a in range(0, full, block):
                        yield whole.slice(a, block)
                    held = whole.slice(full).to_batches()
                    n -= full
            if n:
                yield pa.Table.from_batches(held).combine_chunks()

        for run in runs():
            # a run over several tables has a point several times
            ids, first = np.unique(run.column("node").to_numpy(), return_index=True)
            d = squares(matrix(run.column("v").combine_chunks())[first])
            np.fill_diagonal(d, np.inf)
            k = min(DEGREE, len(ids) - 1)
            if k < 1:
                continue
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            yield edge_batch(np.repeat(ids, k), ids[near.ravel()], np.take_along_axis(d, near, axis=1).ravel())

    coded = nodes.mapInArrow(code, "t int, place double, node long, v array<double>")
    spread = min(parts(nodes.sparkSession), nodes.count() * tables // (BLOCKS * block))
    dealt = coded.repartitionByRange(spread, "t", "place") if spread > 1 else coded.coalesce(1)
    ordered = dealt.sortWithinPartitions("t", "place").select("node", "v")
    return ordered.mapInArrow(compare, EDGES)


def best(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The `degree` nearest others of each node, as one row: node, others, reach (the largest distance), full.

    At most `degree` edges of a node and source come from any one task, and a node's edges are few per source.
    """
    near = Window.partitionBy("node").orderBy("distance", "other")
    # the distance of one pair differs in its last bits between blocks
    pairs = edges.groupBy("node", "other").agg(F.min("distance").alias("distance"))
    top = pairs.withColumn("turn", F.row_number().over(near)).where(F.col("turn") <= degree)
    return top.select("node", "other", "distance")


def improved(nodes: DataFrame, graph: DataFrame, last: DataFrame | None) -> DataFrame:
    """Edges between neighbours of one point: each point's neighbours and some of the points that have it as theirs.

    The points around a point, at most three times the degree of them, meet in one row with their vectors. Pairs that were
    around it in the round before are left out, and so are edges that cannot enter a list.
    """
    out = graph.select("node", "other")
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "distance")
    some = Window.partitionBy("node").orderBy("distance", "other")
    # the nearest of those that have it, which ranks before the shuffle too
    back = back.withColumn("turn", F.row_number().over(some)).where(F.col("turn") <= DEGREE).select("node", "other")
    around = out.unionByName(back).distinct()
    fresh = around.withColumn("fresh", F.lit(True)) if last is None else around.join(last.withColumn("old", F.lit(True)), ["node", "other"], "left").select("node", "other", F.col("old").isNull().alias("fresh"))
    reach = graph.groupBy("node").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"))
    reach = nodes.join(reach, "node").select(F.col("node").alias("other"), "v", F.when(F.col("n") >= DEGREE, F.col("reach")).otherwise(float("inf")).alias("reach"))
    rows = fresh.join(reach, "other").groupBy("node").agg(F.collect_list(F.struct("other", "v", "reach", "fresh")).alias("near"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d = [], [], []
            lists = batch.column("near")
            flat = lists.flatten()
            ids, reach = flat.field("other").to_numpy(), flat.field("reach").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            x = matrix(flat.field("v"))
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                s = squares(x[p:q])
                new = (fresh[p:q, None] | fresh[None, p:q]) & (s < reach[p:q, None])
                np.fill_diagonal(new, False)
                i, j = np.nonzero(new)
                a.append(ids[p + i])
                b.append(ids[p + j])
                d.append(s[i, j])
            yield edge_batch(np.concatenate(a), np.concatenate(b), np.concatenate(d))

    return rows.mapInArrow(meet, EDGES), around


def nn_graph(nodes: DataFrame, dim: int, rounds: int = 4, tables: int = 4, block: int = 256, seed: int = 5) -> DataFrame:
    """node, other, distance (squared): for each point its DEGREE nearest others found in so many rounds."""
    graph = saved(best(first_guess(nodes, dim, tables, block, seed)), "graph")
    last = None
    for _ in range(rounds):
        more, around = improved(nodes, graph, last)
        last = saved(around, "around")
        graph = saved(best(graph.unionByName(more)), "graph")
        let_go(nodes.sparkSession)
    return graph


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int, rounds: int) -> DataFrame:
    """query, node, distance: the `beam` nearest points found for each query (query, node, v), its own included.

    Greedy: each round looks at the neighbours, in both directions, of the points of the beam that were not looked at. It ends when no
    query has a new one, or after `rounds`.
    """
    both = graph.select("node", "other").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = saved(both.distinct(), "both-ways")
    near = Window.partitionBy("query").orderBy("distance", "node")

    def measured(pairs: DataFrame) -> DataFrame:
        to = nodes.select("node", F.col("v").alias("w"))
        apart = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(queries.select("query", "v"), "query").join(to, "node").select("query", "node", F.sqrt(apart).alias("distance"))

    own = queries.select("query", "node", F.lit(0.0).alias("distance"), F.lit(False).alias("seen"))
    found = saved(own, "beam")
    for _ in range(rounds):
        step = found.where("NOT seen").select("query", "node").join(both, "node").select("query", F.col("other").alias("node")).distinct()
        step = step.join(found.select("query", "node"), ["query", "node"], "left_anti")
        ranked = found.withColumn("seen", F.lit(True)).unionByName(measured(step).withColumn("seen", F.lit(False)))
        ranked = ranked.withColumn("turn", F.row_number().over(near)).where(F.col("turn") <= beam).drop("turn")
        found = saved(ranked, "beam")
        if found.where("NOT seen").isEmpty():
            break
    return found.select("query", "node", "distance")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, beam: int = 192, rounds: int = 12, **how) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k nearest others found.

    Nearness is Euclidean distance in double precision of the vectors as given, ties go to the smaller vec_id. Vectors that are null, empty or
    zero, or hold null or non-finite components, take no part, and if lengths differ only those of the commonest length do. Rows that
    repeat a vec_id are searched for and found each.
    """
    nodes, members = points(vectors, k + 1)
    sample = nodes.select(F.size("v").alias("n")).first()
    dim = sample.n if sample else 1
    graph = nn_graph(nodes, dim, **how)
    # queries with one vector are searched once
    asked = usable(vectors).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    at = asked.join(nodes.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("query_id", "node", "v")
    at = saved(at, "asked")
    seeds = at.groupBy("node").agg(F.min("v").alias("v")).select(F.col("node").alias("query"), "node", "v")
    found = search(nodes, graph, seeds, beam, rounds)
    named = found.join(members, "node").select("query", "vec_id", "distance")
    short = Window.partitionBy("query").orderBy("distance", "vec_id")
    # one more than k: a query itself may be among them
    named = saved(named.withColumn("turn", F.row_number().over(short)).where(F.col("turn") <= k + 1).drop("turn"), "nearest")
    pairs = at.select("query_id", F.col("node").alias("query")).join(named, "query").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
