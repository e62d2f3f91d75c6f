"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import grouped, let_go, saved
from sitequarry.llm.components import components

SHINGLE = 5
#: Coordinates of a signature.
SIZE = 150
#: Documents with more shingles than a task should hold, or more than so many documents, are compared in blocks.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 1 << 19, 256


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_KNOWN = Words()


def rows_of(percent: int) -> int:
    """Coordinates of a band: as many as leave a pair at `percent` without a common band with probability 1e-5 at most.

    That is (1 - p ** rows) ** (SIZE // rows): 25 bands of 6 (7e-6) at 0.85, 30 bands of 5 (7e-6) at 0.80.
    """
    p = percent / 100
    return max((r for r in range(1, 7) if (1 - p**r) ** (SIZE // r) <= 1e-5), default=1)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of the whole sequence where there are fewer."""
    words = (text or "").encode().lower().split()
    if len(_KNOWN) > 300_000:
        _KNOWN.clear()
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    runs = len(h) - n + 1
    out = np.full(runs, n, np.uint64)
    for i in range(n):
        out = mixed64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + runs])
    return np.unique(out)


def second(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(own: np.ndarray, size: int = SIZE, block: int = 1024) -> np.ndarray:
    """Circulant MinHash: the first permutation orders the elements, the second is applied to their places shifted by 1, 2, … `size`.

    The universe is the 32-bit numbers, places wrap around it. Both permutations are bijections.
    """
    places = (mixed64(own + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(places), block):
        np.minimum(best, second(places[None, a : a + block] - shifts).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, width: int) -> np.ndarray:
    bands = len(sig) // width
    rows = sig[: bands * width].reshape(bands, width).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(width):
        key = mixed64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set as text, null for an empty one) and bands of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = rows_of(percent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                if len(own):
                    bands.append(band_keys(signature(own), width))
                ends.append(ends[-1] + (SIZE // width if len(own) else 0))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(np.array(ends, np.int32), flat)],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_shingles long, set_key string, bands array<long>")


def linked(ids: np.ndarray, values: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """For each set its component's smallest id, under links of 100 * intersection >= percent * union.

    Components grow from one set at a time: a member is compared with all sets that no component has yet, so what
    has been placed is not compared again, and no link is missed.
    """
    order = np.argsort(ids, kind="stable")
    label = np.full(len(ids), -1, np.int64)
    sizes = np.diff(ends)
    free = np.ones(len(ids), bool)
    owner = np.repeat(np.arange(len(ids)), sizes)
    # values that one set alone has link nothing
    kept_value, kept_owner = values, owner
    if len(values):
        _, where, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[where] > 1
        kept_value, kept_owner = where[shared], owner[shared]
    begin = np.searchsorted(kept_owner, np.arange(len(ids) + 1))
    mark = np.zeros(int(kept_value.max()) + 1 if len(kept_value) else 1, bool)
    live_value, live_owner, stale = kept_value, kept_owner, 0
    for first in order.tolist():
        if not free[first]:
            continue
        label[first], free[first] = ids[first], False
        todo = [first]
        while todo:
            at = todo.pop()
            own = kept_value[begin[at] : begin[at + 1]]
            if not len(own):
                continue
            stale += 1
            if stale >= 32:  # drop what has been placed from the lists that are looked through
                still = free[live_owner]
                live_value, live_owner, stale = live_value[still], live_owner[still], 0
            mark[own] = True
            both = np.bincount(live_owner[mark[live_value]], minlength=len(ids))
            mark[own] = False
            near = np.flatnonzero(free & (100 * both >= percent * (sizes[at] + sizes - both)) & (both > 0))
            label[near], free[near] = ids[first], False
            todo.extend(near.tolist())
    return label


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept.

    Documents whose sets of 5-word shingles are alike (100 * intersection >= percent * union) are linked; a component is
    named by its smallest doc_id, and that document is kept. Null and empty texts, and texts without words, have no
    shingles and are linked with nothing. Equal sets are one set, held by their smallest doc_id. Rows that
    repeat a doc_id share its component: the smallest of those of its rows. A row without a doc_id has the component of
    the rows whose set equals its own; where there are none, its component_id is null and it is kept. It links nothing.

    Sets that share a band are candidates. Links to the smallest id of a band's bucket give groups (no pairs are made);
    each group's full sets are then compared once, in one task where they fit a block, else in one task
    for each two blocks of the group, which give at most a link for each set. Only candidates' texts are read again.
    """
    own = docs.select("doc_id", "text")
    sketches = saved(sketched(own, percent), "sketches")
    sets = sketches.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("holder"))
    sets = saved(sets, "sets")
    holders = sketches.join(sets, (sketches["doc_id"] == sets["holder"]) & (sketches["set_key"] == sets["set_key"]), "left_semi")
    holders = saved(holders.select("doc_id", "n_shingles", F.explode("bands").alias("band")).distinct(), "bands")
    buckets = saved(holders.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "low"), "buckets")
    candidates = holders.join(buckets, "band").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    groups = saved(components(candidates), "groups")
    sized = groups.join(holders.select("doc_id", "n_shingles").distinct(), F.col("node") == F.col("doc_id"))
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("all"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_DOCUMENTS)).cast("int")
    totals = saved(totals.select("component", blocks.alias("n_blocks")), "totals")
    members = saved(groups.join(totals, "component"), "members")
    let_go(docs.sparkSession)

    # only holders of sets: a doc_id that occurs twice with different texts may bring a set more, which does no harm
    # members grow with the corpus: texts meet them by a shuffle at every size
    full = own.join(members.hint("merge"), own["doc_id"] == members["node"]).select("component", "n_blocks", "node", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("n_blocks"), batch.column("node"), pa.array(blobs, pa.binary())],
                names=["component", "n_blocks", "node", "own"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    with_sets = full.mapInArrow(sets_of, f"component {kind}, n_blocks int, node {kind}, own binary")
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    placed = with_sets.select("component", block.alias("block"), meets.alias("other"), "node", "own").select(
        "component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "own"
    )
    dealt = placed.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ["component", "p", "q"]):
            ids = rows.column("node").to_numpy()
            lists = [np.frombuffer(x, np.uint64) for x in rows.column("own").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            label = linked(ids, np.concatenate(lists), ends, percent)
            moved = label != ids
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(label[moved])], names=["a", "b"])

    links = dealt.mapInArrow(compare, f"a {kind}, b {kind}")
    found = saved(components(links), "components")
    in_set = sketches.select("doc_id", "n_shingles", "set_key").join(sets, "set_key", "left")
    named = in_set.join(found, F.col("holder") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "holder", "doc_id").alias("component_id")
    )
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component stays, with all its columns; rows that repeat its doc_id stay."""
    kept = near_components(docs, percent).where("kept").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["of"]), "left_semi")
