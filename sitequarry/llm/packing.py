"""Best-fit packing of documents into sequences of a fixed length, by hierarchical residual packing.

Documents are encoded once; only descriptions of their pieces move. Groups of pieces are packed best-fit, longest first. Bins that are
nearly full are done. The others go up a tree as single items: the bins of FAN groups are packed best-fit again, and so on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.byte_pairs import byte_pairs
from sitequarry.llm.common import saved, sliced

#: Pieces that are packed together first, and groups whose bins meet in the next round.
PER_GROUP, FAN = 4096, 8


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only one longer than `size` is cut, and only its first piece may be shorter."""
    first = (length - 1) % size + 1
    return [(0, first), *((a, size) for a in range(first, length, size))]


def pieces_of(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, ids: the pieces of each document's ids with `end` behind them.

    `row` numbers the rows of docs, so that rows which repeat a doc_id stay apart. A null text is an empty one and gives a piece that holds
    `end` alone. ids are packed in the bytes that the vocabulary needs, ids_crc32 is that of 32-bit integers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_pairs(path)
        for batch in sliced(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            owner, piece, start, length, crc, data = [], [], [], [], [], []
            for k, ids in enumerate(encode.many(texts)):
                ids = np.append(ids, np.array([end], encode.kind))
                for p, (a, n) in enumerate(cut(len(ids), size)):
                    own = ids[a : a + n]
                    owner.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    data.append(own.tobytes())
            owner = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(owner), batch.column("doc_id").take(owner), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(data, pa.binary())],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(each, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the fill of each bin: longest first, each into the fullest bin that it fits in."""
    order = np.argsort(-sizes, kind="stable")
    bins, places, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # a bit for each room that some bin has
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += s
        if room > s:
            with_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, places, np.array(fills, np.int64)


def going_up(fills: np.ndarray, size: int, slack: int) -> np.ndarray:
    """Which bins go up. Of two bins at most half full one would have gone into the other, so there is at most one. Only such
    bins can be put into others, and FAN groups meet: more than FAN bins of one fill cannot all be of use. So a group sends up
    at most 1 + FAN * size / 2 bins, and those that stay could not have been joined to any."""
    seen: Counter = Counter()
    up = np.zeros(len(fills), bool)
    for b, f in enumerate(fills.tolist()):
        if f < size - slack:
            seen[f] += 1
            up[b] = seen[f] <= FAN
    return up


def packed_groups(items: DataFrame, level: int, size: int, slack: int) -> DataFrame:
    """Packs the items of each node; `bin`, `place`, `fill` (of the bin) and `up` (on the bin's first item, if it goes up)."""

    def pack(items: pa.Table) -> pa.Table:
        bins, places, fills = best_fit(items.column("length").to_numpy(), size)
        first = places == 0
        node = items.column("node")[0].as_py()
        name = (level << 58) | (node << 28)
        out = items.append_column("bin", pa.array(name + bins)).append_column("place", pa.array(places))
        return out.append_column("fill", pa.array(fills[bins])).append_column("up", pa.array(first & going_up(fills, size, slack)[bins]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.groupBy("node").applyInArrow(pack, f"{kinds}, bin long, place long, fill long, up boolean")


def placed(pieces: DataFrame, size: int = 1024, slack: int = 4, per_group: int = PER_GROUP) -> DataFrame:
    """The pieces (any columns without clashes; `row`, `piece`, `length` are read) with sequence_id and offset.

    A sequence holds at most `size` ids, its pieces follow each other without gaps from 0. Pieces are dealt to groups by their number, so
    the order and sources of the input don't matter and no group is large. No pieces give no rows.
    """
    nodes = max(1, -(-pieces.count() // per_group))
    items = pieces.withColumn("node", F.pmod(F.xxhash64("row", "piece"), F.lit(nodes)))
    ground = saved(packed_groups(items, 0, size, slack), "packed")
    held, levels = ground, []
    while nodes > 1:
        nodes = -(-nodes // FAN)
        rising = held.where("up").select(F.col("bin").alias("item"), F.col("fill").alias("length"), F.expr(f"node div {FAN}").alias("node"))
        held = saved(packed_groups(rising, len(levels) + 1, size, slack), "packed-bins")
        levels.append(held.select("item", "bin", "place"))
    whole = None  # where the bins of a level end up
    for level in reversed(levels):
        if whole is not None:
            level = level.join(whole, "bin", "left").select("item", F.coalesce("last", "bin").alias("bin"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))
        whole = saved(level.select(F.col("item").alias("bin"), F.col("bin").alias("last"), F.col("place").alias("shift")), "places")
    if whole is None:
        whole = ground.where("false").select("bin", F.col("bin").alias("last"), F.col("place").alias("shift"))
    out = ground.join(whole, "bin", "left")
    return out.select(*pieces.columns, F.coalesce("last", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def packed(docs: DataFrame, path: str, size: int = 1024, end: int = 2, **how) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and where each is: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and row).

    Null and empty texts are a piece with `end` alone; a null doc_id is kept; rows that repeat a doc_id are documents of their own; other columns of
    docs are not read. No rows in, no rows out. Reruns over the same files agree.
    """
    pieces = saved(pieces_of(docs, path, size, end), "pieces")
    return pieces, placed(pieces.drop("ids"), size, **how)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, n_ids, ids (packed) of each sequence: at most `size` ids each, so groups are small."""
    own = places.select("row", "piece", "sequence_id", "offset", "length").join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = own.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
    return grouped.select("sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
