"""Search for texts through an inverted index of three-character grams.

Items are numbered in blocks. A posting list is the numbers of one gram in one block, so a list is as long as a block at most, and a gram that
nearly all items have is as many lists as there are blocks, not one. A search reads the lists of the rarest grams of what is looked
for, intersects them block by block, and confirms what is left on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.session import stored

#: Items of a block, and grams of a text that a search reads lists of.
BLOCK, RAREST = 4096, 4
GRAM = 3


#: Pairs of gram and item that a task holds before it turns them into lists.
HELD = 1 << 21
_LISTS = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("nos", pa.list_(pa.int32()))])


def _codes(texts: Sequence[str | None]) -> np.ndarray:
    """Different runs of GRAM characters of the texts, each run as a number of 21 bits a character."""
    found = []
    for text in texts:
        if text is not None and len(text) >= GRAM:
            letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            found.append(letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _listed(block: int, codes: list[np.ndarray], nos: list[int]) -> pa.RecordBatch:
    """The lists of the codes of some items of a block."""
    every, owner = np.concatenate(codes), np.repeat(np.array(nos, np.int32), [len(c) for c in codes])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    own = every[starts]
    letters = np.stack([own >> 42, own >> 21 & 0x1FFFFF, own & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    grams = pa.array([letters[i : i + GRAM] for i in range(0, len(letters), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(every)), pa.int32()), pa.array(owner))
    return pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(own), block), pa.int64()), lists], schema=_LISTS)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block, no and texts in lower case to lists; those of a block may come in parts."""
    block, codes, nos, held = None, [], [], 0
    for batch in batches:
        for at, no, *texts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and (at != block or held >= HELD):
                yield _listed(block, codes, nos)
                codes, nos, held = [], [], 0
            own, block = _codes(texts), at
            if len(own):
                codes.append(own)
                nos.append(no)
                held += len(own)
    if held:
        yield _listed(block, codes, nos)


def build(items: DataFrame, columns: Sequence[str] = ("title", "content")) -> tuple[DataFrame, DataFrame]:
    """The items, written with `block` and `no`, and the posting lists `gram, block, n, nos`, written in the order of grams.

    Numbers of a partition's rows make its blocks. A gram lies within one column; which one the lists do not tell.
    """
    number = F.monotonically_increasing_id()
    numbered = items.withColumn("_id", number).withColumn("block", F.floor(F.col("_id") / BLOCK).cast("bigint"))
    saved = stored(numbered.withColumn("no", (F.col("_id") % BLOCK).cast("int")).drop("_id"), "search-items")
    # a task makes the lists of what it reads; only parts of lists are shuffled, not a row for each gram of each item
    parts = saved.select("block", "no", *[F.lower(c).alias(f"text_{k}") for k, c in enumerate(columns)]).mapInArrow(_lists, "gram string, block long, nos array<int>")
    lists = parts.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nos")))).alias("nos"))
    ordered = lists.select("gram", "block", F.size("nos").alias("n"), "nos").sortWithinPartitions("gram", "block")
    return saved, stored(ordered, "search-lists")


def search(saved: DataFrame, lists: DataFrame, words: Sequence[str], columns: Sequence[str] = ("title", "content")) -> DataFrame:
    """For each of the texts looked for, with `word`, the items that contain it, whatever its case, in one of the columns.

    Texts of fewer than GRAM characters are found by a scan. The texts are few; what they are is known to the driver, and so are the
    total lengths of their grams' lists.
    """
    spark = saved.sparkSession
    grams = {w: sorted({w.lower()[i : i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in dict.fromkeys(words)}
    every = sorted({g for own in grams.values() for g in own})
    totals = {r.gram: r.n for r in lists.where(F.col("gram").isin(every)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    # a gram that no list has: nothing contains the text
    chosen = {w: sorted(own, key=lambda g: (totals[g], g))[:RAREST] for w, own in grams.items() if own and all(g in totals for g in own)}
    short = [w for w, own in grams.items() if not own]
    found = None
    if chosen:
        wanted = spark.createDataFrame([(w, g, len(own)) for w, own in chosen.items() for g in own], "word string, gram string, n_grams int")
        read = lists.where(F.col("gram").isin(sorted({g for own in chosen.values() for g in own}))).join(F.broadcast(wanted), "gram")
        met = read.groupBy("word", "block").agg(F.collect_list("nos").alias("all"), F.first("n_grams").alias("n_grams")).where("size(all) = n_grams")
        both = F.aggregate(F.slice("all", 2, RAREST), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        candidates = met.select("word", "block", F.explode(both).alias("no"))
        found = _confirmed(saved.join(candidates, ["block", "no"]), columns)
    if short:
        scanned = saved.withColumn("word", F.explode(F.lit(short)))
        found = _confirmed(scanned, columns) if found is None else found.unionByName(_confirmed(scanned, columns))
    if found is None:
        found = saved.where(F.lit(False)).withColumn("word", F.lit(""))
    return found.drop("block", "no")


def _confirmed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    there = F.lit(False)
    for column in columns:
        there = there | F.coalesce(F.contains(F.lower(column), F.lower("word")), F.lit(False))
    return rows.where(there)


def search_all(views: dict[tuple[str, str], DataFrame], words: Sequence[str]) -> DataFrame:
    """content.search_all for several texts at once, by an index of each view: word, id, title, type, subtype, and the site
    first when all views tell it."""
    found, keys = None, ["domain"] if all("domain" in v.columns for v in views.values()) else []
    for (kind, subtype), items in views.items():
        label = next(c for c in ("title", "name") if c in items.columns)
        columns = [label] + [c for c in ("content",) if c in items.columns]
        hits = search(*build(items.select(*keys, "id", *columns), columns), words, columns).select(
            *keys, "word", "id", F.col(label).alias("title"), F.lit(kind).alias("type"), F.lit(subtype).alias("subtype")
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("no views")
    return found
