"""Removal of byte strings that repeat across documents, by interval expansion on Burrows-Wheeler transforms.

A string of LENGTH bytes has an anchor: of its GRAM-byte substrings that with the smallest hash (the first of
equals). Equal strings have equal anchors at equal places, so strings are dealt to tasks by anchor and all
occurrences of a string meet. Neighbouring strings with one anchor travel together as a segment.

Everything moves as packed rows of numpy arrays, addressed to a bucket of anchors or to a group of documents:

1. Each batch of texts sends the anchors of its documents to the anchors' buckets.
2. A bucket tells each group of documents which of its anchors occur in two documents or more.
3. A group cuts the segments of those anchors and sends each different one once, with its smallest doc_id; other documents of the
   group that hold it know already that they have to drop it.
4. A bucket settles segments that are equal as a whole, keeping one. It sorts the suffixes of those that differ, expands intervals on
   their Burrows-Wheeler transform until all common prefixes under LENGTH are known, and so has the classes of
   equal strings. It tells groups which are covered.
5. A group merges the covered ranges of its documents and cuts them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import let_go, saved, sliced, text_bytes

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of text of a group of documents and of a bucket of anchors. Their numbers grow with the corpus.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Suffixes that are sorted at a time, and bytes of text whose anchors are found at a time.
SUFFIXES, PART = 1 << 17, 1 << 18
PACKED = "to_group boolean, key int, kind int, blob binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie in `data` one behind the other: every run of strings that share an anchor, in order.

    Number of the text, hash of the anchor, first and last start in the text, and the anchor's distance from the first start.
    """
    n = len(data) - GRAM + 1
    strings = np.maximum(sizes - LENGTH + 1, 0)
    if not strings.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    power = data.astype(np.uint64) + np.uint64(1)
    # hashes of 1, 2, 4, … bytes, doubled by shifting and adding
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        power = power[:-step] * np.uint64(factor) + power[step:]
        step, factor = step * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
    h = mixed(power)
    # half of the hash and the place behind it: the smallest is the first of those with the smallest half
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[WINDOW - width : n - width + 1])
    hit = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    edge = np.zeros(len(hit) + 1, bool)
    edge[1:-1] = hit[1:] != hit[:-1]
    some = strings > 0
    edge[starts[some]] = edge[starts[some] + strings[some]] = True
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(hit)) - 1
    text = np.searchsorted(ends, first, side="right")
    real = first - starts[text] < strings[text]  # others cross the end of a text
    first, last, text = first[real], last[real], text[real]
    return text, h[hit[first]], first - starts[text], last - starts[text], hit[first] - first


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of all texts, in parts that fit a processor's cache; a longer text is a part of its own."""
    a, sizes = 0, np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, side="right")))
        text, *rest = runs(sizes[a:b], np.frombuffer(b"".join(texts[a:b]), np.uint8))
        yield text + a, *rest
        a = b


def pack(*arrays: np.ndarray | bytes) -> bytes:
    blobs = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(blobs), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(blob, np.int64, n, 8))])
    return [np.frombuffer(blob[a:b], k) for a, b, k in zip(ends[:-1], ends[1:], kinds, strict=True)]


def dealt(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Indices by key, for the keys that occur."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else order
    return [(int(keys[order[a]]), order[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int64)


def packed_texts(docs: DataFrame, groups: int) -> DataFrame:
    """Rows of kind 0 to the groups: ids, lengths and compressed texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out = [
                (True, g, 0, pack(ids[own], np.array([len(texts[i]) for i in own], np.int64), squeeze.compress(b"".join(texts[i] for i in own))))
                for g, own in dealt(group_of(ids, groups))
            ]
            yield rows(out)
            del texts, out

    return docs.mapInArrow(each, PACKED)


def rows(out: list[tuple[bool, int, int, bytes]]) -> pa.RecordBatch:
    to, key, kind, blob = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(to, pa.bool_()), pa.array(key, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
        names=["to_group", "key", "kind", "blob"],
    )


def documents_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, turns and texts of a group's documents. Rows of one id with other texts have turns from 0, by text; equal rows share one."""
    ids, texts = [], []
    for blob in blobs:
        own, sizes, data = unpack(blob, np.int64, np.int64, np.uint8)
        data = zstandard.ZstdDecompressor().decompress(data.tobytes(), max_output_size=int(sizes.sum()) + 1)
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        ids.append(own)
        texts.extend(data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], texts[i])))
    ids, texts = ids[order], [texts[i] for i in order.tolist()]
    turns = np.zeros(len(ids), np.int64)
    for i in (np.flatnonzero(np.diff(ids) == 0) + 1).tolist():
        turns[i] = turns[i - 1] + (texts[i] != texts[i - 1])
    return ids, turns, texts


def sent_anchors(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Step 1: rows to the buckets with the different anchors of each document of a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found = list(runs_of([(t or "").encode() for t in batch.column("text").to_pylist()]))
            owner, h = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            order = np.lexsort((owner, h))
            owner, h = owner[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
            owner, h = owner[new], h[new]
            small = np.uint16 if len(ids) <= 1 << 16 else np.uint32
            yield rows([(False, b, 1, pack(ids, h[own], owner[own].astype(small), np.array([small().itemsize]))) for b, own in dealt((h % np.uint64(buckets)).astype(np.int64))])

    return docs.mapInArrow(each, PACKED)


def shared_anchors(key: tuple, blobs: list[bytes], groups: int) -> list[tuple[bool, int, int, bytes]]:
    """Step 2: which anchors of this bucket two documents have, told to the groups of those documents."""
    hashes, owners = [], []
    for blob in blobs:
        ids, h, owner, width = unpack(blob, np.int64, np.uint64, np.uint8, np.int64)
        hashes.append(h)
        owners.append(ids[owner.view(np.uint16 if width[0] == 2 else np.uint32)])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    differ = np.maximum.reduceat(owner, begin) != np.minimum.reduceat(owner, begin)
    keep = np.repeat(differ, np.diff(np.append(begin, len(h))))
    h, group = h[keep], group_of(owner[keep], groups)
    return [(True, g, 1, pack(np.unique(h[own]))) for g, own in dealt(group)]


def cut_segments(blobs: dict[int, list[bytes]], buckets: int, group: int) -> Iterator[tuple[bool, int, int, bytes]]:
    """Step 3: each different segment of a shared anchor once, to its bucket; what the group itself knows to be covered."""
    ids, turns, texts = documents_of(blobs[0])
    wanted = np.unique(np.concatenate([unpack(b, np.uint64)[0] for b in blobs.get(1, [])] or [np.zeros(0, np.uint64)]))
    if not len(wanted):
        return
    seen: dict[bytes, int] = {}
    cover: list[tuple[int, int, int, int]] = []
    out: dict[int, list[tuple[bytes, int, int, int, int, int]]] = {}
    ids_, turns_ = ids.tolist(), turns.tolist()
    for found in runs_of(texts):
        shared = wanted[np.minimum(np.searchsorted(wanted, found[1]), len(wanted) - 1)] == found[1]
        for i, h, a, b, at in zip(*(f[shared].tolist() for f in found), strict=True):
            segment, doc = texts[i][a : b + LENGTH], ids_[i]
            if seen.setdefault(segment, doc) != doc:
                cover.append((doc, turns_[i], a, b + LENGTH))
            else:  # documents come in ascending order: this is the group's smallest
                out.setdefault(h % buckets, []).append((segment, h, doc, turns_[i], a, at))
    if cover:
        yield True, group, 2, pack(np.array(cover, np.int64))
    for bucket, some in out.items():
        segment, h, doc, turn, first, at = zip(*some, strict=True)
        sizes = np.array([len(x) for x in segment], np.int64)
        inner = pack(np.array(h, np.uint64), np.array(doc, np.int64), np.array(turn, np.int32), np.array(first, np.int32), np.array(at, np.int8), b"".join(segment))
        yield False, bucket, 2, pack(np.array([group], np.int64), sizes.astype(np.int16), zstandard.compress(inner, 3), np.array([len(inner)]))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` (symbols from 0, zeros behind its end) in the order of their first LENGTH symbols, or more."""
    n = len(text)
    rank, width, fold = text.astype(np.int64), 1, 7
    while width < LENGTH:
        # seven symbols under 512 fit a key, then three ranks under 2**21 do, or two of any
        base = int(rank.max()) + 1
        fold = 7 if width == 1 else 3 if base < 1 << 21 else 2
        key = rank.copy()
        for ahead in range(width, fold * width, width):
            key *= base
            key[: max(0, n - ahead)] += rank[ahead:]
        order = np.argsort(key)
        width *= fold
        if width < LENGTH:
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
    return order


def classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, along it, the number of the class of suffixes with equal first `length` symbols.

    Breadth first: the queue holds the intervals of strings of one length, from the empty string. Extending a string
    to the left by each symbol in its interval of the transform gives intervals one longer; one that ends where
    no common prefix is known yet sets it there, in increasing value, and is expanded in turn. Strings with a
    zero, which ends segments, are not expanded. What is unknown after `length` rounds is at least `length`.
    """
    n = len(text)
    order = suffix_order(text)
    last = text[order - 1]  # the transform; suffix 0 follows the zero at the end
    by_symbol = np.argsort(last, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[by_symbol] = np.arange(n, dtype=np.int32)  # of the suffix one symbol longer
    ordered = last[by_symbol]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = ordered[1:] == ordered[:-1]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        starts = before[at] < np.repeat(low, size)
        ends = after[at] >= np.repeat(high, size)
        real = last[at] > 0
        lows = np.sort(place[at[starts & real]]).astype(np.int64)
        highs = np.sort(place[at[ends & real]]).astype(np.int64) + 1
        # zeros sort before all other symbols: their end is a boundary too, without an interval of its own
        zeros = place[at[ends & ~real]].astype(np.int64) + 1
        known[zeros] = True
        new = ~known[highs]
        known[highs] = True
        low, high = lows[new], highs[new]
    return order, np.cumsum(known[:n])


def covered_windows(segments: list[bytes], holder: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its strings also start in a document with a smaller id than its holder's."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.int16) + 1
    order, number = classes(text, LENGTH)
    of = np.empty(len(text), np.int64)
    of[order] = number
    windows = sizes - LENGTH + 1
    ends = np.cumsum(windows)
    own = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows) + starts[own]
    kind = of[at]
    least = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, holder[own])
    return np.split(least[kind] < holder[own], ends[:-1])


def match_segments(blobs: list[bytes]) -> Iterator[tuple[bool, int, int, bytes]]:
    """Step 4: the covered ranges of a bucket's segments, told to the groups that sent them.

    Strings of different anchors never meet. So an anchor whose segments are left with one document, once equal ones are settled, is
    done, and the others are worked off in parts of whole anchors under SUFFIXES; one that alone has more is taken apart.
    """
    segments: list[bytes] = []
    columns: list[tuple[np.ndarray, ...]] = []
    for blob in blobs:
        group, sizes, inner, size = unpack(blob, np.int64, np.int16, np.uint8, np.int64)
        h, *rest, data = unpack(zstandard.decompress(inner.tobytes(), max_output_size=int(size[0])), np.uint64, np.int64, np.int32, np.int32, np.int8, np.uint8)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        raw = data.tobytes()
        segments.extend(raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
        columns.append((h, *(c.astype(np.int64) for c in rest), np.full(len(h), group[0])))
    h, doc, turn, start, at, group = (np.concatenate(c) for c in zip(*columns, strict=True))
    found: list[np.ndarray] = []

    def covered(i: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Bytes a to b of the segments i are covered."""
        found.append(np.stack([group[i], doc[i], turn[i], start[i] + a, start[i] + b], axis=1))

    def settled(pieces: list[bytes], own: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Which pieces (of the segments own, from a on) stay: of equal ones those of the smallest document; the others are covered whole."""
        docs = doc[own]
        order = np.argsort(docs, kind="stable")
        first: dict[bytes, int] = {}
        of = np.empty(len(own), np.int64)
        for i, d in zip(order.tolist(), docs[order].tolist(), strict=True):
            of[i] = first.setdefault(pieces[i], d)
        gone = np.flatnonzero(of != docs)
        if len(gone):
            covered(own[gone], a[gone], a[gone] + np.array([len(pieces[i]) for i in gone.tolist()]))
        return np.flatnonzero(of == docs)

    def work(pieces: list[bytes], own: np.ndarray, a: np.ndarray) -> None:
        which, begin, end = [], [], []
        for k, hit in enumerate(covered_windows(pieces, doc[own])):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                which.extend([k] * (len(edge) // 2))
                begin.extend(edge[0::2].tolist())
                end.extend(edge[1::2].tolist())
        if which:
            covered(own[which], a[which] + np.array(begin), a[which] + np.array(end) - 1 + LENGTH)

    def apart(own: np.ndarray, low: int, high: int) -> None:
        """Strings of one frequent anchor that begin low to high bytes behind it, by halves of that range until they fit.

        Their pieces overlap by a string at most, and equal pieces are settled in each half; pieces of one string each are settled by that alone.
        """
        size = np.array([len(segments[i]) for i in own.tolist()])
        a, b = np.maximum(at[own] + low, 0), np.minimum(at[own] + high + LENGTH, size)
        some = b - a >= LENGTH
        own, a, b = own[some], a[some], b[some]
        pieces = [segments[i][p:q] for i, p, q in zip(own.tolist(), a.tolist(), b.tolist(), strict=True)]
        left = settled(pieces, own, a)
        pieces, own, a = [pieces[i] for i in left.tolist()], own[left], a[left]
        if low == high or len(np.unique(doc[own])) < 2:
            return
        if sum(map(len, pieces)) <= SUFFIXES:
            work(pieces, own, a)
        else:
            middle = (low + high) // 2
            apart(own, low, middle)
            apart(own, middle + 1, high)

    left = settled(segments, np.arange(len(segments)), np.zeros(len(segments), np.int64))
    left = left[np.argsort(h[left], kind="stable")]
    size = np.array([len(segments[i]) for i in left.tolist()], np.int64)
    change = np.flatnonzero(np.concatenate([[True], h[left][1:] != h[left][:-1]])) if len(left) else left
    docs = doc[left]
    several = np.maximum.reduceat(docs, change) != np.minimum.reduceat(docs, change) if len(left) else change
    weight = np.add.reduceat(size, change) if len(left) else change
    held, held_size = [], 0

    def flush() -> None:
        if held:
            own = np.concatenate(held)
            work([segments[i] for i in own.tolist()], own, np.zeros(len(own), np.int64))

    for a, b, w, more in zip(change.tolist(), [*change[1:].tolist(), len(left)], weight.tolist(), several.tolist(), strict=True):
        if not more:
            continue
        if w > SUFFIXES:
            apart(left[a:b], 1 - WINDOW, 0)
            continue
        if held_size + w > SUFFIXES:
            flush()
            held, held_size = [], 0
        held.append(left[a:b])
        held_size += w
    flush()
    if found:
        table = np.concatenate(found)
        for g, own in dealt(table[:, 0]):
            yield True, g, 2, pack(table[own, 1:])


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the ranges (first, end)."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    begin = np.flatnonzero(new)
    return np.stack([ranges[begin, 0], np.maximum.reduceat(ranges[:, 1], begin)], axis=1)


def remaining(blobs: dict[int, list[bytes]]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """Step 5: doc_id, length, removed runs and remaining bytes of each document of a group."""
    ids, turns, texts = documents_of(blobs[0])
    cover = np.concatenate([unpack(b, np.int64)[0].reshape(-1, 4) for b in blobs.get(2, [])] or [np.zeros((0, 4), np.int64)])
    cover = cover[np.lexsort((cover[:, 1], cover[:, 0]))]
    # documents and cover are in one order: a row's place in the documents, found by its id and then its turn
    place = np.searchsorted(ids, cover[:, 0]) if len(ids) else np.zeros(0, np.int64)
    for k in np.flatnonzero(cover[:, 1] > 0).tolist():
        place[k] += int(np.searchsorted(turns[place[k] : np.searchsorted(ids, cover[k, 0], side="right")], cover[k, 1]))
    edges = np.searchsorted(place, np.arange(len(ids) + 1))
    last = None
    for i, (doc, turn, text) in enumerate(zip(ids.tolist(), turns.tolist(), texts, strict=True)):
        if last is None or last[:2] != (doc, turn):  # equal rows are cut alike
            last = doc, turn, i
        a, b = edges[last[2]], edges[last[2] + 1]
        gone = merged(cover[a:b, 2:]) if b > a else np.zeros((0, 2), np.int64)
        ends = [0, *gone.ravel().tolist(), len(text)]
        yield doc, len(text), gone, b"".join(text[p:q] for p, q in zip(ends[0::2], ends[1::2], strict=True))


def suffix_dedup(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked, spans and kept).

    Each byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id is removed. A null
    text is an empty one. Rows that repeat a doc_id are documents of that id each: they cover nothing of each other, and each
    gets its row. Rows without a doc_id are left whole and cover nothing.
    """
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = text_bytes(own)
    groups, buckets = 1 + total // GROUP_BYTES, 1 + total // BUCKET_BYTES
    texts = packed_texts(own, groups)

    def each_bucket(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(shared_anchors(key, frame["blob"].tolist(), groups), columns=["to_group", "key", "kind", "blob"])

    def each_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blobs = {k: v["blob"].tolist() for k, v in frame.groupby("kind")}
        return pd.DataFrame(cut_segments(blobs, buckets, key[0]), columns=["to_group", "key", "kind", "blob"])

    def each_match(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(match_segments(frame["blob"].tolist()), columns=["to_group", "key", "kind", "blob"])

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>, kept binary"

    def each_rest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blobs = {k: v["blob"].tolist() for k, v in frame.groupby("kind")}
        out = [
            (d, n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [tuple(x) for x in gone.tolist()] if with_spans else None, kept if with_spans else None)
            for d, n, gone, kept in remaining(blobs)
        ]
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    shared = saved(sent_anchors(own, groups, buckets).groupBy("key").applyInPandas(each_bucket, PACKED), "anchors")
    let_go(docs.sparkSession)
    segments = saved(texts.unionByName(shared).groupBy("key").applyInPandas(each_group, PACKED), "segments")
    let_go(docs.sparkSession)
    matched = saved(segments.where("NOT to_group").groupBy("key").applyInPandas(each_match, PACKED), "matches")
    let_go(docs.sparkSession)
    covered = segments.where("to_group").unionByName(matched)
    done = texts.unionByName(covered).groupBy("key").applyInPandas(each_rest, result)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"),
        whole.alias("kept"),
    )
    out = done.unionByName(rest)
    return out if with_spans else out.drop("spans", "kept")
