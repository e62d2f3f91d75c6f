"""SentencePiece encoding and decoding with the ids of the model's own merges.

No piece of the vocabulary goes on to a space behind something else, so merges never cross the border of a word-like run
(spaces and what follows up to the next space): a text's ids are those of its runs, each of which is encoded once and remembered.

Giant texts are cut anywhere, and a max-plus scan tells which piece lies across each cut. Pieces in a row are what the model makes of a text
exactly if every two neighbours are what it makes of their union. With weight 0 for such neighbours and minus infinity for others, a chunk is a
transfer matrix from the pieces that may cover the character before it to those that may cover its last one. The matrices of a
text are multiplied in a tree, the states are picked on the way back down, and each chunk is then encoded by itself between its two states.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import saved, sliced

SPACE = "▁"
#: Characters of a chunk at least, and chunks of a giant text that are handed on together.
CHUNK, FAN = 1 << 16, 64
#: Bytes of texts that are encoded together, and runs that are learned in one call.
TOGETHER, LEARNT = 1 << 20, 1 << 13
#: Appended to a model file, this message turns off the space that the model puts in front of a text.
BARE = b"\x1a\x02\x18\x00"


class Pieces:
    """The vocabulary: ranks of pieces, bytes for characters without a piece."""

    def __init__(self, path: str, words: int = 250_000, pairs: int = 100_000):
        import sentencepiece

        with open(path, "rb") as source:
            model = sentencepiece.SentencePieceProcessor(model_proto=source.read() + BARE)
        #: Encodes prepared texts and runs of them.
        self.model = model
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        # no piece goes on to a space behind something else, so texts fall apart in front of such spaces
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.longest = max(map(len, self.id))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.limit, self.most_pairs = words, pairs

    def best(self, text: str) -> tuple[list[tuple[int, int]], float]:
        """The pieces (start, end) of a short text by the model's rule written out, and their score.

        Of all neighbours whose union is a piece, those of best rank are joined, the leftmost first, until none are left.
        Slow: tests hold what the library gives for runs against it.
        """
        cut = [(i, i + 1) for i in range(len(text))]
        while True:
            ranks = [self.score.get(text[p[0] : q[1]], -np.inf) for p, q in zip(cut[:-1], cut[1:], strict=True)]
            if not ranks or max(ranks) == -np.inf:
                return cut, sum(self.score.get(text[p:q], 0.0) for p, q in cut)
            i = ranks.index(max(ranks))
            cut[i : i + 2] = [(cut[i][0], cut[i + 1][1])]

    def ids_of(self, text: str, cut: list[tuple[int, int]]) -> list[int]:
        out: list[int] = []
        for a, b in cut:
            i = self.id.get(text[a:b])
            out.extend([i] if i is not None else (self.byte[x] for x in text[a:b].encode()))
        return out

    def runs(self, text: str) -> list[str]:
        """The parts of a text between which no piece lies."""
        if not self.apart:
            return [text]
        # a run: spaces and what follows up to the next space
        parts = text.split(SPACE)
        out, spaces = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            spaces += SPACE
            if p:
                out.append(spaces + p)
                spaces = ""
        return out + [spaces] if spaces else out

    def fits(self, a: str, b: str) -> bool:
        """Whether the model makes the two pieces of their union."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.most_pairs:
                self.pairs.clear()
            known = self.pairs[a, b] = self.model.encode(a + b) == self.ids_of(a + b, [(0, len(a)), (len(a), len(a) + len(b))])
        return known

    def across(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that may cover the character before a cut: how far they reach back and ahead."""
        out = []
        for back in range(1, min(self.longest, cut) + 1):
            for ahead in range(min(self.longest - back, len(text) - cut) + 1):
                if back + ahead == 1 or text[cut - back : cut + ahead] in self.id:
                    out.append((back, ahead))
        return out

    def transfer(self, before: str, body: str, after: str) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """States at the begin of a chunk, and for each state at its end the bits of those that lead there.

        `before` and `after` are as much of the text beside it as a piece may reach over. Without anything before there is
        one state, (0, 0). Between the first and the last border of runs in the chunk nothing has to be looked at: any run can follow any other.
        """
        text, begin = before + body + after, len(before)
        end = begin + len(body)
        states = self.across(text, begin) if before else [(0, 0)]
        found: dict[tuple[int, int], int] = {}
        # by the place where pieces end: where they start, and the states that lead there; a start at the end itself asks nothing of what follows
        reach: dict[int, dict[int, int]] = {}
        for i, (back, ahead) in enumerate(states):
            s, e = begin - back, begin + ahead
            if e >= end:
                found[end - s, e - end] = found.get((end - s, e - end), 0) | 1 << i
            else:
                own = reach.setdefault(e, {})
                own[s] = own.get(s, 0) | 1 << i
        border = lambda p: self.apart and p > 0 and text[p] == SPACE and text[p - 1] != SPACE
        p = begin
        while p < end:
            nodes = reach.pop(p, None)
            if nodes and border(p):
                bits = 0
                for b in nodes.values():
                    bits |= b
                last = end - 1
                while last > p and not border(last):
                    last -= 1
                p, nodes = last, {last: bits}
            for e in range(p + 1, min(p + self.longest, len(text)) + 1) if nodes else ():
                piece = text[p:e]
                if e > p + 1 and piece not in self.id:
                    continue
                bits = 0
                for s, b in nodes.items():
                    if s == p or self.fits(text[s:p], piece):
                        bits |= b
                if not bits:
                    continue
                if e >= end:
                    found[end - p, e - end] = found.get((end - p, e - end), 0) | bits
                else:
                    own = reach.setdefault(e, {})
                    own[p] = own.get(p, 0) | bits
            p += 1
        return states, found

    def learn(self, words: list[str]) -> None:
        ids = self.model.encode(words, num_threads=1)
        raw = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        a = 0
        for w, own in zip(words, ids, strict=True):
            b = a + 4 * len(own)
            self.known[w] = raw[a:b]
            a = b

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole prepared texts or chunks; runs that are new in them are learned together."""
        runs = [self.runs(t) for t in texts]
        new = {r for own in runs for r in own if r not in self.known}
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = {r for own in runs for r in own}
        words = list(new)
        for a in range(0, len(words), LEARNT):
            self.learn(words[a : a + LEARNT])
        known = self.known
        return [b"".join([known[r] for r in own]) for own in runs]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole prepared text."""
        return np.frombuffer(self.encode_all([text])[0], "<i4")

    def decode(self, ids: np.ndarray) -> str:
        out, raw = [], bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1:]


_READY: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _READY:
        _READY[path] = Pieces(path)
    return _READY[path]


def prepared(text: str | None) -> str:
    """The model's own preparation: a space in front of a text that is not empty, spaces as a letter."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices of states."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


def states_of(chunks: list[tuple[list, dict]]) -> list[tuple[int, int]] | None:
    """The state at each cut of a text, its begin and end included, out of its chunks' transfers; None if no way leads through.

    Matrices are multiplied in a tree; the way is then found from the root down, each product telling by which state in its middle it came.
    """
    sides = [list(states) for states, _ in chunks] + [sorted(chunks[-1][1])]
    place = [{x: k for k, x in enumerate(side)} for side in sides]
    level = []
    for k, (states, found) in enumerate(chunks):
        m = np.full((len(states), len(sides[k + 1])), -np.inf)
        for x, bits in found.items():
            if x in place[k + 1]:
                m[[i for i in range(len(states)) if bits >> i & 1], place[k + 1][x]] = 0.0
        level.append(m)
    tree = [level]
    while len(level) > 1:
        level = [product(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        tree.append(level)
    ways = np.argwhere(tree[-1][0] == 0)
    if not len(ways):
        return None
    at = [tuple(ways[0])]  # for each matrix of a level the states at its ends
    for below in reversed(tree[:-1]):
        down = []
        for k, (i, j) in enumerate(at):
            if 2 * k + 1 < len(below):
                middle = int((below[2 * k][i] + below[2 * k + 1][:, j]).argmax())
                down += [(i, middle), (middle, j)]
            else:
                down.append((i, j))
        at = down
    return [sides[0][at[0][0]], *(sides[k + 1][j] for k, (_, j) in enumerate(at))]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit integers) of each row of docs: those that the model's library gives.

    Null and empty texts have no ids. Texts up to CHUNK characters are encoded where they are read; only giant ones move,
    as chunks, and meet again by row. A row is told by doc_id and text, so rows that repeat both are
    encoded once for all and appear as often as they occur.
    """
    least, fan = CHUNK, FAN
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text")
    giant = F.coalesce(F.length("text"), F.lit(0)) >= least

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TOGETHER):
            ids = pieces(path).encode_all([prepared(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(path).longest
        for batch in batches:
            for row, value in zip(batch.column("row"), batch.column("text"), strict=True):
                text = prepared(value.as_py())
                places = list(range(0, len(text), least))
                for k in range(0, len(places), fan):
                    some = [(a, min(a + least, len(text))) for a in places[k : k + fan]]
                    yield pa.RecordBatch.from_pydict({
                        "row": [row.as_py()] * len(some), "no": pa.array(range(k, k + len(some)), pa.int32()), "before": [text[max(0, a - reach) : a] for a, _ in some],
                        "body": [text[a:b] for a, b in some], "after": [text[b : b + reach] for _, b in some],
                    })

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(pieces(path).transfer(*x)) for x in zip(*(batch.column(c).to_pylist() for c in ("before", "body", "after")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), pa.array(found, pa.binary())], names=["row", "no", "transfer"])

    def scan(chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("no")
        states = states_of([pickle.loads(x) for x in chunks.column("transfer").to_pylist()])
        if states is None:
            return chunks.slice(0, 0).select(["row", "no"]).append_column("skip", pa.array([], pa.int32())).append_column("more", pa.array([], pa.int32()))
        ahead = pa.array([a for _, a in states], pa.int32())
        return chunks.select(["row", "no"]).append_column("skip", ahead[:-1]).append_column("more", ahead[1:])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*(batch.column(c).to_pylist() for c in ("body", "after", "skip", "more")), strict=True)
            ids = [pieces(path).encode_all([body[skip:] + after[max(0, skip - len(body)) : more]])[0] for body, after, skip, more in parts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), pa.array(ids, pa.binary())], names=["row", "no", "ids"])

    short = own.where(~giant).mapInArrow(small, f"doc_id {kind}, ids binary")
    long = own.where(giant).withColumn("row", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text")).cast("binary"), 256))
    whole = long.groupBy("row").agg(F.first("text").alias("text"))
    chunks = saved(whole.mapInArrow(cut, "row string, no int, before string, body string, after string").repartition("row", "no"), "chunks")
    moved = chunks.mapInArrow(matrices, "row string, no int, transfer binary")
    # a matrix is a few hundred bytes for CHUNK characters of a text that was one value
    states = saved(moved.groupBy("row").applyInArrow(scan, "row string, no int, skip int, more int"), "states")
    coded = chunks.join(states, ["row", "no"]).mapInArrow(each, "row string, no int, ids binary")
    # a document's ids are one value, as its text was
    joined = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    joined = joined.select(F.col("row").alias("_row"), F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
    giants = long.select("doc_id", "row").join(joined, F.col("row") == F.col("_row")).select("doc_id", "ids")
    # no text is known through which no way leads; one would be encoded whole
    rest = long.join(states.select("row").distinct(), "row", "left_anti").select("doc_id", "text").mapInArrow(small, f"doc_id {kind}, ids binary")
    return short.unionByName(giants).unionByName(rest)


def decoded(codes: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, text_sha256 and text: what the ids decode to.

    Decoding gives the text back but for the letter U+2581, which becomes a space as in the library.
    """
    import hashlib

    kind = codes.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                blobs = part.column("ids").to_pylist()
                texts = [pieces(path).decode(np.frombuffer(b, "<i4")) for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32", "text_sha256", "text"],
                )

    fields = f"doc_id {kind}, ids binary, n_tokens long, ids_crc32 long, text_sha256 string, text string"
    return codes.mapInArrow(each, fields)
