"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

A file holds records: length (u64), masked CRC-32C of the length (u32), data, masked CRC-32C of the data (u32), all
little-endian, as TFRecord files do. Data: doc_id (i64), bytes per id (u64), ids. Its index holds for each record doc_id,
offset, length of the data and number of ids (i64 each), so a reader can fetch records in any order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequarry.llm.byte_pairs import letters
from sitequarry.llm.common import commit, parts, place_of, saved, sliced
from sitequarry.session import fresh_dir

ROW = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


TABLE = _byte_table()


def _shifts(levels: int) -> list[np.ndarray]:
    """Per level k, by lane and byte, a checksum register after ROW * 2**k zero bytes."""
    lanes = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(ROW):
        lanes = TABLE[lanes & 0xFF] ^ (lanes >> 8)
    out = [lanes]
    while len(out) < levels:
        out.append(_shifted(out[-1], out[-1]))
    return out


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[0][crc & 0xFF] ^ by[1][(crc >> 8) & 0xFF] ^ by[2][(crc >> 16) & 0xFF] ^ by[3][crc >> 24]


SHIFTS = _shifts(26)


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each blob. Zero bytes in front don't change a register of zero, so blobs are padded there to rows
    whose checksums are taken together and then folded in pairs."""
    out = np.zeros(len(blobs), dtype=np.uint32)
    size = np.array([len(b) for b in blobs], dtype=np.int64)
    need = np.maximum(1, -(-np.maximum(size, 4) // ROW))
    level = np.ceil(np.log2(need)).astype(int)
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k)
        width = ROW << k
        step = max(1, (4 << 20) // width)
        for a in range(0, len(own), step):
            some = own[a : a + step]
            rows = np.zeros((len(some), width), dtype=np.uint8)
            for r, i in enumerate(some.tolist()):
                if len(blobs[i]) >= 4:
                    rows[r, width - len(blobs[i]) :] = np.frombuffer(blobs[i], np.uint8)
                    rows[r, width - len(blobs[i]) : width - len(blobs[i]) + 4] ^= 0xFF
            lanes = np.ascontiguousarray(rows.reshape(-1, ROW).T)
            crc = np.zeros(lanes.shape[1], dtype=np.uint32)
            for lane in lanes:
                crc = TABLE[(crc ^ lane) & 0xFF] ^ (crc >> 8)
            crc = crc.reshape(len(some), -1)
            for by in SHIFTS[:k]:
                crc = _shifted(crc[:, 0::2], by) ^ crc[:, 1::2]
            out[some] = ~crc[:, 0]
    for i in np.flatnonzero(size < 4).tolist():
        crc = 0xFFFFFFFF
        for b in blobs[i]:
            crc = int(TABLE[(crc ^ b) & 0xFF]) ^ (crc >> 8)
        out[i] = crc ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)).astype("<u4")


#: The parts of a tokenizer file that Tokens knows how to run word by word.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class Tokens:
    """Ids of whole texts from a tokenizer of the tokenizers library, as packed little-endian integers.

    If the file has just the parts above, nothing looks across ASCII white space, so words are encoded once and remembered.
    Texts with letters beyond Latin or with control characters, where normal forms or cases may differ, are encoded whole by the library, as are
    all texts if the file has other parts. Words are remembered in two generations: when the first is full it takes the place of
    the second, and words found there move up.
    """

    PLAIN = regex.compile("[\t-\r -~¡-¬®-įı-ɏ]*")

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = regex.compile(SPLIT)
        self.model = self._model(json.loads(Path(path).read_text()))
        self.words: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}
        self.limit = words

    def _model(self, parts: dict):
        """The merges as tiktoken runs them, with a zero byte for the word end; None if the file has other parts."""
        model, split = parts["model"], parts["pre_tokenizer"]
        known = (parts["normalizer"] or {}).get("normalizers") == NORMAL and (split or {}).get("type") == "Sequence" and len(split["pretokenizers"]) == 2
        if not known or model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            return None
        cut, letter = split["pretokenizers"]
        known = cut == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        known = known and letter["type"] == "ByteLevel" and not letter["add_prefix_space"] and not letter["use_regex"]
        if not known or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            return None
        of = letters()
        ranks = {}
        for token, i in model["vocab"].items():
            plain = token.removesuffix(WORD_END)
            if token not in {t["content"] for t in parts["added_tokens"]}:
                ranks[bytes(of[c] for c in plain) + b"\0" * (plain != token)] = i
        ends = [ranks.get(bytes([b, 0])) for b in range(256)]
        join = lambda pair: (pair if isinstance(pair, list) else pair.split(" "))
        merged = [model["vocab"].get("".join(join(m))) for m in model["merges"]]
        # merges must come in the order of their ids, behind the bytes that take the word end
        if None in ends or None in merged or merged != sorted(set(merged)) or max(ends) > merged[0] or len(ranks) != 512 + len(merged):
            return None
        import tiktoken

        self.line = ranks[b"\n"]
        return tiktoken.Encoding("file", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, new: list[bytes]) -> None:
        """All new words in one go: pieces get the word end behind them, and the id of a line end stands between words."""
        marked = self.cut.sub("\\g<0>\0", b"\n".join([*new, b""]).decode().lower())
        ids = np.array(self.model.encode_ordinary(marked), self.kind)
        last = np.flatnonzero(ids == self.line)
        data, size = ids.tobytes(), self.kind.itemsize
        first = [0, *((last[:-1] + 1) * size).tolist()]
        self.words.update((w, data[a:b]) for w, a, b in zip(new, first, (last * size).tolist(), strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        plain = [self.model is not None and self.PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        split = [t.encode().split() if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self.words) > self.limit:
            self.past, self.words = self.words, {}
        new = set(chain.from_iterable(s for s in split if s)).difference(self.words)
        if self.past:
            again = new.intersection(self.past)
            self.words.update((w, self.past[w]) for w in again)
            new -= again
        if new:
            self._learn(list(new))
        word = self.words.__getitem__
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        others = iter([np.array(e.ids, dtype=self.kind).tobytes() for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)])
        return [next(others) if s is None else b"".join(map(word, s)) for s in split]


_READY: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process, so that its memory serves all tasks of the process."""
    if path not in _READY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _READY[path] = Tokens(path)
    return _READY[path]


def write_records(docs: DataFrame, path: str, end: int, folder: str) -> DataFrame:
    """Writes each document's ids with `end` behind them, in ascending doc_id order over the files; their list.

    Returned: part (the order of files), file, index, n_docs, n_tokens, and base, the ids in all files before. Documents are
    dealt by ranges of doc_id before they are encoded, so that ids are made once and never shuffled.
    A null text is an empty one, a null doc_id comes first and is written as the smallest number. Rows that repeat a doc_id come in
    the order of their texts' digests, so that reruns agree; they are dealt by range together with it, so no file starts between them.
    """
    spark = docs.sparkSession
    low = -(1 << 63)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        tail = np.array([end], dtype=encode.kind).tobytes()
        part = TaskContext.get().partitionId()
        index: list[np.ndarray] = []

        def fill(stream) -> None:
            at = 0
            for batch in sliced(batches):
                ids = encode.many(["" if t is None else t for t in batch.column("text").to_pylist()])
                owner = batch.column("doc_id").cast(pa.int64()).fill_null(low).to_numpy()
                head = np.stack([owner, np.full(len(owner), encode.kind.itemsize)], axis=1).astype("<i8")
                data = [h.tobytes() + i + tail for h, i in zip(head, ids, strict=True)]
                length = np.array([len(d) for d in data], dtype="<u8")
                front = [x.tobytes() for x in length]
                first, last = masked(crc32c(front)), masked(crc32c(data))
                stream.write(b"".join(chain.from_iterable(zip(front, (x.tobytes() for x in first), data, (x.tobytes() for x in last), strict=True))))
                ends = at + np.cumsum(length.astype(np.int64) + 16)
                index.append(np.stack([owner, ends - length.astype(np.int64) - 16, length.astype(np.int64), (length.astype(np.int64) - 16) // encode.kind.itemsize], axis=1))
                at = int(ends[-1])

        file = commit(folder, f"part-{part:06d}.records", fill)
        rows = np.concatenate(index).astype("<i8") if index else np.zeros((0, 4), "<i8")
        listed = commit(folder, f"part-{part:06d}.index", lambda stream: stream.write(rows.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([file]), pa.array([listed]), pa.array([len(rows)]), pa.array([int(rows[:, 3].sum())])],
            names=["part", "file", "index", "n_docs", "n_tokens"],
        )

    dealt = docs.select("doc_id", "text").repartitionByRange(parts(spark), "doc_id")
    own = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = saved(own.mapInArrow(write, "part long, file string, index string, n_docs long, n_tokens long"), "record-files")
    # a row per file
    return files.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def records_at(file: str, rows: np.ndarray, step: int = 8 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The data of the records in `rows` of an index, in their order, after checks of lengths and checksums."""
    files, name = place_of(file)
    with files.open_input_file(name) as source:
        a = 0
        while a < len(rows):
            b = a + 1  # neighbours in the file are read together
            while b < len(rows) and rows[b, 1] == rows[b - 1, 1] + rows[b - 1, 2] + 16 and rows[b, 1] + rows[b, 2] - rows[a, 1] < step:
                b += 1
            some = rows[a:b]
            got = source.read_at(int(some[-1, 1] + some[-1, 2] + 16 - some[0, 1]), int(some[0, 1]))
            at = (some[:, 1] - some[0, 1]).tolist()
            front = [got[o : o + 8] for o in at]
            data = [got[o + 12 : o + 12 + n] for o, n in zip(at, some[:, 2].tolist(), strict=True)]
            said = np.frombuffer(b"".join(got[o + 8 : o + 12] + got[o + 12 + n : o + 16 + n] for o, n in zip(at, some[:, 2].tolist(), strict=True)), "<u4")
            lengths = np.frombuffer(b"".join(front), "<u8").astype(np.int64)
            right = (lengths == some[:, 2]) & (said[0::2] == masked(crc32c(front))) & (said[1::2] == masked(crc32c(data)))
            if not right.all():
                raise ValueError(f"{file}: bad record at {int(some[~right][0, 1])}")
            yield some, data
            a = b


def read_records(files: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every record in the files listed; start counts ids before it.

    With a seed the records of each file are fetched through the index in a random order.
    """
    low = -(1 << 63)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = place_of(row["index"])
                with store.open_input_file(name) as source:
                    index = np.frombuffer(source.read(), "<i8").reshape(-1, 4)
                start = row["base"] + np.cumsum(index[:, 3]) - index[:, 3]
                order = np.arange(len(index))
                if shuffle_seed is not None:
                    np.random.default_rng([shuffle_seed, row["part"]]).shuffle(order)
                done = 0
                for some, data in records_at(row["file"], index[order]):
                    kinds = [np.frombuffer(d, "<i8", 2) for d in data]
                    if any(k[0] != s for k, s in zip(kinds, some[:, 0].tolist(), strict=True)):
                        raise ValueError(f"{row['file']}: record and index differ")
                    ids = [np.frombuffer(d, f"<u{int(k[1])}", offset=16).astype("<u4") for d, k in zip(data, kinds, strict=True)]
                    own = order[done : done + len(some)]
                    done += len(some)
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32), flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some[:, 0], mask=some[:, 0] == low), pa.array(start[own]), pa.array(some[:, 3]),
                         pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), lists],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def token_records(docs: DataFrame, path: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the records of `docs` and reads them back; rows as read_records returns them.

    No rows in, no rows out; rows that repeat a doc_id are records of their own, next to each other.
    """
    folder = folder or fresh_dir(docs.sparkSession, "records")
    return read_records(write_records(docs, path, end, folder))
