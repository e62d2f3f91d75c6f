"""Every operator and stage on rows that repeat a doc_id (with equal and with other texts), rows without one, and clashing columns."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitequarry.llm import exact_dedup, line_dedup, mixing, near_dedup, neighbours, pieces, quality, suffix_dedup, token_records, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
dice = random.Random(11)


def prose(n):
    return " ".join(dice.choice(["alpha", "beta", "gamma", "delta"]) + str(dice.randint(0, 60)) for _ in range(n))


A, B = prose(40), prose(90)
ROWS = [
    (1, A), (2, B), (2, B), (2, A + " x"), (3, "short"), (3, B + "\nk\nl\nm\nn"), (4, "k\nl\nm\nn"), (4, "z"), (4, None), (5, A), (None, A), (None, None), (None, "k\nl\nm\nn"),
    (6, prose(12)), (6, prose(12)), (7, "y" * 60), (7, "y" * 60), (8, "y" * 61), (8, "nothing else"), (9, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{len(t or '') % 2}", len(t or ""), "a", 1, 2.0, [3], "b") for i, t in ROWS]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, score double, block array<int>, draw string"
    return spark.createDataFrame(rows, kinds).repartition(3)


def key(i):
    return (i is not None, i or 0)


def test_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10) for _ in (0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_lines(spark, docs):
    got = Counter((r.doc_id, r.n_lines, r.kept_text) for r in line_dedup.line_dedup(docs).collect())
    marks = {t: m for t, m in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    own = sorted({(key(i), marks[t or ""], i, t or "") for i, t in ROWS})
    seen, kept = set(), {}
    for _, _, i, t in own:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        kept[i, t] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert got == Counter((i, len((t or "").split("\n")), kept[i, t or ""]) for i, t in ROWS)


def test_archives(spark):
    big = "<p>" + "v" * 1200
    rows = [(1, "u", big), (1, "u", big), (2, "u", big), (2, "w", "small"), (None, "u", big), (None, None, None), (2, "u", big)]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter({(1, 1203, "revisit", 2): 2, (2, 1203, "response", None): 2, (2, 5, "response", None): 1, (None, 1203, "revisit", 2): 1, (None, 0, "response", None): 1})


def hand_made(kind, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    page = b"<p>" + b"page " * 50
    told = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + page
    records = [
        hand_made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        hand_made("response", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {told}", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"),
        hand_made("response", page),
        hand_made("revisit", b"", "WARC-Refers-To: <urn:uuid:0>", f"WARC-Payload-Digest: {told}"),
    ]
    words = b" ".join(records) * 3
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    # the dictionary as it is, not compressed
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE, len(words)) + words + b"".join(map(pack.compress, records)))
    got = warc.read_warc(spark.createDataFrame([(str(tmp_path / "a.warc.zst"),)], "file string").select(F.concat(F.lit("file://"), "file").alias("file"))).collect()
    assert [(r.record_type, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in got] == [
        ("response", len(page), hashlib.sha1(page).hexdigest(), page), ("response", len(page), hashlib.sha1(page).hexdigest(), page), ("revisit", None, hashlib.sha1(page).hexdigest(), None),
    ]
    own = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    for bad in (own.replace(b"WARC-Date", b"X-Date"), own.replace(b"abc\r", b"abd\r"), hand_made("revisit", b""), hand_made("response", page, "A: 1", "A: 2")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_near_copies(docs):
    got = near_dedup.near_components(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    of = {r.doc_id: r.component_id for r in got if r.doc_id}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9}  # 2 holds A and B, 3 B and 5 A
    assert sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0, 1, 4]
    assert near_dedup.without_near_copies(docs).columns == docs.columns


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<i4").tolist())) for r in pieces.encoded(docs, PIECES).collect())
    assert got == Counter((i, tuple(model.encode(t or ""))) for i, t in ROWS)


def test_exact_copies(docs):
    same = {}
    for i, t in ROWS:
        same.setdefault(t or "", []).append(i)
    best = {t: max((i for i in own if i is not None), default=None) for t, own in same.items()}
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == Counter((i, best[t or ""], len(same[t or ""]), i == best[t or ""]) for i, t in ROWS)
    assert exact_dedup.without_copies(docs).columns == docs.columns


def test_token_records(docs):
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    marks = {t: m if m is not None else 42 for t, m in docs.select("text", F.xxhash64("text")).collect()}
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (key(r[0]), marks[r[1]], r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for frame in (docs, docs.repartition(5)):
        got = token_records.token_records(frame, WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_tokens_of_other_files(tmp_path):
    import json

    parts = json.loads(open(WORDS).read())
    parts["normalizer"]["normalizers"].pop()  # keeps upper case
    (tmp_path / "t.json").write_text(json.dumps(parts))
    own, whole = token_records.Tokens(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["Upper Case", "don't", "", "\n"]
    assert own.model is None and own.many(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, own.kind).tobytes() for t in texts]
    small = token_records.Tokens(WORDS, words=3)
    big = token_records.Tokens(WORDS)
    for batch in (["a b c d e"], ["a b f"], ["c g h i"], ["a b c d e f"]):
        assert small.many(batch) == big.many(batch)


def test_mix(docs):
    plan = mixing.mix_plan(docs).collect()
    assert Counter(r.doc_id for r in plan) == Counter(i for i, _ in ROWS)
    copies = Counter()
    for r in plan:
        copies[r.doc_id, r.size] += len(r.shards)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows.collect()) == +copies


@pytest.mark.parametrize("seed", range(2))
def test_sources_come_near_their_targets(spark, seed):
    dice = random.Random(seed)
    texts = [("big", "w " * 150_000)] + [("big", "w " * dice.randint(1, 400)) for _ in range(500)] + [(s, "w " * dice.randint(1, 900)) for s in ("a", "b", None) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, weights=(3, 2, 1), share=0.9, seed=seed).collect()
    sources = dict(enumerate(s for s, _ in texts))
    for source in {s for s, _ in texts}:
        own = [r for r in plan if sources[r.doc_id] == source]
        target, taken = own[0].target, sum(r.taken for r in own)
        left = min((r["size"] for r in own if r.taken < 2 * r["size"]), default=0)
        assert abs(taken - target) <= max(0.001 * target, left), (source, target, taken)
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)


def test_repeated_bytes(docs):
    seen = {}
    for i, t in ROWS:
        raw = (t or "").encode()
        if i is not None:
            for a in range(len(raw) - 49):
                seen[raw[a : a + 50]] = min(seen.get(raw[a : a + 50], i), i)
    want = Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49 if i is not None else 0):
            if seen[raw[a : a + 50]] < i:
                gone[a : a + 50] = True
        want[i, len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == want


def test_neighbours_of_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(0, [1.0] * 6), (0, [1.0] * 6), (100, [1.0, 2.0]), (41, []), (42, [1.0] * 7), (None, [1.0] * 6)]
    got = neighbours.neighbours(spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string")).collect()
    assert {r.query_id for r in got} == {0} and {r.vec_id for r in got} <= set(range(40))


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (plain, plain.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == plain.columns, name
            assert {(r.doc_id, r.text) for r in out.collect()} <= set(ROWS), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
