"""Operators of the llm folder on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sitequarry.llm import exact_dedup, line_dedup, mixing, near_dedup, neighbours, pieces, quality, suffix_dedup, token_records, warc
from sitequarry.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    dice = random.Random(seed)
    return " ".join(dice.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau"]) + str(dice.randint(0, 40)) for _ in range(n))


LONG = prose(1, 3000)
TEXTS = [
    None, "", "  \n", "one two", "one two", LONG, LONG, LONG + " end", LONG.replace("alpha1 ", "x ", 3), prose(2, 60), prose(2, 60) + " more", prose(3, 8),
    "a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc", "Été " * 30, "\U00010348" * 70, "z" * 400, prose(4, 40) + prose(2, 30),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "k", "d") for i, t in enumerate(TEXTS)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"
    return spark.createDataFrame(rows, kinds).repartition(3)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_exact_copies(spark, docs):
    got = by_id(exact_dedup.exact_dedup(docs))
    same = {}
    for i, t in enumerate(TEXTS):
        same.setdefault(t or "", []).append(i)
    for i, t in enumerate(TEXTS):
        group = same[t or ""]
        want = (max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want
    assert got == by_id(exact_dedup.exact_dedup(docs, winners=1, counters=2))
    assert exact_dedup.without_copies(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_lines(spark, docs):
    got = by_id(line_dedup.line_dedup(docs))
    assert got[13].kept_text == "x\ny" and got[14].kept_text == "" and got[12].n_removed == 0 and got[0].n_lines == 1
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\r\nx", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.archived(pages, folder=str(tmp_path)).collect()}
    assert len(got) == 7 and got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload is None
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert i == 1 or (got[i].record_type == "response" and bytes(got[i].payload) == raw and got[i].refers_to is None)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archive_with_dictionary(tmp_path):
    records = [warc.record(i, "u", (prose(i, 200)).encode(), len(prose(i, 200)), hashlib.sha1(prose(i, 200).encode()).hexdigest(), None) for i in range(300)]
    with open(tmp_path / "a", "wb") as out:
        assert warc.write_archive(out, iter(records)) == 300
    raw = (tmp_path / "a").read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    with open(tmp_path / "a", "rb") as source:
        assert list(warc.read_archive(source, step=1000)) == records
    assert warc.parse(records[3])["page_id"] == 3
    for bad in (records[3][:-1], records[3].replace(b"Content-Length: ", b"Content-Length: 1"), records[3].replace(b"alpha", b"alphb", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    (tmp_path / "a").write_bytes(raw[:-5])
    with open(tmp_path / "a", "rb") as source, pytest.raises(ValueError):
        list(warc.read_archive(source))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (70, 50), (80, 80)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 60: 50, 70: 50}


@pytest.mark.parametrize("block", [256, 2])
def test_near_copies(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCUMENTS", block)
    got = by_id(near_dedup.near_components(docs))
    sets = [set(near_dedup.shingles(t).tolist()) for t in TEXTS]
    name = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), name[i], name[i] == i) for i in range(len(TEXTS))}
    assert near_dedup.near_components(docs.limit(0)).count() == 0


def test_circulant_signature():
    own = np.arange(1, 400, dtype=np.uint64) * np.uint64(7919)
    places = (near_dedup.mixed64(own + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    want = [int(near_dedup.second(places - np.uint32(k)).min()) for k in range(1, 151)]
    assert near_dedup.signature(own, block=64).tolist() == want


def test_token_records(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    files = token_records.write_records(docs, WORDS, 2, str(tmp_path))
    for seed in (None, 3):
        got, start = by_id(token_records.read_records(files, seed)), 0
        for i, t in enumerate(TEXTS):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids)
            assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    some = files.where("n_docs > 0").first()
    raw = bytearray(open(some.file, "rb").read())
    raw[20] ^= 1
    open(some.file, "wb").write(raw)
    with pytest.raises(Exception, match="bad record"):
        token_records.read_records(files).collect()
    assert token_records.token_records(docs.limit(0), WORDS).count() == 0


def test_checksums_and_unusual_letters():
    assert token_records.crc32c([b"123456789", b"", b"abc" * 1000])[0] == 0xE3069283
    memory = token_records.Tokens(WORDS)
    texts = ["It's DON'T <|endoftext|> x", "Σας ΟΔΟΣ", "İI ǅ é", "\x1c a\x85b\xa0c", "½ ² ª_ __", "", " \n"]
    want = [np.array(e.ids, memory.kind).tobytes() for e in memory.whole.encode_batch(texts, add_special_tokens=False)]
    assert memory.many(texts) == want


def test_mixing(spark, docs):
    rows = mixing.mix_plan(docs).collect()
    words = [len((t or "").encode().split()) for t in TEXTS]
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-9
    assert Counter(map(tuple, (r[:5] for r in rows))) == Counter(map(tuple, (r[:5] for r in mixing.mix_plan(docs.repartition(2)).collect())))
    taken = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert {r.doc_id: len(r.shards) for r in rows if len(r.shards)} == dict(taken) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_splitting_tree_keeps_counts(spark):
    quotas = {0: 37, 1: 0, 2: 5, 3: 120}
    ends = {r["rank"]: r.ends for r in mixing.split_tree(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), 3, 9).collect()}
    counts = {k: np.diff([0, *v]) for k, v in ends.items()}
    assert {k: int(c.sum()) for k, c in counts.items()} == quotas and all((c >= 0).all() for c in counts.values())
    shard = sum(counts.values())
    assert shard.max() - shard.min() <= 1


def test_pieces(spark, docs, monkeypatch):
    vocabulary = pieces.Pieces(PIECES)
    score = lambda ids: sum(vocabulary.score[vocabulary.text[i]] for i in ids if i in vocabulary.text)
    plain = by_id(pieces.decoded(pieces.encoded(docs, PIECES), PIECES))
    monkeypatch.setattr(pieces, "CHUNK", 37)
    monkeypatch.setattr(pieces, "FAN", 3)
    cut = by_id(pieces.decoded(pieces.encoded(docs.where("n_chars < 3000"), PIECES), PIECES))
    for i, t in enumerate(TEXTS):
        assert plain[i].text == (t or "")
        if i in cut:
            ids = [np.frombuffer(x[i].ids, "<i4").tolist() for x in (plain, cut)]
            assert cut[i].text == (t or "") and score(ids[0]) == score(ids[1])
    assert pieces.encoded(docs.limit(0), PIECES).count() == 0


def test_repeated_bytes(spark, docs, monkeypatch):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    seen: dict[bytes, int] = {}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if seen.setdefault(raw[a : a + 50], i) < i:
                gone[a : a + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), spans, kept), i
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_classes_of_equal_strings(limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", limit)
    dice = random.Random(4)
    segments = [bytes(dice.choice(b"ab\0") for _ in range(dice.randint(50, 90))) for _ in range(20)]
    segments += [segments[0] + b"b", b"a" + segments[1], segments[2]]
    holder = np.arange(len(segments))
    got = suffix_dedup.covered_windows(segments, holder)
    for i, s in enumerate(segments):
        want = [any(s[a : a + 50] in t for t in segments[:i]) for a in range(len(s) - 49)]
        assert got[i].tolist() == want


def test_quality(spark):
    good = [(i, prose(i, 80), 1) for i in range(0, 120)]
    bad = [(i, f"BUY{i}!!! NOW!!! " * 20, 0) for i in range(200, 320)]
    rows = good + bad + [(400, None, None), (401, "", None), (402, LONG, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_scores(docs, labels))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(i, q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out and got[i].predicted == q for i, q in held)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.limit(0)).collect())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_neighbours(spark):
    dice = np.random.default_rng(2)
    rows = [(i, dice.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)] + [(400, rows[7][1]), (500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (600, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    live = {i: np.array(v, np.float32).astype(float) for i, v in rows if i < 500}
    assert set(got) == {0, 100, 200, 300, 400}
    hits = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((live[i] - live[q]) ** 2).sum())), i) for i in live if i != q)[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(abs(s - float(np.sqrt(((live[i] - live[q]) ** 2).sum()))) < 1e-12 for _, s, i in found)
        hits += len({i for _, i in want} & {i for _, _, i in found})
    assert hits >= 45 and [i for _, _, i in sorted(got[400])] == [7, *range(300, 309)]
    assert neighbours.neighbours(frame.limit(0)).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    texts = Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect())
    assert Counter(r.text_sha256 for r in last) == texts
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in last)


def test_words_learned_together():
    one, all_ = pieces.Pieces(PIECES), pieces.Pieces(PIECES, words=300)
    dice = random.Random(8)
    letters = "abcdeénstrioΣ語\U00010348'1▁"
    words = ["▁" + "".join(dice.choice(letters) for _ in range(1 + i % 23)) for i in range(1500)] + ["", "▁▁▁", "z" * 700]
    texts = ["".join(words[a : a + 60]) for a in range(0, len(words), 60)]
    want = [b"".join(np.array(one.ids_of(r, one.best(r)[0]), "<i4").tobytes() for r in one.runs(t)) for t in texts]
    assert all_.encode_all(texts) == want and [all_.encode(t).tobytes() for t in texts] == want


def test_pieces_are_those_of_the_model(spark, docs, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["▁", " ", "a ", "\0a  b", "<s> é\U00010348", "x" * 300, "▁a▁▁b" * 40, "語é" * 90, "aa\n\n\n\tb" * 30]
    rows = given.unionByName(docs.selectExpr("doc_id - 1000 AS doc_id", "text")).unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for chunk, fan in ((pieces.CHUNK, pieces.FAN), (37, 3)):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        monkeypatch.setattr(pieces, "FAN", fan)
        got = by_id(pieces.encoded(rows, PIECES))
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            assert np.frombuffer(got[i].ids, "<i4").tolist() == model.encode(t), (chunk, i)


def test_near_stage_drops_pairs_from_80_percent(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for a in range(40):
        own = [f"{a}{w}" for w in words]
        other = own[:178] + [f"x{w}" for w in own[178:]]  # 174 of 218 shingles in common: 0.798
        near = own[:180] + [f"y{w}" for w in own[180:]]  # 176 of 216: 0.815
        texts |= {3 * a: " ".join(own), 3 * a + 1: " ".join(near), 3 * a + 2: " ".join(other)}
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t in texts.items()}
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 80 <= alike(0, 1) < 85 and alike(0, 2) < 80 and alike(1, 2) < 80
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {i for i in texts if i % 3 != 1}
    assert {r.doc_id for r in near_dedup.near_components(docs).where("kept").collect()} == set(texts)
    assert near_dedup.rows_of(85) == 6 and near_dedup.rows_of(80) == 5


@pytest.mark.parametrize("n", [1, 5, 40])
def test_neighbours_of_few_points(spark, monkeypatch, n):
    dice = np.random.default_rng(n)
    points = [dice.normal(size=8).astype(np.float32).tolist() for _ in range(n)]
    rows = [(100 * i + j, p) for i, p in enumerate(points) for j in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    nodes, _ = neighbours.points(frame, 11)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        edges = neighbours.first_guess(nodes, 8, tables=4, block=256, seed=5).select("node", "other").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    degrees = Counter(r.node for r in edges)
    assert len(edges) == len(set(edges)) and all(r.node != r.other for r in edges)
    assert degrees == Counter({100 * i: min(n - 1, neighbours.DEGREE) for i in range(n) if n > 1})
    monkeypatch.setattr(neighbours, "let_go", lambda spark: None)
    got = {}
    for r in neighbours.neighbours(frame, rounds=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    live = {i: np.array(v) for i, v in rows}
    for q in range(0, 100 * n, 100):
        want = sorted((float(np.sqrt(((live[i] - live[q]) ** 2).sum())), i) for i in live if i != q)[:10]
        assert sorted(got[q]) == [(k, i) for k, (_, i) in enumerate(want, 1)]


def test_best_names_an_other_once(spark):
    edges = spark.createDataFrame([(1, j, j + e) for j in range(2, 40) for e in (0.0, 1e-12, 2e-12)], "node long, other long, distance double")
    assert sorted((r.other, r.distance) for r in neighbours.best(edges).collect()) == [(j, float(j)) for j in range(2, 22)]


def test_scan_over_cuts_anywhere():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Pieces(PIECES)
    dice = random.Random(5)
    odd = ["z" * 500, "ab" * 200, "aaa bbb" * 30, "語é" * 150, "\U00010348" * 90, "▁a▁▁b" * 40, " " * 300, "x\n\n\ty" * 60, "1234567890" * 40, "\0<s></s>" * 30, "the" * 200, "ing" * 200, "l" * 301,
           "".join(dice.choice("abcdeénstrio ΣA1") for _ in range(900)), "".join(dice.choice("aeint") for _ in range(900)), "q"]
    for text in odd:
        for least in (1, 2, 5, 16, 37, 4000):
            whole, reach = pieces.prepared(text), own.longest
            parts = [(whole[max(0, a - reach) : a], whole[a : a + least], whole[a + least : a + least + reach]) for a in range(0, len(whole), least)]
            states = pieces.states_of([own.transfer(*p) for p in parts])
            ids = b""
            for (_, body, after), (_, skip), (_, more) in zip(parts, states[:-1], states[1:], strict=True):
                ids += own.encode_all([body[skip:] + after[max(0, skip - len(body)) : more]])[0]
            assert np.frombuffer(ids, "<i4").tolist() == model.encode(text), (text[:20], least)


def test_products_of_transfers():
    dice = np.random.default_rng(4)
    a, b, c = (np.where(dice.random((4, 4)) < 0.4, 0.0, -np.inf) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()
    assert pieces.states_of([([(0, 0)], {(1, 0): 1}), ([(2, 0)], {(1, 0): 1})]) is None
