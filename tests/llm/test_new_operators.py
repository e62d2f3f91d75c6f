"""Packing, whitening and hard negatives against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitequarry.llm import byte_pairs, negatives, packing, queries, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path=BYTES):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "  a", "a  b \n\n c\t", "It's DON'T <|endoftext|>", "x" * 30_000, " " * 30_000 + "y", "\x85\xa0 b", "Σας 語語 \U00010348", "\x1c\x1d a b", "12 345,6!?\r\n"]


def test_ids_are_those_of_the_library(tmp_path):
    ids, fast = library(), byte_pairs.BytePairs(BYTES)
    assert fast.fast is not None
    assert [x.tolist() for x in fast.many(ODD)] == [ids(t) for t in ODD]
    parts = json.loads(open(BYTES).read())
    # the same vocabulary with another split is left to the library
    parts["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(parts))
    other = byte_pairs.BytePairs(str(tmp_path / "other.json"))
    assert other.fast is None and [x.tolist() for x in other.many(ODD)] == [library(str(tmp_path / "other.json"))(t) for t in ODD]


def brute_fit(sizes, size):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(size - s)
    return sorted(rooms)


def test_best_fit_is_best_fit():
    dice = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        sizes = dice.integers(1, 101, n)
        bins, places, fills = packing.best_fit(sizes, 100)
        assert sorted((100 - fills).tolist()) == brute_fit(sizes.tolist(), 100)
        for b in range(len(fills)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(places[own])]
            assert (places[own] == np.cumsum(sizes[own]) - sizes[own]).all() and sizes[own].sum() == fills[b] <= 100


def check_places(places, size):
    by = defaultdict(list)
    for r in places:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("per_group", [4096, 3])
def test_packing(spark, per_group):
    texts = [None, *ODD, "one two " * 3000, "one two " * 3000, *(f"word{i} " * (i * 7 % 90) for i in range(60))]
    rows = [(None if i == 5 else 7 if i in (8, 9, 10, 11) else i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, row int").repartition(3)
    pieces, places = packing.packed(docs, BYTES, size=64, per_group=per_group)
    got, ids = places.collect(), library()
    want = Counter()
    for i, t, *_ in rows:
        own = [*ids(t), 2]
        first = (len(own) - 1) % 64 + 1
        cuts = [0, *range(first, len(own), 64), len(own)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, p, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_places(got, 64)
    least = sum(r.length for r in got) / 64
    assert least <= n <= 1.05 * least + 2
    whole = {r.sequence_id: r for r in packing.sequences(pieces, places).collect()}
    assert len(whole) == n
    for r in got:
        own = np.frombuffer(whole[r.sequence_id].ids, "<u2")
        assert len(own) == whole[r.sequence_id].n_ids and zlib.crc32(own[r.offset : r.offset + r.length].astype("<u4").tobytes()) == r.ids_crc32
    assert packing.packed(docs.limit(0), BYTES)[1].count() == 0


def test_underfull_bins_meet_in_the_tree(spark):
    # groups of a piece or two would need 200 and more sequences by themselves; rounds above fill them, though bins stay whole (100 would do)
    pieces = spark.range(200).selectExpr("id AS row", "0 AS piece", "CASE WHEN id % 2 = 0 THEN 60L ELSE 40L END AS length")
    got = packing.placed(pieces, size=100, per_group=1).collect()
    assert check_places(got, 100) <= 120
    # nothing fits with anything: no group sends more than its share up
    alone = packing.placed(spark.range(300).selectExpr("id AS row", "0 AS piece", "60L AS length"), size=100, per_group=2)
    assert check_places(alone.collect(), 100) == 300
    fills = np.array([60] * 50 + [30] + [100, 97])
    assert packing.going_up(fills, 100, 4).sum() == packing.FAN + 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, row string").repartition(3)


def some_vectors(seed, n, d, spread=0.2):
    dice = np.random.default_rng(seed)
    mix = dice.normal(size=(d, d))
    return (dice.normal(size=(n, d)) @ mix * spread).astype(np.float32)


NAN, INF = float("nan"), float("inf")


def brute_whitening(e):
    x = np.floor(1024 * e.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(axis=1), y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


@pytest.mark.parametrize("d", [12, 5])
def test_whitening(spark, d):
    e = some_vectors(d, 300, d)
    rows = [(i, v.tolist(), i % 3, "a", "b") for i, v in enumerate(e)]
    bad = [(900, None, 1, "", ""), (901, [None] + [1.0] * (d - 1), 1, "", ""), (902, [NAN] * d, 1, "", ""), (903, [INF] * d, 1, "", ""), (904, [], 1, "", ""), (905, [1.0], 1, "", ""), (906, [1e37] * d, 1, "", "")]
    again = [(4, e[4].tolist(), None, "", ""), (None, e[5].tolist(), None, "", "")]
    got = whitening.components_of(vectors(spark, rows + bad + again)).collect()
    dev, white, share = brute_whitening(np.concatenate([e, e[4:6]]))
    k = min(8, d)
    assert len(got) == 302 * k and {r.n for r in got} == {302} and {r.component for r in got} == set(range(1, k + 1))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert len(by[4]) == 2 * k and len(by[None]) == k
    signs = np.sign([sum(r.whitened * white[r.vec_id, r.component - 1] for i in range(300) for r in by[i] if r.component == c) for c in range(1, k + 1)])
    for r in got:
        i = 5 if r.vec_id is None else r.vec_id
        assert r.deviation == dev[i] and abs(r.whitened - signs[r.component - 1] * white[i, r.component - 1]) < 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-10


def test_whitening_without_variance(spark):
    e = some_vectors(3, 50, 6)
    e[:, 2] = 0.25  # constant
    e[:, 4] = e[:, 0]  # dependent
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(e)]
    got, model = whitening.whitened(vectors(spark, rows))
    assert {len(r.whitened) for r in got.collect()} == {4} and model.identity_error < 1e-8
    one = whitening.components_of(vectors(spark, rows[:1]))
    assert one.count() == 0 and whitening.components_of(vectors(spark, [])).count() == 0
    same = whitening.components_of(vectors(spark, [(i, [0.5, 0.25], 0, "", "") for i in range(9)]))
    assert same.count() == 0


def test_shift_carries_ill_conditioned_rows():
    dice = np.random.default_rng(0)
    y = dice.normal(size=(500, 6)) * [1e8, 1, 1, 1, 1, 1e-3]
    q, r = y, np.eye(6)
    for k in range(4):
        g = q.T @ q
        f = whitening.factor(g, 1e-2 * np.linalg.eigvalsh(g)[-1] if k == 0 else 0.0)
        q, r = whitening.solved(q, f), f @ r
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-12
    assert np.abs(np.linalg.svd(r)[1] / np.linalg.svd(y)[1] - 1).max() < 1e-9


def test_deviations_beyond_64_bits():
    x = np.array([[2**52, -(2**52)], [0, 1]], np.int64)
    diff = whitening.differences(x, 10**6, [5, 7])
    assert diff.dtype == object and whitening.deviations(diff) == [None, 25 + (10**6 - 7) ** 2]
    assert whitening.deviations(whitening.differences(x[1:], 2, [1, 1])) == [1 + 1]


@pytest.mark.parametrize("largest", [3, 200, 2**20, 2**29])
def test_packed_products_are_exact(largest):
    dice = np.random.default_rng(largest)
    x, a = dice.integers(-largest, largest + 1, (11, 6)), dice.integers(-largest, largest + 1, (4, 6))
    x[0], a[0] = largest, -largest
    fields = negatives.Fields.of(largest, int(np.abs(a).sum(axis=1).max()))
    assert fields.each > 1 or fields.width > 31
    want = a.astype(object) @ x.T.astype(object)
    assert fields.products(a, fields.pack(x), 11).tolist() == want.tolist()


def brute_negatives(rows):
    q = [(i, l, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, l in rows]
    out = Counter()
    for k, (i, label, a) in enumerate(q):
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), j, m) for t, (j, m, b) in enumerate(q) if t != k]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hard = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            for rank, (s, n, _) in enumerate(hard, 1):
                out[i, j, rank, n, -p, -s] += 1
    return out


@pytest.mark.parametrize("per_block", [(4096, 256), (17, 2)])
def test_hard_negatives(spark, per_block):
    e = some_vectors(8, 330, 6)
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(e)]
    rows += [(i, rows[7][1], 9 if i % 2 else 3) for i in range(330, 360)]  # ties
    rows += [(100, rows[3][1], 1), (12, rows[12][1], 0), (400, rows[7][1], 77)]  # repeats, and an anchor without positives
    bad = [(None, rows[0][1], 1), (500, rows[0][1], None), (600, None, 1), (700, [NAN] + [0.1] * 5, 1), (800, [None] + [0.1] * 5, 1), (900, [0.1], 1)]
    frame = vectors(spark, [(i, v, m, "", "") for i, v, m in rows + bad])
    got = Counter(tuple(r) for r in negatives.hard_negatives(frame, per_block=per_block).collect())
    assert got == brute_negatives(rows) and len(got) > 50
    assert negatives.hard_negatives(frame.limit(0)).count() == 0
    assert negatives.hard_negatives(frame.where("vec_id % 100 <> 0")).count() == 0
    assert negatives.hard_negatives(frame.where("vec_id = 400")).count() == 0


def test_negatives_next_to_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op13_negatives(spark, folder)
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        found = connection.execute(negatives.SQL)
        names = [d[0] for d in found.description]
        assert sorted(got.select(*names).collect()) == sorted(found.fetchall())
