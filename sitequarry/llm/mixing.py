"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequarry.llm.common import WORD, parts, saved


def sizes(docs: DataFrame, seed: int, *keep: str) -> DataFrame:
    """source, size in words, and draw, the row's place in a fixed random order, with the columns of docs to keep.

    The text is part of the draw, so rows that repeat a doc_id, or have none, are spread too; only equal rows share a place.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text.cast("binary")))
    return docs.select(
        *keep,
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(place.cast("binary")).alias("draw"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Per source: rank, source_size, n_docs, target, full (whole passes), rest (words beyond them).

    Sources are few beside documents; the windows here have a row per source. Sources that would exceed `most` times
    their size stop there: ordered by size over weight, they are those before the first whose even share fits.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per_source.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spot", F.row_number().over(by_room))
        .withColumn("used", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).cast("double"))
        .withColumn("left", (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
        .withColumn("fits", F.col("source_size") * most >= F.col("level") * F.col("weight"))
        .withColumn("from", F.min(F.when(F.col("fits"), F.col("spot"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("spot") == F.col("from"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("spot") >= F.col("from"), F.col("level") * F.col("weight")).otherwise((F.col("source_size") * most).cast("double")),
        )
        .withColumn("full", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0))
    )
    rest = F.when(F.col("full") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size"))
    return ranked.select(
        "source", "rank", "source_size", "n_docs", "target", F.col("full").cast("long").alias("full"), rest.alias("rest"),
        F.ceil(F.sqrt("n_docs")).cast("long").alias("n_blocks"),
    )


def hypergeometric(total: Column, good: Column, taken: Column, u: Column) -> Column:
    """How many of `good` among `taken` drawn from `total`, for the uniform `u`: inversion over ten standard deviations.

    Outside them the probability is below 1e-20. Weights grow by the ratio of neighbours, so nothing under- or overflows.
    """
    low, high = F.greatest(F.lit(0), taken - total + good), F.least(good, taken)
    mean = taken * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - good / F.greatest(total, F.lit(1))), F.lit(0.0))) * 10 + 10
    first = F.greatest(low, F.floor(mean - spread)).cast("long")
    last = F.greatest(first, F.least(high, F.ceil(mean + spread))).cast("long")

    def ratio(x: Column) -> Column:
        return (good - x) * (taken - x) / ((x + 1) * (total - good - taken + x + 1)).cast("double")

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    steps = F.sequence(first, last)
    mass = F.aggregate(steps, start, lambda s, x: F.struct((s["p"] * F.coalesce(ratio(x), F.lit(0.0))).alias("p"), (s["sum"] + s["p"]).alias("sum")))["sum"]
    begin = F.struct(F.lit(1.0).alias("p"), (mass * u).alias("left"), first.alias("x"), F.lit(False).alias("found"))
    return F.aggregate(
        steps,
        begin,
        lambda s, x: F.when(s["found"], s).otherwise(
            F.struct(
                (s["p"] * F.coalesce(ratio(x), F.lit(0.0))).alias("p"),
                (s["left"] - s["p"]).alias("left"),
                x.alias("x"),
                (s["left"] <= s["p"]).alias("found"),
            )
        ),
    )["x"]


def halved(nodes: DataFrame, dice: Column) -> DataFrame:
    """Both children of each node."""

    def drawn(s: Column, n: Column) -> Column:
        u = F.pmod(F.xxhash64(dice, F.size(s["got"])), F.lit(1 << 53)) / float(1 << 53)
        x = hypergeometric(s["all"], n, s["want"], u)
        return F.struct((s["all"] - n).alias("all"), (s["want"] - x).alias("want"), F.concat(s["got"], F.array(x)).alias("got"))

    every = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    empty = F.array().cast("array<bigint>")
    begin = F.struct(every.alias("all"), F.floor(every / 2).cast("long").alias("want"), empty.alias("got"))
    halves = nodes.withColumn("lefts", F.aggregate("q", begin, drawn)["got"])
    child = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("lefts").alias("q")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "lefts", lambda a, b: a - b).alias("q")),
    )
    return halves.select("ranks", F.explode(child).alias("c")).select("c.node", "c.q", "ranks")


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """rank and ends: where each of the 2**depth shards' runs of the source's drawn blocks end.

    quotas: rank, quota. A node holds its quotas in one array, a number per source; its left child gets half of its blocks, the
    number from each source drawn source by source. Counts per source and per shard stay exact at every level.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), F.col("q.quota").alias("q"), F.col("q.rank").alias("ranks")
    )
    for level in range(depth):
        nodes = halved(nodes, F.xxhash64(F.lit(seed), F.lit(level), F.col("node")))
        nodes = saved(nodes, "split") if level % 4 == 3 else nodes
    runs = nodes.select("node", F.explode(F.arrays_zip(F.col("ranks").alias("rank"), F.col("q").alias("n"))).alias("r")).select("node", "r.rank", "r.n")
    upto = Window.partitionBy("rank").orderBy("node")
    ended = runs.withColumn("end", F.sum("n").over(upto))
    return ended.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


#: Times that a source goes on behind a document that does not fit.
ROUNDS = 4


def position(copy: Column) -> Column:
    """A copy's place: all first copies beyond the whole passes come before second ones."""
    return F.struct(copy.cast("long").alias("copy"), F.col("block"), F.col("draw"), F.col("size"))


def within(cut: Column, copy: Column) -> Column:
    """Whether a copy is taken by a cut: small enough for what was missing then, and not behind its place."""
    return (F.col("size") <= cut["lack"]) & (position(copy) <= cut["upto"])


def filled(placed: DataFrame, per_source: DataFrame, rounds: int) -> DataFrame:
    """rank, cuts and pick: up to where, and up to which size, copies of rows are taken beyond a source's whole passes.

    placed: rank, copy (from 1, as many as are left up to the most), block, draw, size. Copies lie in the order of copy, block and draw. A round
    goes through those that are no larger than what is missing and takes them as far as their running sum fits; the next round does so with what
    is still missing then, which is less than the first copy that did not fit. So a very long document is passed over, blocks behind it and then
    second copies are used, and what is missing shrinks from round to round. Last, the copy whose size comes nearest is taken if that brings
    the source nearer to its target. Running sums go over sums of blocks; in one block of each source they go over rows.
    """
    none = F.array().cast("array<struct<lack:double,upto:struct<copy:bigint,block:bigint,draw:string,size:bigint>>>")
    taken = F.exists("cuts", lambda c: within(c, F.col("copy")))
    state = saved(per_source.select("rank", F.col("rest").alias("lack"), none.alias("cuts")), "fill")
    for _ in range(rounds):
        left = placed.join(state, "rank").where((F.col("size") <= F.col("lack")) & ~taken)
        sums = left.groupBy("rank", "copy", "block").agg(F.sum("size").alias("words"), F.max("lack").alias("lack"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("rank").orderBy("copy", "block")))
        over = F.col("upto") > F.col("lack")
        # the block in which the sum is exceeded; if there is none, everything is taken
        blocks = sums.groupBy("rank").agg(
            F.min(F.when(over, F.struct("copy", "block", (F.col("upto") - F.col("words")).alias("before")))).alias("at"),
            F.max(F.struct("copy", "block")).alias("last"),
            F.sum("words").alias("words"),
        )
        blocks = saved(blocks, "fill-blocks")
        edge = left.join(blocks.select("rank", "at.copy", "at.block", "at.before"), ["rank", "copy", "block"])
        sofar = F.col("before") + F.sum("size").over(Window.partitionBy("rank").orderBy("draw", "size"))  # equal rows together
        fits = edge.withColumn("sofar", sofar).where(F.col("sofar") <= F.col("lack"))
        fits = fits.groupBy("rank").agg(F.max(F.struct("draw", "size")).alias("to"), F.max("sofar").alias("sofar"))
        cut = blocks.join(fits, "rank", "left").select(
            "rank",
            F.struct(
                F.coalesce("at.copy", "last.copy").cast("long").alias("copy"),
                F.coalesce("at.block", "last.block").alias("block"),
                F.when(F.col("at").isNull(), "~").otherwise(F.coalesce("to.draw", F.lit(""))).alias("draw"),
                F.coalesce("to.size", F.lit(0).cast("long")).alias("size"),
            ).alias("upto"),
            F.coalesce("sofar", "at.before", "words").alias("got"),
        )
        state = saved(
            state.join(cut, "rank", "left").select(
                "rank",
                (F.col("lack") - F.coalesce("got", F.lit(0))).alias("lack"),
                F.when(F.col("upto").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(F.struct("lack", "upto")))).alias("cuts"),
            ),
            "fill",
        )
    left = placed.join(state.where("lack > 0"), "rank").where(~taken & (F.col("size") > 0))
    miss = F.abs(F.col("lack") - F.col("size"))
    own = position(F.col("copy"))
    best = left.groupBy("rank").agg(F.min(F.struct(miss.alias("miss"), own.alias("at"))).alias("best"))
    best = best.select("rank", "best.at")
    # of equal rows all are taken or none
    equal = placed.join(best, "rank").where(own == F.col("at")).groupBy("rank", "at").agg(F.count(F.lit(1)).alias("n"))
    better = F.abs(F.col("lack") - F.col("n") * F.col("at.size")) < F.col("lack")
    picked = state.join(equal, "rank", "left").select("rank", "cuts", F.when(better, F.col("at")).alias("pick"))
    return saved(picked, "cuts")


def extra(most: int) -> Column:
    """How many copies of a row are taken beyond its source's whole passes."""
    one = lambda c: F.exists("cuts", lambda cut: within(cut, F.lit(c))) | F.coalesce(position(F.lit(c)) == F.col("pick"), F.lit(False))
    return sum((F.when((F.col("full") + c <= most) & one(c), 1).otherwise(0) for c in range(1, most + 1)), F.lit(0))


def planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, depth: int | None, seed: int, rounds: int) -> DataFrame:
    """Per source what a row needs to know: of, rank, source_size, target, full, n_blocks, cuts, pick, ends."""
    sized = saved(sizes(docs, seed), "sizes")
    per_source = saved(targets(sized, weights, share, most), "targets")
    # few rows, one per source; without a hint Spark's own threshold decides
    placed = sized.join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    copies = F.explode(F.sequence(F.lit(1), F.lit(most) - F.col("full")))
    placed = placed.where(F.col("full") < most).select("rank", copies.alias("copy"), block_of().alias("block"), "draw", "size")
    placed = saved(placed, "placed")
    per_source = per_source.join(filled(placed, per_source, rounds), "rank")
    # blocks drawn in part count as drawn
    unit = lambda at: (at["copy"] - 1) * F.col("n_blocks") + at["block"] + 1
    drawn = F.greatest(F.coalesce(F.array_max(F.transform("cuts", lambda c: unit(c["upto"]))), F.lit(0)), F.coalesce(unit(F.col("pick")), F.lit(0)))
    quotas = per_source.select("rank", (F.col("full") * F.col("n_blocks") + drawn).alias("quota"))
    if depth is None:
        words = per_source.agg(F.sum("target")).first()[0] or 0
        depth = min(16, max(4, int(words / SHARD_WORDS).bit_length()))
    return saved(per_source.join(split_tree(quotas, depth, seed), "rank"), "plan").withColumnRenamed("source", "of")


#: Words of a shard at most, up to 2**16 shards.
SHARD_WORDS = 1 << 27


def block_of() -> Column:
    return F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("n_blocks"))


def with_shards(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Rows (source, size, draw) with their source's plan and `shards`, the output shard of each copy taken."""
    beside = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block_of())
    copies = F.col("full") + extra(most)
    unit = lambda c: c * F.col("n_blocks") + F.col("block")
    shard = lambda c: F.size(F.filter("ends", lambda e: e <= unit(c)))
    shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), shard)).otherwise(F.array().cast("array<int>"))
    return beside.withColumn("shards", shards)


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, depth: int | None = None, seed: int = 17, rounds: int = ROUNDS
) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken, and shards, the output shard of each copy taken.

    A source's documents are put into about sqrt(n) blocks by a fixed random key. Whole passes come first; what is then missing is taken
    from the blocks in order, as `filled` says. Blocks of a source, pass after pass, are its draws; the splitting tree deals runs of them to
    2**depth shards (from the words of the mix, if not given). Same rows, same mix.
    A null text has size 0, a null source is a source of its own and comes last. Rows that repeat a
    doc_id count each; of equal rows all are taken or none. Documents without words are taken with those around them. No rows give none;
    other columns of docs are not read.
    """
    plan = planned(docs, weights, share, most, depth, seed, rounds)
    rows = with_shards(sizes(docs, seed, "doc_id"), plan, most)
    return rows.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), "shards")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, depth: int | None = None, seed: int = 17, rounds: int = ROUNDS) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, a row for each copy taken, dealt to shards and shuffled in them.

    A shard is a run of rows of one partition, in a random order that reruns repeat. Each row has its own copies, also where rows repeat a doc_id.
    """
    plan = planned(docs, weights, share, most, depth, seed, rounds)
    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    rows = with_shards(sizes(docs.withColumn("_row", whole), seed, "_row"), plan, most)
    dealt = rows.select("_row", "draw", F.posexplode("shards").alias("_copy", "_shard"))
    n = max(parts(docs.sparkSession), 1 << (depth or 4))
    dealt = dealt.repartition(n, "_shard", F.pmod(F.xxhash64("draw", "_copy"), F.lit(8)))
    dealt = dealt.sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), F.col("draw"), F.col("_copy")))
    return dealt.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _rounds(rounds: int) -> str:
    """Common table expressions of the rounds: l<r> what is missing before round r, g<r> what the round takes, and e<r> its cut."""
    out, taken = ["l0 AS (SELECT rank, rest AS lack FROM u)"], []
    for r in range(rounds):
        gone = " AND ".join(f"NOT coalesce(d.size <= c{k}.lack AND (d.copy, d.block, d.draw, d.size) <= (c{k}.c, c{k}.b, c{k}.d, c{k}.s), false)" for k in taken) or "true"
        joins = " ".join(f"LEFT JOIN e{k} c{k} ON c{k}.rank = d.rank" for k in taken)
        out.append(f"""
y{r} AS (SELECT d.rank, d.copy, d.block, d.draw, d.size, l.lack FROM d JOIN l{r} l ON l.rank = d.rank {joins} WHERE d.size <= l.lack AND {gone}),
b{r} AS (SELECT *, sum(words) OVER (PARTITION BY rank ORDER BY copy, block) AS upto FROM (
           SELECT rank, copy, block, sum(size) AS words, max(lack) AS lack FROM y{r} GROUP BY ALL)),
a{r} AS (SELECT rank, min((copy, block)) FILTER (WHERE upto > lack) AS at, min(upto - words) FILTER (WHERE upto > lack) AS before, max((copy, block)) AS final, sum(words) AS words
         FROM b{r} GROUP BY rank),
f{r} AS (SELECT rank, max(draw) AS d, arg_max(size, (draw, size)) AS s, max(sofar) AS sofar FROM (
           SELECT y.*, a.before + sum(y.size) OVER (PARTITION BY y.rank ORDER BY y.draw, y.size) AS sofar FROM y{r} y JOIN a{r} a ON a.rank = y.rank AND a.at = (y.copy, y.block))
         WHERE sofar <= lack GROUP BY rank),
e{r} AS (SELECT a.rank, l.lack, coalesce(a.at, a.final)[1] AS c, coalesce(a.at, a.final)[2] AS b, CASE WHEN a.at IS NULL THEN '~' ELSE coalesce(f.d, '') END AS d, coalesce(f.s, 0) AS s,
           coalesce(f.sofar, a.before, a.words)::BIGINT AS got FROM a{r} a JOIN l{r} l ON l.rank = a.rank LEFT JOIN f{r} f ON f.rank = a.rank),
l{r + 1} AS (SELECT l.rank, l.lack - coalesce(e.got, 0) AS lack FROM l{r} l LEFT JOIN e{r} e ON e.rank = l.rank)""")
        taken.append(r)
    return ",\n".join(out)


SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':17:' || md5(coalesce(text, ''))) AS draw FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
             row_number() OVER (ORDER BY source_size::DOUBLE / weight, rank) AS spot FROM w),
r AS (SELECT *, coalesce(sum(source_size * 2) OVER b, 0)::DOUBLE AS used,
             (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS room
      FROM o WINDOW b AS (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, source_size * 2 >= (total - used) / room * weight AS fits FROM r),
g AS (SELECT *, min(CASE WHEN fits THEN spot END) OVER () AS since FROM f),
v AS (SELECT *, max(CASE WHEN spot = since THEN (total - used) / room END) OVER () AS level FROM g),
t AS (SELECT source, rank, source_size, ceil(sqrt(n_docs))::BIGINT AS n_blocks,
             CASE WHEN spot >= since THEN level * weight ELSE (source_size * 2)::DOUBLE END AS target FROM v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS passes FROM t),
u AS (SELECT *, CASE WHEN passes >= 2 THEN 0::DOUBLE ELSE target - passes * source_size END AS rest FROM q),
w0 AS (SELECT row_number() OVER () AS n, s.doc_id, s.size, s.draw, u.*, ('0x' || substr(s.draw, 1, 8))::BIGINT % u.n_blocks AS block
      FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source),
d AS (SELECT * FROM (SELECT w0.*, unnest(range(1, 3 - passes)) AS copy FROM w0)),
""" + _rounds(ROUNDS) + """,
t0 AS (SELECT d.*, """ + " OR ".join(f"coalesce(d.size <= e{r}.lack AND (d.copy, d.block, d.draw, d.size) <= (e{r}.c, e{r}.b, e{r}.d, e{r}.s), false)" for r in range(ROUNDS)) + """ AS fit
       FROM d """ + " ".join(f"LEFT JOIN e{r} ON e{r}.rank = d.rank" for r in range(ROUNDS)) + f"""),
m AS (SELECT t0.rank, lack, copy, block, draw, size, row_number() OVER (PARTITION BY t0.rank ORDER BY abs(lack - size), copy, block, draw, size) AS turn
      FROM t0 JOIN l{ROUNDS} l ON l.rank = t0.rank AND l.lack > 0 WHERE NOT fit AND size > 0),
k AS (SELECT m.rank, m.copy, m.block, m.draw, m.size FROM m JOIN d ON turn = 1 AND d.rank = m.rank AND (d.copy, d.block, d.draw, d.size) = (m.copy, m.block, m.draw, m.size)
      GROUP BY ALL HAVING abs(any_value(m.lack) - count(*) * any_value(m.size)) < any_value(m.lack)),
x AS (SELECT t0.n, count(*) FILTER (WHERE fit OR k.rank IS NOT NULL) AS more FROM t0
      LEFT JOIN k ON k.rank = t0.rank AND (k.copy, k.block, k.draw, k.size) = (t0.copy, t0.block, t0.draw, t0.size) GROUP BY t0.n)
SELECT doc_id, size, source_size, target, (size * (passes + coalesce(more, 0)))::BIGINT AS taken FROM w0 LEFT JOIN x USING (n)
"""
