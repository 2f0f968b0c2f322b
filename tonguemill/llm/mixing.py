"""Mixing sources to target weights: temperature mixing.

Source token shares q are raised to an exponent a in [0, 1] and normalised. The
exponent is found by bisection: the largest a whose weights have at least the target
entropy (a share of the entropy of uniform weights), raised further where a source
would otherwise have to be repeated more often than the limit allows; entropy falls and
repetition falls as a grows, so the limit wins where both can't be met. At a = 1 nothing is
repeated more than the budget asks of all sources alike.

The weights are realised by budgeted block permutations: source i has a budget of
w_i times the token budget (the corpus size by default). It gives as many
whole blocks as fit, each block all its documents in a random order of its
own, and then documents from the front of one more block while the tokens before them are
below what is left of the budget.

The order in a block is that of a seeded hash. To cut a block at its budget without
sorting a source in one place, documents fall into buckets by leading bits of
the hash; bucket sums are added up in order, and only the bucket in which the
budget ends is looked at document by document. A hot source is thus spread like any other.

The text is read twice: one pass writes source, id, hash and tokens of each row, of which the
plan is made; another deals the rows, all blocks at once.

Nulls and odd input: a null source is a source of its own, and a null ``doc_id`` a value like
others; a document without tokens
(null or empty text) belongs to whole blocks only, and to a partial block while there is
budget before its place; a very long document is whole or not at all in a block, so the last
one may exceed the budget; equal rows have equal places in the order and are counted one by one;
a source without tokens has no weight and gives no rows, nor does an
empty table. Columns pass through; those named like the added ones keep their names and values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, quoted, session_of, table, written

ENTROPY_SHARE, MAX_REPEATS, SEED = 0.97, 4.0, 2026
STEPS = 60
BUCKET_DIGITS = 3  # of the hexadecimal hash: 4,096 buckets to a source and block
_TOKEN = r"[^ \t\n\f\r\x0B]+"


def n_tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0))


def temperature_weights(tokens: list[int], entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> tuple[float, list[float]]:
    """(exponent, weights) for sources with so many tokens each; no tokens, no weight."""
    total = sum(tokens)
    if total == 0:
        return 1.0, [0.0] * len(tokens)
    logs = [math.log(t / total) if t else None for t in tokens]
    live = sum(t > 0 for t in tokens)

    def weights(a: float) -> list[float]:
        e = [math.exp(a * x) if x is not None else 0.0 for x in logs]
        s = sum(e)
        return [x / s for x in e]

    def entropy(w: list[float]) -> float:
        return -sum(x * math.log(x) for x in w if x > 0)

    def repeats(w: list[float]) -> float:
        return max(x * total / t for x, t in zip(w, tokens) if t)

    target = entropy_share * math.log(live)

    def bisect(fine) -> float:
        """The largest exponent for which ``fine`` holds, which it does from 0 on."""
        lo, hi = 0.0, 1.0
        if fine(weights(hi)):
            return hi
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            if fine(weights(mid)):
                lo = mid
            else:
                hi = mid
        return lo

    a = bisect(lambda w: entropy(w) >= target)
    if repeats(weights(a)) > max_repeats:  # the least exponent within the limit
        lo, hi = a, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            if repeats(weights(mid)) <= max_repeats:
                hi = mid
            else:
                lo = mid
        a = hi
    return a, weights(a)


def _light(docs: DataFrame) -> DataFrame:
    """(s, i, h, n): source, id, hash of the text and tokens of each row; no text."""
    return docs.select(F.col("source").cast("string").alias("s"), F.col("doc_id").cast("bigint").alias("i"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("h"), n_tokens(F.col("text")).cast("bigint").alias("n"))


def plan(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> list[tuple]:
    """(source, tokens, weight, budget, whole blocks, rest) of each source, in order.

    What reaches the driver is one row for each source."""
    return _plan(_light(docs), entropy_share, max_repeats, budget)


def _plan(light: DataFrame, entropy_share: float, max_repeats: float, budget: int | None) -> list[tuple]:
    found = light.groupBy("s").agg(F.sum("n").alias("t")).collect()
    rows = sorted(((r.s, int(r.t)) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(t for _, t in rows)
    _, w = temperature_weights([t for _, t in rows], entropy_share, max_repeats)
    out = []
    for (s, t), x in zip(rows, w):
        # nine digits, so that the last bits of a logarithm decide nothing
        b = int(round(x, 9) * (total if budget is None else budget))
        out.append((s, t, round(x, 9), b, b // t if t else 0, b % t if t else 0))
    return out


def _key(block: Column, i: Column, h: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(i.cast("string"), F.lit("null")), h))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A row for each source, no text: broadcast while the catalogue of sources has at most 100,000."""
    return F.broadcast(df) if rows <= 100_000 else df


def _cuts(light: DataFrame, p: list[tuple], seed: int) -> dict:
    """Source -> (place of the last row of its partial block, how many rows of that place
    are in the block, how many there are)."""
    spark = light.sparkSession
    rest = spark.createDataFrame([(r[0], int(r[4]), int(r[5])) for r in p if r[5]], "ps string, whole int, rest bigint")
    keyed = light.join(_small(rest, len(p)), F.col("s").eqNullSafe(F.col("ps"))).select("s", "rest", "n", _key(F.col("whole"), F.col("i"), F.col("h"), seed).alias("k"))
    keyed = keyed.withColumn("b", F.substring("k", 1, BUCKET_DIGITS))
    sums = keyed.groupBy("s", "rest", "b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the last bucket that begins within the budget: the budget ends in it
    last = sums.where("before < rest").groupBy(F.col("s").alias("cs")).agg(F.max_by(F.struct("b", (F.col("rest") - F.col("before")).alias("left")), "b").alias("x")).select("cs", F.col("x.b").alias("cb"), "x.left")
    edge = keyed.join(_small(last, len(p)), F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb"))).groupBy("s", "left", "k").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    upto = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("gap", F.col("left") - F.coalesce(F.sum(F.col("c") * F.col("n")).over(upto), F.lit(0))).where("gap > 0")
    took = F.when(F.col("n") > 0, F.least(F.col("c"), F.ceil(F.col("gap") / F.col("n")))).otherwise(F.col("c"))
    found = edge.groupBy("s").agg(F.max(F.struct("k", took.alias("took"), "c")).alias("x")).collect()
    return {r.s: (r.x.k, int(r.x.took), int(r.x.c)) for r in found}


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` as often as the plan takes each, and three columns at the end: ``__tm_block``
    (from 0), ``__tm_key`` (place in the block) and ``__tm_tokens``. Where docs has a column of
    such a name it keeps it, and the new one's name ends in ``_``."""
    spark = session_of(docs)
    light = written(_light(docs), "mix-rows")
    p = _plan(light, entropy_share, max_repeats, budget)
    ends = _cuts(light, p, seed)
    added = fresh(docs.columns, "__tm_block", "__tm_key", "__tm_tokens")
    block, key, count = added
    src, whole, end, all_in, took, i, h = fresh([*docs.columns, *added], "__tm_src", "__tm_whole", "__tm_end", "__tm_all", "__tm_took", "__tm_i", "__tm_h")
    per_source = spark.createDataFrame([(r[0], int(r[4]), e[0] if e else None, e[1] == e[2] if e else None, e[1] if e else 0) for r in p for e in [ends.get(r[0])]], f"{src} string, {whole} int, {end} string, {all_in} boolean, {took} bigint")
    base = docs.withColumns({i: F.col("doc_id").cast("bigint"), h: F.md5(F.coalesce(F.col("text"), F.lit(""))), count: n_tokens(F.col("text"))}).join(_small(per_source, len(p)), F.col("source").cast("string").eqNullSafe(F.col(src)))
    blocks = base.withColumn(block, F.explode(F.sequence(F.lit(0), F.col(whole)))).withColumn(key, _key(F.col(block), F.col(i), F.col(h), seed))
    columns = quoted([*docs.columns, *added])
    at_end = F.col(key) == F.col(end)
    out = blocks.where((F.col(block) < F.col(whole)) | (F.col(key) < F.col(end)) | (at_end & F.col(all_in))).select(*columns)
    if all(c == n for _, n, c in ends.values()):
        return out
    # equal rows share a place, and not all of them are in the block
    no = Window.partitionBy(src).orderBy(F.lit(0))
    tied = blocks.where((F.col(block) == F.col(whole)) & at_end & ~F.col(all_in)).withColumn(i, F.row_number().over(no)).where(F.col(i) <= F.col(took))
    return out.unionByName(tied.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("__tm_block").alias("block"), F.col("__tm_key").alias("place"), F.col("__tm_tokens").cast("bigint").alias("tokens"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS th, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r\v]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
tot AS (SELECT sum(t)::DOUBLE AS total, count(*) FILTER (t > 0) AS live FROM s),
l AS (SELECT source, t, total, live, CASE WHEN t > 0 THEN ln(t / total) END AS x FROM s, tot),
e AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
    SELECT k + 1, CASE WHEN fine THEN (CASE WHEN k = 0 THEN 1.0 ELSE mid END) ELSE lo END, CASE WHEN fine THEN hi ELSE (CASE WHEN k = 0 THEN hi ELSE mid END) END
    FROM (SELECT k, lo, hi, mid, (SELECT ln(sum(exp(a * x))) - max(a) * sum(exp(a * x) * x) / sum(exp(a * x)) >= {ENTROPY_SHARE} * ln(max(live)) FROM l, (SELECT CASE WHEN k = 0 THEN 1.0 ELSE mid END AS a)) AS fine
        FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid FROM e WHERE k <= {STEPS}))),
a1 AS (SELECT max(lo) AS a FROM e),
r AS (SELECT 0 AS k, a AS lo, 1.0::DOUBLE AS hi FROM a1 UNION ALL
    SELECT k + 1, CASE WHEN fine THEN lo ELSE mid END, CASE WHEN fine THEN mid ELSE hi END
    FROM (SELECT k, lo, hi, mid, (SELECT max(exp(mid * x) / t) * max(total) / sum(exp(mid * x)) <= {MAX_REPEATS} FROM l) AS fine FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid FROM r WHERE k < {STEPS}))),
a AS (SELECT CASE WHEN (SELECT max(exp(a1.a * x) / t) * max(total) / sum(exp(a1.a * x)) FROM l) > {MAX_REPEATS} THEN (SELECT min(hi) FROM r) ELSE a1.a END AS a FROM a1),
w AS (SELECT source, t, floor(round(exp(a * x) / sum(exp(a * x)) OVER (), 9) * total)::BIGINT AS b FROM l, a WHERE t > 0),
p AS (SELECT source, t, b // t AS whole, b % t AS rest FROM w),
k AS (SELECT d.*, whole, rest, unnest(range(0, whole + 1)) AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
m AS (SELECT *, md5('{SEED}:' || block || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || th) AS place FROM k),
f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, block ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT doc_id, source, block::INTEGER AS block, place, n AS tokens FROM f WHERE block < whole OR before < rest"""
