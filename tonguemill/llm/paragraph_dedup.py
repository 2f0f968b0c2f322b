"""Substring dedup: paragraph MinHash banding.

A paragraph is a stretch of a line that ends with a sentence of at least :data:`LONG`
words, or with the line; shorter sentences belong to the long one after them.
These edges depend on the words around them only, so a passage that was pasted into the middle of
another line falls into the same paragraphs as elsewhere, but for its first and last. Paragraphs
of fewer than :data:`MIN_WORDS` words are left alone.

Passages that hold no whole paragraph are found by their content, wherever lines and
sentences end: of each run of :data:`PASSAGE` words the stretch of :data:`STRETCH` words with the least hash
is taken, so two equal runs, wherever they stand, have an equal stretch. Stretches are compared as
a whole: equal or not. They overlap paragraphs and each other, and have the number
``-1 - first word`` where paragraphs count from 0; whoever deletes what doesn't stay
must leave the words of rows that do.

Paragraphs are sets of word triples. MinHash signatures are cut into bands, tuned by
:func:`tune_bands` so that a pair at the Jaccard threshold collides in some band with
probability :data:`RECALL`. Paragraphs that collide are compared by their exact Jaccard
similarity, and removals are clustered by connected components.

1. One pass over the text writes the catalogue of paragraphs and stretches: ids and band keys, no text.
2. Rows of the catalogue with one id are counted, partial sums first. Paragraphs with equal
   words share an id, so a boilerplate that stands in every tenth document is one row for each task
   before anything is shuffled, and one row after it. Only these distinct paragraphs are
   spread by their band keys; buckets with two or more of them go on, once for each set of members.
3. The triples of those members are fetched from the text (their ids are broadcast
   while they are at most :data:`SENT_IDS`, and joined beyond that) and brought to their buckets.
   A bucket of more than :data:`BUCKET` members is cut into parts, and each pair of parts is a task.
   A bucket's graph is searched breadth-first: each member reached is compared with all
   that aren't reached yet, over an inverted index of triples that shrinks with them. That finds the
   bucket's components exactly, without a cap.
4. Components of the verified edges, joined with the catalogue.

Nulls and odd input: null and empty texts have no paragraphs; very long texts and paragraphs are read
whole; a null ``doc_id`` counts as
the largest; paragraphs and stretches repeated within a document count as copies; repeated rows are
copies, and their equal paragraphs (same doc_id and number) stay or go together; of several that could
stay (ties) the one with the smallest id and place does; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .components import connected_components
from .tables import session_of, table, written

LONG, MIN_WORDS, SHINGLE = 10, 13, 3
PASSAGE, STRETCH = 50, 25
THRESHOLD, RECALL, SEED = 0.8, 0.97, 99
SENT_IDS = 4_000_000
BUCKET = 20_000


#: UTF-8 of the sentence marks of three bytes (… ‼ ⁇ ⁈ ⁉ 。 ． ！ ？ ｡ । ॥ ። ។) and of two (؟ ۔ ։).
_STOPS3 = np.array([int.from_bytes(c.encode()) for c in "…‼⁇⁈⁉。．！？｡।॥።។"])
_STOPS2 = np.array([int.from_bytes(c.encode()) for c in "؟۔։"])


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` that reach ``recall`` at ``threshold``."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


def paragraphs(w: tk.Words) -> tuple[np.ndarray, ...]:
    """(word offsets, document index, number within the document, id) of each
    paragraph; offsets have one entry more."""
    n = len(w.hash)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), z, z, np.zeros(0, np.uint64)
    line = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum((w.data == 10) | (w.data == 13), out=line[1:])
    mark = (w.data == 46) | (w.data == 33) | (w.data == 63)
    for width, marks in ((2, _STOPS2), (3, _STOPS3)):
        lead = np.flatnonzero((w.data >= 0xE0) if width == 3 else (w.data >= 0xD6) & (w.data <= 0xDB))
        code = sum(w.data[lead + i].astype(np.int64) << 8 * (width - 1 - i) for i in range(width))
        mark[lead[np.isin(code, marks)]] = True
    stop = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum(mark, out=stop[1:])
    doc = w.doc
    last = np.ones(n, bool)
    last[:-1] = doc[1:] != doc[:-1]
    newline, sentence = last.copy(), last.copy()
    newline[:-1] |= line[w.start[1:]] > line[w.end[:-1]]
    sentence[:-1] |= stop[w.start[1:]] > stop[w.start[:-1]]  # some marks count as parts of words
    sentence |= newline
    ends = np.flatnonzero(sentence)
    length = np.diff(np.concatenate([[-1], ends]))
    off = np.concatenate([[0], ends[newline[ends] | (length >= LONG)] + 1])
    d = doc[off[:-1]]
    first = np.searchsorted(d, np.arange(len(w.off) - 1))
    up, down = tk._power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(w.hash * down[:n], out=total[1:])
    uid = tk.mix64((total[off[1:]] - total[off[:-1]]) * up[off[1:] - 1] + np.diff(off).astype(np.uint64))
    return off, d, np.arange(len(d)) - first[d], uid


def stretches(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the stretches taken: the least of each run of PASSAGE words."""
    run = np.maximum(np.diff(w.off) - PASSAGE + 1, 0)
    if not run.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = tk._power_tables(len(w.hash))
    total = np.empty(len(w.hash) + 1, np.uint64)
    total[0] = 0
    np.cumsum(w.hash * down[: len(w.hash)], out=total[1:])
    h = tk.mix64((total[STRETCH:] - total[:-STRETCH]) * up[STRETCH - 1 : len(w.hash)] + np.uint64(STRETCH))
    n = PASSAGE - STRETCH + 1
    # of equal stretches in a run one is taken, by its place, so that one word over and over yields few
    place = np.arange(len(h)) - w.off[np.searchsorted(w.off, np.arange(len(h)), "right") - 1]
    low = (h & ~np.uint64(63)) | (place % n).astype(np.uint64)
    at = np.arange(len(h))
    width = 1
    while width < n:  # at[i]: the least of the ``width`` stretches from i on
        step = min(width, n - width)
        a, b = at[:-step], at[step:]
        at = np.where(low[b] < low[a], b, a)
        width += step
    first = np.repeat(w.off[:-1] - np.cumsum(run) + run, run) + np.arange(int(run.sum()))
    at = np.unique(at[first])
    return at, h[at]


def signatures(w: tk.Words, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) band keys; all paragraphs have at least SHINGLE words."""
    sh, _, soff = tk.windows(w.hash, off, SHINGLE)
    rng = np.random.default_rng(SEED)
    out = np.empty((len(off) - 1, bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(off) - 1, b + 1, np.uint64)
        for a in rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
            acc = acc * np.uint64(tk.BASE) + np.minimum.reduceat(tk.mix64(sh * a), soff[:-1])
        out[:, b] = tk.mix64(acc)
    return out


def _long_enough(w: tk.Words):
    """Paragraphs of MIN_WORDS or more, as a Words view of their own words, and after
    them the stretches, each as SHINGLE words that no other has: they are alike if equal."""
    off, d, no, uid = paragraphs(w)
    n = np.diff(off)
    keep = np.flatnonzero(n >= MIN_WORDS)
    at = np.repeat(off[:-1][keep], n[keep]) + (np.arange(int(n[keep].sum())) - np.repeat(np.cumsum(n[keep]) - n[keep], n[keep]))
    own = np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int64)
    first, h = stretches(w)
    owner = np.searchsorted(w.off, first, "right") - 1
    alone = tk.mix64(h[:, None] + np.arange(1, SHINGLE + 1, dtype=np.uint64)).reshape(-1)
    at, own = np.concatenate([at, np.repeat(first, SHINGLE)]), np.concatenate([own, own[-1] + SHINGLE * np.arange(1, len(h) + 1)])
    view = tk.Words(np.concatenate([w.hash[at[: len(at) - len(alone)]], alone]), at, at, own, w.data, w.text_off)
    return view, own, np.concatenate([d[keep], owner]), np.concatenate([no[keep], w.off[owner] - first - 1]), np.concatenate([uid[keep], tk.mix64(h)])


def catalogue(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, paragraph, n_words, uid, k0, k1, ...) of each paragraph and stretch; a
    stretch can meet its equals only and has no band keys."""
    keys = [f"k{i}" for i in range(bands)]

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                view, own, d, no, uid = _long_enough(tk.words(b.column(1)))
                m = int((no >= 0).sum())
                s = np.zeros((0, bands), np.uint64)
                if m:
                    s = signatures(tk.Words(view.hash[: own[m]], view.start, view.end, own[: m + 1], view.data, view.text_off), own[: m + 1], bands, rows)
                none = pa.nulls(len(uid) - m, pa.int64())
                k = [pa.concat_arrays([pa.array(tk.signed(s[:, i].copy())), none]) for i in range(bands)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(no.astype(np.int32)), pa.array(np.where(no < 0, STRETCH, np.diff(own)).astype(np.int32)), pa.array(tk.signed(uid)), *k], ["doc_id", "paragraph", "n_words", "uid", *keys])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, paragraph int, n_words int, uid bigint, " + ", ".join(f"{k} bigint" for k in keys))


def distinct_units(cat: DataFrame) -> DataFrame:
    """(uid, n, k0, ...): each paragraph once, and each stretch that occurs more than once."""
    keys = [c for c in cat.columns if c.startswith("k")]
    return cat.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in keys]).where(F.col("n") > 1 if not keys else (F.col("n") > 1) | F.col(keys[0]).isNotNull())


def buckets(units: DataFrame) -> DataFrame:
    """(bucket, n, uid): the members of each set of two or more colliding paragraphs."""
    keys = [c for c in units.columns if c.startswith("k")]
    met = Window.partitionBy("key")
    spread = units.where(F.col(keys[0]).isNotNull()).select("uid", F.explode(F.array(*keys)).alias("key"))
    # a window spills, so a key that very many have needs no memory
    sets = spread.select("uid", F.count(F.lit(1)).over(met).alias("n"), F.bit_xor(F.xxhash64("uid")).over(met).alias("x")).where("n > 1")
    return sets.select(F.xxhash64("n", "x").alias("bucket"), "n", "uid").distinct()


def cells(met: DataFrame, limit: int) -> DataFrame:
    """(cell, uid): buckets, and the pairs of parts of those with more than ``limit`` members."""
    parts = F.ceil(F.col("n") / max(limit // 2, 1))
    own = F.pmod(F.xxhash64("uid"), parts)
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda o: F.xxhash64("bucket", F.least(o, own), F.greatest(o, own)))
    return met.select(F.explode(F.when(F.col("n") > limit, pair).otherwise(F.array("bucket"))).alias("cell"), "uid")


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, triples) of the paragraphs whose ids are in ``wanted`` (uid)."""
    spark = docs.sparkSession
    few = wanted.count() <= SENT_IDS
    sent = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy())) if few else None

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                view, own, _, no, uid = _long_enough(tk.words(b.column(0)))
                ids = tk.signed(uid[no >= 0])
                _, pick = np.unique(ids, return_index=True)
                if few:
                    want = sent.value
                    if not len(want):
                        return
                    i = np.minimum(np.searchsorted(want, ids[pick]), len(want) - 1)
                    pick = pick[want[i] == ids[pick]]
                if len(pick):
                    sh, _, soff = tk.windows(view.hash, own, SHINGLE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array([np.unique(sh[soff[p] : soff[p + 1]]).tobytes() for p in pick], pa.binary())], ["uid", "triples"])

    found = docs.select("text").mapInArrow(run, "uid bigint, triples binary")
    if not few:
        found = found.join(wanted, "uid", "left_semi")
    return found.groupBy("uid").agg(F.first("triples").alias("triples"))


class _Index:
    """Which of some sets hold a term, by the terms' numbers."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, terms: int):
        self.owner, self.start = owner[np.argsort(term, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])

    def of(self, terms: np.ndarray) -> np.ndarray:
        n = self.start[terms + 1] - self.start[terms]
        return self.owner[np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def jaccard_components(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Edges (i, j) that span the components of the graph that joins two sets whose
    Jaccard similarity is at least ``threshold``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    terms, term = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    free, left, indexed = np.ones(len(sets), bool), len(sets), len(sets)
    index = _Index(owner, term, len(terms))
    edges = []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root] = False
        left -= 1
        todo = [root]
        while todo and left:
            if 2 * left < indexed:  # those that are reached needn't be met again
                some = free[owner]
                index, indexed = _Index(owner[some], term[some], len(terms)), left
            i = todo.pop()
            met, common = np.unique(index.of(term[at[i] : at[i + 1]]), return_counts=True)
            near = met[free[met] & (common >= threshold * (size[met] + size[i] - common) - 1e-9)]
            free[near] = False
            left -= len(near)
            edges += [(i, int(j)) for j in near]
            todo += near.tolist()
    return edges


def _groups(batches):
    """(key, rows) of each run of equal keys in the first column, one at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cut, cut[1:]):
            if held and held[0].column(0)[0].as_py() != int(key[s]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between colliding paragraphs (cell, uid, triples) that are alike."""

    def run(batches):
        for t in _groups(batches):
            uid, triples = t.column(1).to_numpy(), t.column(2)
            order = np.argsort(uid, kind="stable")
            if len(order) > 1:
                edges = jaccard_components([np.frombuffer(triples[int(i)].as_py(), np.uint64) for i in order], threshold)
                if edges:
                    i, j = np.array(edges).T
                    yield pa.RecordBatch.from_arrays([pa.array(uid[order[i]]), pa.array(uid[order[j]])], ["a", "b"])

    return members.select("cell", "uid", "triples").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def repeated_paragraphs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """One row (doc_id, paragraph, n_words, cluster, copies, stays) for each
    paragraph or stretch (``paragraph`` below 0) that has copies; of a cluster the first by (doc_id, place) stays."""
    session_of(docs)
    bands, rows = tune_bands(threshold, recall)
    cat = written(catalogue(docs, bands, rows), "paragraphs")
    units = written(distinct_units(cat), "units")
    near = written(buckets(units), "buckets")
    wanted = near.select("uid").distinct()
    comp = connected_components(verified(cells(near, bucket).join(contents(docs, wanted), "uid"), threshold))
    alone = units.where("n > 1").select("uid").join(comp.select(F.col("node").alias("uid")), "uid", "left_anti")
    cluster = comp.select(F.col("node").alias("uid"), F.col("component").alias("cluster")).unionByName(alone.select("uid", F.col("uid").alias("cluster")))
    rows_ = written(cat.select("doc_id", "paragraph", "n_words", "uid").join(cluster, "uid").drop("uid"), "repeats")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("y"), F.abs("paragraph").alias("z"))
    whole = rows_.groupBy("cluster").agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("best"))
    return rows_.join(whole, "cluster").select("doc_id", "paragraph", "n_words", "cluster", "copies", (rank == F.col("best")).alias("stays"))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))
