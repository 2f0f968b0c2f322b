"""Benchmark decontamination over a distributed positional inverted index.

:func:`build_index` stores the postings of every word of the training documents:
each row of the index is a segment (about 4 MB of text, whole documents) with its
term dictionary, the offsets of the posting lists, and the positions in them.
Positions run through the segment with a gap after each document, so that no phrase
reaches over an edge. Segments are independent: the index is partitioned by document,
nothing is shuffled, and executors that are lost cost only their own segments.

:func:`search` runs the test phrases against every segment. Term frequencies over the
whole corpus come from the dictionaries. A phrase is :data:`PHRASE` consecutive words
of a test item (the whole item where it is shorter). Its posting lists are intersected
after taking each term's offset in the phrase off its positions, from the rarest term
on, until nothing is left or all terms agree. Neighbouring phrases on a diagonal merge
into one match, so exact matches are maximal runs of equal words.

Proximity: of each window of :data:`WINDOW` words of an item (the whole item where it is shorter),
the :data:`RARE` rarest terms have places, and enough of them must stand within :data:`SLOP` words
of theirs: at least the share :data:`NEED`, and so many that chance would put them there with a
probability of exp(-:data:`BAR`) at most; where all of them together are more probable than that,
all are needed. Probabilities are relative frequencies in the corpus (at least :data:`FLOOR`), so a
decision depends on the document, the item and the language, neither on the size of the corpus nor on
what else is searched for. Windows found that overlap in the document merge into one
match; a window that overlaps an exact match of its item isn't reported.

A segment looks only at windows with enough terms in its dictionary. The test set's phrases
are sent to all tasks while they take at most :data:`MAX_SENT` bytes; a larger test set is searched in
several rounds over the stored index, each with a part within that size, with the same result.

Nulls and odd input: null and empty texts hold nothing, and an item without words matches
nothing; items of one word or more are searched for; very long texts and items are searched
whole; terms of equal frequency go by their place in the item; null ids
are carried along; repeated documents and repeated items are each reported; columns
other than the ids and the text are not read; with an empty table on either side the
result is empty, and nothing is taken out of the documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .tables import fresh, quoted, sent_if_small, session_of, table, written

PHRASE = 8
WINDOW, STRIDE, RARE, SLOP, NEED, BAR, FLOOR = 24, 8, 12, 3, 0.5, 40.0, 1e-6
MAX_SENT = 64 << 20
#: Bytes sent for each word of a test text, at most.
SENT_PER_WORD = 72
#: Postings that are looked at together; bounds a worker's memory.
SPREAD = 1 << 21
SEGMENT_BYTES = 4 << 20
GAP = 64

INDEX = "doc_id array<bigint>, row_key array<bigint>, doc_at binary, terms binary, lists binary, low binary, high binary"
MATCH = "doc_id bigint, row_key bigint, item_id bigint, kind string, doc_pos int, item_pos int, n_words int"


def segment(w: tk.Words) -> tuple[np.ndarray, ...]:
    """(first position of each document, terms ascending, list offsets, positions)."""
    n = np.diff(w.off)
    doc_at = np.concatenate([[0], np.cumsum(n + GAP)]).astype(np.int32)
    pos = np.arange(len(w.hash), dtype=np.int64) + np.repeat(np.arange(len(n)) * GAP, n)
    order = np.argsort(w.hash, kind="stable")
    h = w.hash[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return doc_at, h[new], np.concatenate([new, [len(h)]]).astype(np.int32), pos[order].astype(np.int32)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of ``docs`` (doc_id, text), by segment."""
    session_of(docs)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches, limit=SEGMENT_BYTES):
                parts = list(tk.chunks([b]))
                ws = [tk.words(p.column(2)) for p in parts]
                off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.off) for x in ws]))])
                z = np.zeros(0, np.int64)
                doc_at, terms, lists, pos = segment(tk.Words(np.concatenate([x.hash for x in ws]), z, z, off, z, z))
                del ws
                row = [b.column(0).to_pylist(), b.column(1).to_pylist(), doc_at.tobytes(), terms.tobytes(), lists.tobytes(), (pos & 0xFFFF).astype(np.uint16).tobytes(), (pos >> 16).astype(np.uint16).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.int64())), pa.array([row[1]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[2:])], ["doc_id", "row_key", "doc_at", "terms", "lists", "low", "high"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(run, INDEX)


def row_key():
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))


class Phrases:
    """The test items: word hashes of all, one after the other, their phrases and windows."""

    def __init__(self, ids: list, texts: list):
        w = tk.words(pa.array(texts, pa.string()))
        n = np.diff(w.off)
        self.ids, self.off, self.hash = ids, w.off.astype(np.int64), w.hash
        self.vocabulary, self.word = np.unique(w.hash, return_inverse=True)
        self.word = self.word.astype(np.int32)
        size = np.minimum(n, PHRASE)
        each = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(n), dtype=np.int32), each)
        self.at = (np.repeat(self.off[:-1] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))).astype(np.int32)
        self.size = size[self.item].astype(np.int8)

    def rank(self, counts: np.ndarray, total: int) -> None:
        """Fix the order of intersection, rarest first, and the places of the windows, from
        the corpus counts of the vocabulary."""
        freq = counts[self.word]
        span = np.arange(PHRASE)
        inside = span[None, :] < self.size[:, None]
        f = np.where(inside, freq[np.minimum(self.at[:, None] + span, len(freq) - 1)] if len(freq) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(f, axis=1, kind="stable").astype(np.int8)
        p = np.maximum(counts / max(total, 1), FLOOR) * (2 * SLOP + 1)
        self.weight = np.maximum(0.0, -np.log(np.minimum(p, 1.0)))[self.word].astype(np.float32)
        # windows: every STRIDE words, the last one at the item's end
        n = np.diff(self.off)
        each = np.where(n > 1, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
        self.w_item = np.repeat(np.arange(len(n), dtype=np.int32), each)
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        size = np.minimum(n, WINDOW)[self.w_item]
        first = self.off[self.w_item] + np.minimum(k * STRIDE, n[self.w_item] - size)
        self.w_first, self.w_size = first.astype(np.int32), size.astype(np.int32)
        span = np.arange(WINDOW)
        f = np.where(span[None, :] < size[:, None], freq[np.minimum(first[:, None] + span, max(len(freq) - 1, 0))] if len(freq) else 0, np.iinfo(np.int64).max)
        rare = np.argsort(f, axis=1, kind="stable")[:, :RARE]
        kept = np.arange(RARE)[None, :] < np.minimum(size, RARE)[:, None]
        self.pick = (first[:, None] + rare)[kept].astype(np.int32)
        self.pick_window = np.repeat(np.arange(len(first), dtype=np.int32), kept.sum(1))
        m = np.bincount(self.pick_window, minlength=len(first))
        self.need = np.maximum(np.ceil(NEED * m), np.minimum(m, 2)).astype(np.int32)
        whole = np.bincount(self.pick_window, weights=self.weight[self.pick], minlength=len(first))
        self.bar = np.minimum(BAR, whole * (1 - 1e-6))


def _member(combined: np.ndarray, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
    key = (term.astype(np.int64) << 32) | pos
    i = np.minimum(np.searchsorted(combined, key), max(len(combined) - 1, 0))
    return (pos >= 0) & (combined[i] == key) if len(combined) else np.zeros(len(key), bool)


def _expand(lists: np.ndarray, pos: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of each term: (index into ``term``, position)."""
    n = lists[term + 1] - lists[term]
    who = np.repeat(np.arange(len(term)), n)
    at = np.repeat(lists[term].astype(np.int64) - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(term) else np.zeros(0, np.int64), n) + np.arange(int(n.sum()))
    return who, pos[at].astype(np.int64)


def search_segment(p: Phrases, doc_at: np.ndarray, terms: np.ndarray, lists: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """(document index, item index, kind, doc_pos, item_pos, n_words) in one segment."""
    if not len(p.hash) or not len(terms):
        return []
    i = np.minimum(np.searchsorted(terms, p.vocabulary), len(terms) - 1)
    known = np.where(terms[i] == p.vocabulary, i, -1)
    here = known[p.word]  # each test word's place in the dictionary
    used = known[known >= 0]
    u, upos = _expand(lists, pos, used)
    combined = (used[u].astype(np.int64) << 32) | upos  # ascending: by term, then position
    out = []

    def doc_of(x):
        return np.searchsorted(doc_at, x, "right") - 1

    # exact phrases: all words must be in the dictionary; then rarest first
    absent = np.concatenate([[0], np.cumsum(here < 0)])
    live = np.flatnonzero(absent[p.at + p.size] == absent[p.at])
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    got = []
    cost = np.cumsum(np.diff(lists)[here[p.at[live] + p.order[live, 0]]]) if len(live) else np.zeros(0)
    start_at = 0
    while start_at < len(live):  # so many postings at once
        stop_at = max(start_at + 1, int(np.searchsorted(cost, (cost[start_at - 1] if start_at else 0) + SPREAD, "right")))
        some, start_at = live[start_at:stop_at], stop_at
        who, where = _expand(lists, pos, here[p.at[some] + p.order[some, 0]])
        ph, start = some[who], where - p.order[some[who], 0]
        for r in range(1, PHRASE):
            if not len(ph):
                break
            offset = p.order[ph, r]
            on = r < p.size[ph]
            good = ~on
            t = here[p.at[ph[on]] + offset[on]]
            good[on] = _member(combined, t, start[on] + offset[on])
            ph, start = ph[good], start[good]
        if len(ph):
            got.append((ph, start))
    if got:
        ph, start = (np.concatenate(x) for x in zip(*got))
        item, item_pos = p.item[ph], p.at[ph] - p.off[p.item[ph]]
        order = np.lexsort((start, start - item_pos, item))
        item, item_pos, start, size = item[order], item_pos[order], start[order], p.size[ph][order].astype(np.int64)
        diag = start - item_pos
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (diag[1:] != diag[:-1]) | (start[1:] > start[:-1] + size[:-1])])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:], [len(item)]]) - 1
        d = doc_of(start[begin])
        for a, b, x in zip(begin, stop, d):
            runs.setdefault((int(x), int(item[a])), []).append((int(start[a]), int(start[b] + size[b])))
            out.append((int(x), int(item[a]), "exact", int(start[a] - doc_at[x]), int(item_pos[a]), int(start[b] + size[b] - start[a])))

    # proximity: windows with enough of their words in the dictionary, a block at a time
    present = here[p.pick] >= 0
    enough = np.bincount(p.pick_window[present], minlength=len(p.need)) >= p.need
    enough &= np.bincount(p.pick_window[present], weights=p.weight[p.pick[present]], minlength=len(p.need)) >= p.bar
    at = np.flatnonzero(present & enough[p.pick_window])
    of = p.pick_window[at]
    cost = np.cumsum(np.diff(lists)[here[p.pick[at]]]) if len(at) else np.zeros(0)
    near: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + SPREAD, "right")))
        if b < len(at):  # not within a window, unless it is the block's only one
            edge = int(np.searchsorted(of, of[b]))
            b = edge if edge > a else int(np.searchsorted(of, of[b], "right"))
        for d, k, start, end, ip, n in _near(p, at[a:b], here, lists, pos, doc_of):
            if not any(s < end and start < e for s, e in runs.get((d, k), ())):
                near.setdefault((d, k), []).append((start, end, ip, n))
        a = b
    for (d, k), hits in sorted(near.items()):
        hits.sort()
        merged: list[list[int]] = []
        for start, end, ip, n in hits:
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
                merged[-1][3] = max(n, merged[-1][3])
            else:
                merged.append([start, end, ip, n])
        out += [(d, k, "near", max(0, start - int(doc_at[d])), ip, n) for start, _, ip, n in merged]
    return out


def _near(p: Phrases, at: np.ndarray, here: np.ndarray, lists: np.ndarray, pos: np.ndarray, doc_of):
    """(document, item, start, end, place in the item, terms) of each window whose terms stand near their places."""
    who, where = _expand(lists, pos, here[p.pick[at]])
    window = p.pick_window[at[who]].astype(np.int64)
    start = where - (p.pick[at[who]] - p.w_first[window])  # where the window would begin
    key = (window << 33) + start + WINDOW  # never negative
    order = np.argsort(key, kind="stable")
    key, who, window, start, where = key[order], who[order], window[order], start[order], where[order]
    upto = np.searchsorted(key, key + 2 * SLOP, "right")
    free: tuple[int, int] = (-1, -1)
    for c in np.flatnonzero(upto - np.arange(len(key)) >= p.need[window]):
        w = int(window[c])
        if free[0] == w and start[c] < free[1]:
            continue
        seen = np.unique(who[c : upto[c]])
        if len(seen) < p.need[w] or p.weight[p.pick[at[seen]]].sum() < p.bar[w]:
            continue
        begin = int(start[c])
        free = (w, begin + 2 * SLOP + 1)
        # the document is that of the words that are there
        yield int(doc_of(where[c])), int(p.w_item[w]), begin, begin + int(p.w_size[w]), int(p.w_first[w] - p.off[p.w_item[w]]), len(seen)


def _unpack(index_row: dict):
    g = lambda k, t: np.frombuffer(index_row[k].as_py(), t)
    pos = g("low", np.uint16).astype(np.int32) | (g("high", np.uint16).astype(np.int32) << 16)
    return g("doc_at", np.int32), g("terms", np.uint64), g("lists", np.int32), pos


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences in the whole corpus of each term of ``vocabulary``, and of all words."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = sent.value
        total = np.zeros(len(v) + 1, np.int64)
        for b in batches:
            for t, l in zip(b.column(0), b.column(1)):
                terms, lists = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(l.as_py(), np.int32)
                n = np.diff(lists)
                total[-1] += int(lists[-1])
                if len(terms) and len(v):
                    i = np.minimum(np.searchsorted(terms, v), len(terms) - 1)
                    total[:-1] += np.where(terms[i] == v, n[i], 0)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["k", "n"])

    found = index.select("terms", "lists").mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts[:-1], int(counts[-1])


def _rounds(benchmark: DataFrame):
    """The test items, in parts of bounded size."""
    ids, texts, size = [], [], 0
    for r in benchmark.selectExpr("cast(item_id as bigint) item_id", "text").withColumn("n", F.regexp_count(F.col("text"), F.lit(tk.WORD_RE.replace("0-9a-z", "0-9A-Za-z")))).orderBy("item_id", "text").toLocalIterator():
        n = SENT_PER_WORD * ((r.n or 0) + 1)
        if ids and size + n > MAX_SENT:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield ids, texts


def search(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Exact phrase and proximity matches of ``benchmark`` (item_id, text)."""
    spark = session_of(index)
    found = []
    for ids, texts in _rounds(benchmark):
        with np.errstate(over="ignore"):
            p = Phrases(ids, texts)
        p.rank(*term_counts(index, p.vocabulary))
        sent = spark.sparkContext.broadcast(p)

        def run(batches, sent=sent):
            p = sent.value
            for b in batches:
                for i in range(b.num_rows):
                    row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
                    got = search_segment(p, *_unpack(row))
                    if got:
                        d = [g[0] for g in got]
                        ids, keys = row["doc_id"].values, row["row_key"].values
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(d)), keys.take(pa.array(d)), pa.array([p.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got])] + [pa.array([g[j] for g in got], pa.int32()) for j in (3, 4, 5)],
                            ["doc_id", "row_key", "item_id", "kind", "doc_pos", "item_pos", "n_words"],
                        )

        found.append(index.mapInArrow(run, MATCH))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCH)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(written(build_index(docs), "postings"), benchmark)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with no match of any kind, columns as they are."""
    (key,) = fresh(docs.columns, "__tm_key")
    bad = matches(docs, benchmark).select(F.col("row_key").alias(key)).distinct()
    bad = sent_if_small(written(bad, "contaminated"))
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*quoted(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
