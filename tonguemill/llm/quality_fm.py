"""Quality classifier: a factorisation machine.

Features of a document, all binary: its distinct words, hashed; a bucket of each
of a few structure statistics; its ``lang``, ``source`` and length class. The score is

    w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2]

where the bracket gives all pairwise interactions <v_i, v_j> in time linear in
the features. Trained on ``labels``: a document is to be kept if its quality is 1
and it is not toxic. Training uses at most :data:`TRAIN_ROWS` labelled documents,
those whose hash is smallest. Labels are noisy and most words are rare: a group lasso over
each feature's weight and factors, all features of the sample taking part from the start,
takes those that don't matter to zero. The scan that scores is one pass without shuffle; the
weights (about 5 MB, fixed by LOG_DIM and RANK) are broadcast.

Nulls and odd input: a null text counts as empty (no words; its statistics are
those of an empty text); a null lang or source, or a table without that column, is a value of its
own; very long texts are scored whole; equal rows get equal scores; a score of just the
threshold is kept; label rows with nulls or without a document aren't used, and
repeated labels of a document count once each (of equal documents the majority, ties for
keeping); with no usable labels, or labels of one kind only, everything is kept (score = the
prior, or 0.5); an empty table gives an empty one; other columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .tables import session_of, table

#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 20_000
LOG_DIM, RANK, L2, RATE = 18, 4, 1e-4, 0.05
#: Strength of the group lasso, against a mean loss, so that it is the same at every size of the
#: sample; steps with it, and steps after it on the features that it leaves.
LASSO, STEPS, REFIT = 5e-3, 60, 80
THRESHOLD = 0.5
_SEED = 7

_CLASSES = {"digit": b"0123456789", "upper": bytes(range(65, 91)), "mark": b"!*%&$#@^~", "bar": b"|", "stop": b".,;:?", "line": b"\n"}
_LUT = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES.values()):
    _LUT[list(_c)] = _i + 1


def _stat_features(raw: pa.Array, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of structure statistics: (document, 64-bit feature)."""
    data, off = tk.buffers(raw)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    kind = _LUT[data]
    at = np.flatnonzero(kind)
    doc_of = np.searchsorted(off, at, "right") - 1
    shares = np.bincount(doc_of * 8 + kind[at], minlength=n * 8).reshape(n, 8)[:, 1:7] / size[:, None]
    count = np.diff(w.off)
    doc = w.doc
    same = np.zeros(len(w.hash), bool)
    if len(w.hash) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    many = np.maximum(count, 1)
    again = np.bincount(doc[same], minlength=n) / many
    order = np.lexsort((w.hash, doc))
    sh, sd = w.hash[order], doc[order]
    new = np.ones(len(sh), bool)
    if len(sh) > 1:
        new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    distinct = np.bincount(sd[new], minlength=n) / many
    mean_len = np.bincount(doc, weights=(w.end - w.start).astype(float), minlength=n) / many
    logs = lambda x: np.floor(np.log2(x + 2.0**-12) * 1).astype(np.int64)
    cols = [logs(shares[:, j]) for j in range(6)] + [logs(again), np.floor(distinct * 10).astype(np.int64), np.minimum(mean_len, 30).astype(np.int64), np.floor(np.log2(count + 1.0)).astype(np.int64)]
    feats = np.concatenate([tk.mix64(c.astype(np.int64).view(np.uint64) + np.uint64((j + 1) << 40)) for j, c in enumerate(cols)])
    return np.tile(np.arange(n), len(cols)), feats


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (document, bucket) pairs, sorted, and the number of documents."""
    w = tk.words(text)
    n = len(w.off) - 1
    docs, feats = [w.doc], [w.hash]
    d, f = _stat_features(text, w)
    docs.append(d)
    feats.append(f)
    for salt, column in ((101, lang), (102, source)):
        values = column.to_pylist()
        known = {v: tk.mix64(np.array([tk.hash_word(f"{salt}:{v}" if v is not None else f"{salt}")], np.uint64))[0] for v in set(values)}
        docs.append(np.arange(n))
        feats.append(np.array([known[v] for v in values], np.uint64))
    bucket = (np.concatenate(feats) >> np.uint64(64 - LOG_DIM)).astype(np.int64)
    key = np.unique((np.concatenate(docs).astype(np.int64) << LOG_DIM) | bucket)
    return key >> LOG_DIM, key & ((1 << LOG_DIM) - 1), n


class Model:
    """w0, w[DIM], v[DIM, RANK]; only features with a weight are ``active``."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, active: np.ndarray):
        self.w0, self.w, self.v, self.active = float(w0), w.astype(np.float32), v.astype(np.float32), active

    def margin(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        keep = self.active[bucket]
        doc, bucket = doc[keep], bucket[keep]
        out = self.w0 + np.bincount(doc, weights=self.w[bucket], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[bucket, f].astype(np.float64)
            out += 0.5 * (np.bincount(doc, weights=x, minlength=n) ** 2 - np.bincount(doc, weights=x * x, minlength=n))
        return out

    def probability(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(doc, bucket, n), -40, 40)))


class _Sparse:
    """Binary rows of features, by row and by feature. Sums over rows skip the features whose values
    are all zero, which add nothing: they are left out once half of what is looked at has become so.
    Sums are made a block at a time, so that the driver holds places (of 32 bits) only."""

    BLOCK = 1 << 18

    def __init__(self, x: np.ndarray, size: np.ndarray, dim: int):
        self.n, self.dim = len(size), dim
        self.whole = self.x, self.size = x, size
        self.held = np.ones(dim, bool)  # the features in x
        self.each = np.bincount(x, minlength=dim)
        self.row_by_x = self._owners(size)[np.argsort(x, kind="stable")]
        self.pool = ThreadPoolExecutor(RANK + 2)

    def _owners(self, size: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), size)

    def _sums(self, values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(size)), np.flatnonzero(size)
        end = np.cumsum(size[some])
        i = done = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(end, done + self.BLOCK, "right")))
            begin = np.concatenate([[0], end[i : j - 1] - done])
            out[some[i:j]] = np.add.reduceat(values.take(at[done : end[j - 1]]), begin)
            i, done = j, int(end[j - 1])
        return out

    def rows(self, columns: list[np.ndarray]) -> np.ndarray:
        """For each row, the sums of its features' values."""
        on = np.logical_or.reduce([c != 0 for c in columns])
        if 2 * self.each[on].sum() < len(self.x) or (on & ~self.held).any():  # few are left, or some are back
            x, size = self.whole
            keep = on[x]
            self.x, self.size, self.held = x[keep], np.bincount(self._owners(size)[keep], minlength=self.n), on
        return np.stack(list(self.pool.map(lambda c: self._sums(c, self.x, self.size), columns)))

    def features(self, columns: list[np.ndarray]) -> np.ndarray:
        """For each feature, the sums of its rows' values."""
        return np.stack(list(self.pool.map(lambda c: self._sums(c, self.row_by_x, self.each), columns)))


def _descend(at: _Sparse, y: np.ndarray, weight: np.ndarray, p: np.ndarray, w0: float, steps: int, lasso: float) -> tuple[np.ndarray, float]:
    """Adam on the whole batch, p[0] the weights and p[1:] the factors; with ``lasso``, each
    feature's vector shrinks as a group after each step."""
    mom, var, b0 = np.zeros_like(p), np.zeros_like(p), 0.0
    for t in range(1, steps + 1):
        *s, squares = at.rows([*p, (p[1:] ** 2).sum(0)])
        z = w0 + s[0] + 0.5 * (np.sum(np.square(s[1:]), axis=0) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = at.features([g, *(g * c for c in s[1:])])
        grad[1:] -= p[1:] * grad[0]
        grad += L2 * p
        mom, var, b0 = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2, 0.9 * b0 + 0.1 * g.sum()
        rate = RATE * min(1.0, 2 * (steps - t + 1) / steps)
        step = rate / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        p = p - step * mom / (1 - 0.9**t)
        if lasso:
            p *= np.maximum(0, 1 - lasso * step[0] / np.maximum(np.sqrt((p**2).sum(0)), 1e-12))
        w0 -= rate * b0
    at.pool.shutdown()
    return p, w0


def _digest(x: np.ndarray) -> bytes:
    return blake2b(np.ascontiguousarray(x), digest_size=16).digest()


def fit(rows: list[tuple[np.ndarray, int]], seed: int = _SEED) -> Model:
    """Fit to (buckets, 0/1) rows. The loss weighs both labels alike."""
    dim = 1 << LOG_DIM
    alike: dict[bytes, list[int]] = {}
    for i, r in enumerate(rows):  # copies of a document count as one, by majority
        alike.setdefault(_digest(r[0]), []).append(i)
    votes = [(rows[i[0]][0], int(2 * sum(rows[k][1] for k in i) >= len(i))) for i in alike.values()]
    y = np.array([v[1] for v in votes], float)
    model = Model(0.0, np.zeros(dim), np.zeros((dim, RANK)), np.zeros(dim, bool))
    if len(y) == 0:
        return model
    if y.min() == y.max():
        model.w0 = 40.0
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    size = np.array([len(v[0]) for v in votes])
    x = np.concatenate([v[0] for v in votes]).astype(np.int32)
    number = np.zeros(dim, np.int32)
    number[x] = 1
    ids = np.flatnonzero(number)
    number[ids] = np.arange(len(ids))
    x = number[x]
    rng = np.random.default_rng(seed)
    p = np.concatenate([np.zeros((1, len(ids))), rng.normal(0, 0.2, (RANK, len(ids)))])
    p, w0 = _descend(_Sparse(x, size, len(ids)), y, weight, p, 0.0, STEPS, LASSO)
    on = np.flatnonzero((p**2).sum(0) > 0)  # what the lasso leaves is fitted again without it
    number = np.full(len(ids), -1, np.int32)
    number[on] = np.arange(len(on))
    left = number[x] >= 0
    size = np.bincount(np.repeat(np.arange(len(size), dtype=np.int32), size)[left], minlength=len(size))
    p, w0 = _descend(_Sparse(number[x[left]], size, len(on)), y, weight, p[:, on], w0, REFIT, 0.0)
    w, v, active = np.zeros(dim), np.zeros((dim, RANK)), np.zeros(dim, bool)
    w[ids[on]], v[ids[on]], active[ids[on]] = p[0], p[1:].T, True
    return Model(w0, w, v, active)


def _columns(docs: DataFrame) -> list:
    return [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "lang", "source")]


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features and targets of the bounded labelled sample."""
    session_of(docs)
    picked = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .selectExpr("cast(doc_id as bigint) __tm_id", "cast(quality = 1 and toxic = 0 as int) __tm_y")
        .withColumn("__tm_h", F.xxhash64("__tm_id"))
        .orderBy("__tm_h", "__tm_id", "__tm_y")
        .limit(limit)
    )
    t, lang, source = _columns(docs)
    # the sample is bounded by `limit` rows of two numbers, so it may be broadcast
    joined = docs.select(F.col("doc_id").cast("bigint").alias("__tm_id"), t.alias("text"), lang.alias("lang"), source.alias("source")).join(F.broadcast(picked.drop("__tm_h")), "__tm_id")

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                doc, bucket, n = features(b.column(1), b.column(2), b.column(3))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(4)], ["id", "x", "y"])

    got = joined.select("__tm_id", "text", "lang", "source", "__tm_y").mapInArrow(run, "id bigint, x array<int>, y int").toArrow()
    out = [(r, x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32), y) for r, x, y in zip(got.column("id").to_pylist(), got.column("x"), got.column("y").to_pylist())]
    out.sort(key=lambda r: (r[0], r[2], _digest(r[1])))
    return [(x, y) for _, x, y in out]


def scorer(docs: DataFrame, model: Model):
    """A Column with the probability that a document is to be kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = sent.value
        with np.errstate(over="ignore"):
            for text, lang, source in parts:
                batch = pa.RecordBatch.from_arrays([text, lang, source], ["text", "lang", "source"])
                out = [np.zeros(0)]
                for b in tk.chunks([batch]):
                    out.append(m.probability(*features(b.column(0), b.column(1), b.column(2))))
                yield pa.array(np.concatenate(out))

    return score.asNondeterministic()(*_columns(docs))  # else it is run again for the filter


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model keeps, columns as they are."""
    session_of(docs)
    return docs.where(scorer(docs, model) >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", F.round(scorer(docs, model), 6).alias("score")).where(F.col("score") >= THRESHOLD)
