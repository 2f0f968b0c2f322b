"""Training the folded table.

Two trainers. :func:`train_logistic` fits multinomial logistic regression on hashed
features (MLlib, distributed): its coefficients are the table. :func:`train_counts` makes a table from
counts alone: the log-odds of each bucket in each language, from one scan with partial
sums in every task; it needs no iteration and suits any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..functions.langs import CODES
from . import metrics
from .detect import _slices, judge, token_ids
from .mix import balanced_sample
from .model import Model, dequantize, parse_store, quantize, save


def signed_counts(rows: DataFrame, log2_d: int) -> DataFrame:
    """(lang, bucket, n): signed occurrences of each bucket in each language. Every task
    sends one row for each bucket and language it saw."""
    d = 1 << log2_d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            at = 0
            for piece in _slices(b.column(1)):
                part = langs[at : at + len(piece)]
                at += len(piece)
                e = features.encode(piece)
                bucket, neg = features.hashing.buckets(e.table.keys, log2_d)
                sign, size = np.where(neg, -1.0, 1.0), np.diff(e.table.off)
                owner = np.repeat(np.arange(len(piece)), np.diff(e.off))
                second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
                pair, pair_neg = features.hashing.buckets(features.pair_keys(e.table.hash[e.index[second - 1]], e.table.hash[e.index[second]]), log2_d)
                for lang in set(part) - {None}:
                    mine = (part == lang)[owner]
                    t = total.setdefault(lang, np.zeros(d, np.int64))
                    often = np.bincount(e.index[mine], minlength=len(size))  # a distinct word's keys count once
                    sums = np.bincount(bucket, weights=sign * np.repeat(often, size), minlength=d)
                    sums += np.bincount(pair, weights=np.where(pair_neg, -1.0, 1.0) * mine[second], minlength=d)
                    t += np.rint(sums).astype(np.int64)
        for lang, t in total.items():
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int32)), pa.array(t[k])], ["lang", "bucket", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train_counts(rows: DataFrame, log2_d: int = 12, scale: float = 30.0) -> Model:
    """A table of centred mean signed counts, from (lang, text)."""
    d = 1 << log2_d
    p = np.zeros((d + 1, len(CODES)), np.float64)
    for r in signed_counts(rows, log2_d).toLocalIterator():
        if r.lang in CODES:
            p[r.bucket, CODES.index(r.lang)] = r.n
    size = np.sqrt((p**2).sum(0))
    seen = size > 0
    p[:, seen] /= size[seen]
    p[:, seen] -= p[:, seen].mean(1, keepdims=True)
    bias = np.where(seen, 0.0, -1e4)
    norm = np.abs(p).max() or 1.0
    return Model(p / norm * scale * 10, bias, log2_d)


def train_logistic(rows: DataFrame, log2_d: int = 12, per_lang_cap: int = 50_000, k: int | None = 256, iterations: int = 40, l2: float = 1e-4, seed: int = 42) -> Model:
    """Multinomial logistic regression on (lang, text); the folded table is its
    coefficient matrix. Languages that don't occur get a bias that never wins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT, Vectors

    d = 1 << log2_d
    present = sorted((r.lang for r in rows.select("lang").distinct().collect() if r.lang in CODES), key=CODES.index)
    if len(present) < 2:
        raise ValueError("two languages or more are needed")
    empty = Model(np.zeros((d + 1, len(CODES))), np.zeros(len(CODES)), log2_d)
    ids = token_ids(balanced_sample(rows.where(F.col("lang").isin(present)), per_lang_cap, seed), empty, k=k)

    @F.udf(VectorUDT())
    def vector(x):
        a = np.asarray(x, np.int64)
        neg = a > d
        b, at = np.unique(np.where(neg, a - d - 1, a), return_inverse=True)
        return Vectors.sparse(d, b.tolist(), np.bincount(at, weights=np.where(neg, -1.0, 1.0) / max(len(a), 1)).tolist())

    label = F.create_map(*[F.lit(x) for i, c in enumerate(present) for x in (c, float(i))])[F.col("lang")]
    fit = LogisticRegression(family="multinomial", maxIter=iterations, regParam=l2, standardization=False).fit(ids.where(F.size("ids") > 0).select(label.alias("label"), vector("ids").alias("features")))
    p, bias = np.zeros((d + 1, len(CODES))), np.full(len(CODES), -1e4)
    at = [CODES.index(c) for c in present]
    p[:d, at] = fit.coefficientMatrix.toArray().T
    bias[at] = fit.interceptVector.toArray()
    return Model(p, bias, log2_d)


def evaluate(rows: DataFrame, m: Model, min_tokens: int = 1) -> DataFrame:
    """(gold, pred, conf, text) by the table alone, without routing."""
    j = judge(rows.sparkSession, m, "text", max_chars=None, min_tokens=min_tokens)
    return rows.select(F.col("lang").alias("gold"), j.alias("j"), "text").select("gold", "j.pred", "j.conf", "text")


def table_accuracy(rows: DataFrame, m: Model) -> float:
    return evaluate(rows, m).agg(F.avg(F.col("gold").eqNullSafe(F.col("pred")).cast("double"))).first()[0]


def calibrate(rows: DataFrame, m: Model) -> Model:
    """``m`` with the threshold below which 5 % of the confidences on ``rows`` lie."""
    m.theta = float(metrics.theta(evaluate(rows, m), "conf").first()[0] or 0.0)
    return m


def export(m: Model, path: str, val: DataFrame, store: str = "f16", max_drop_points: float = 0.2) -> dict:
    """Save, unless quantisation costs more accuracy on ``val`` than allowed."""
    kind, scheme = parse_store(store)
    stored, scales = quantize(m.p, kind, scheme)
    lossy = Model(dequantize(stored, scales, kind, scheme), m.bias, m.log2_d, m.theta)
    before, after = table_accuracy(val, m), table_accuracy(val, lossy)
    if (before - after) * 100 > max_drop_points:
        raise ValueError(f"{store} loses {(before - after) * 100:.2f} points; {max_drop_points} are allowed")
    return save(m, path, store) | {"accuracy": before, "accuracy_stored": after}


#: Distinct keys that a task holds before it sends them on (three times 8 bytes each while they are sorted).
HELD_KEYS = 2 << 20
#: Ranges of keys that are told apart at once; a range is in memory as a whole (8 bytes a key).
RANGES = 4096
#: Keys are multiplied by an odd number, so that all ranges are alike, and divided by it again.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    """Sorted, each once."""
    x = np.concatenate(keys) if len(keys) > 1 else keys[0].copy()
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _text_keys(texts: pa.Array) -> list[np.ndarray]:
    """Keys of a piece's distinct words, and of its pairs."""
    e = features.encode(texts)
    owner = np.repeat(np.arange(len(e.off) - 1), np.diff(e.off))
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return [e.table.keys, features.pair_keys(e.table.hash[e.index[second - 1]], e.table.hash[e.index[second]])]


def packed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, keys): the keys of texts by range, as 8-byte numbers; repeated ones mostly once for each task."""
    edges = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)

    def packed(held: np.ndarray) -> pa.RecordBatch:
        at = np.concatenate([[0], np.searchsorted(held, edges), [len(held)]])
        some = np.flatnonzero(np.diff(at))
        body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.append(at[some], len(held)) * 8).astype(np.int32)), pa.py_buffer(held)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), body], ["part", "keys"])

    held = np.zeros(0, np.uint64)
    for b in batches:
        for piece in _slices(b.column(0)):
            with np.errstate(over="ignore"):
                held = _distinct([held, *(k * _SPREAD for k in _text_keys(piece))])
            if len(held) >= HELD_KEYS:
                yield packed(held)
                held = held[:0]
    if len(held):
        yield packed(held)


def hash_spreads(rows: DataFrame, log2_d: int, names: tuple[str, ...] = features.hashing.HASHES) -> dict[str, float]:
    """Chi-square by degree of freedom of distinct keys over buckets, empty ones included, of
    several hashes in one scan. Keys travel as packed numbers, and one range of them is told apart at a time."""
    d = 1 << log2_d

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {w: np.zeros(d, np.int64) for w in names}

        def add(parts: list[np.ndarray]) -> None:
            if parts:
                with np.errstate(over="ignore"):
                    keys = _distinct(parts) * _BACK
                for w, t in total.items():
                    t += np.bincount(features.hashing.buckets(keys, log2_d, w)[0], minlength=d)

        now, held = -1, []
        for b in batches:
            for part, keys in zip(b.column(0).to_pylist(), b.column(1)):
                if part != now:
                    add(held)
                    now, held = part, []
                held.append(np.frombuffer(keys.as_py(), np.uint64))
        add(held)
        for w, t in total.items():
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([w] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(t[k])], ["hash", "bucket", "o"])

    parts = rows.select("text").mapInArrow(packed_keys, "part int, keys binary").repartition("part").sortWithinPartitions("part")
    o = parts.mapInArrow(count, "hash string, bucket int, o bigint").groupBy("hash", "bucket").agg(F.sum("o").alias("o"))
    got = {r.hash: r for r in o.groupBy("hash").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("s")).collect()}
    return {w: (got[w].s / (got[w].n / d) - got[w].n) / (d - 1) if w in got else 0.0 for w in names}


def hash_spread(rows: DataFrame, log2_d: int, which: str = "fmix32") -> float:
    """Chi-square by degree of freedom of one hash."""
    return hash_spreads(rows, log2_d, (which,))[which]
