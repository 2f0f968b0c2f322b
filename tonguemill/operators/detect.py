"""Detection: route by script, score what needs scoring.

One Arrow function routes a batch by its bytes and scores only what the route finds to be
Latin or Cyrillic. (As a native expression, for filters and SQL, the route is in
:mod:`functions.text`.) The table is broadcast: its size is fixed by
the model, not by the data. Nothing is shuffled, so the same columns work on a stream.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, scripts
from ..functions.features import FeatureConfig
from ..functions.langs import COLUMN_RANGE
from .model import Model

#: Texts whose words are looked at together; bounds a worker's memory.
BATCH_BYTES = 2 << 20
#: Words whose sums a worker holds (about 50 MB), and new ones whose keys are made at once (about 50 MB).
KNOWN, WORDS_AT_ONCE = 200_000, 16_384
DETECTION = "struct<lang string, confidence float, is_uncertain boolean>"


class Words:
    """Sums of a table's rows over the keys of words, and the words' hashes and numbers of keys.
    A word is looked at once, as long as no more than :data:`KNOWN` are held. Columns are
    added up one by one: a column stays in the cache, and sums of neighbours are fast."""

    def __init__(self, m: Model, table: np.ndarray):
        self.model, self.columns = m, np.ascontiguousarray(table.T)
        self.sums = np.zeros((len(self.columns), 0), self.columns.dtype)
        self.hash, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}

    def _room(self, n: int) -> None:
        """Places for ``n`` words. Arrays grow by doubling and stay when words are forgotten."""
        have = self.sums.shape[1]
        if n > have:
            size = max(n, min(2 * have, KNOWN), 1024)
            sums, hashes, sizes = np.zeros((len(self.columns), size), self.columns.dtype), np.zeros(size, np.uint64), np.zeros(size, np.int64)
            sums[:, :have], hashes[:have], sizes[:have] = self.sums, self.hash, self.size
            self.sums, self.hash, self.size = sums, hashes, sizes

    def index(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        number = self.number
        new = list(dict.fromkeys([w for w in words if w not in number]))
        if len(new) + len(self.number) > KNOWN and self.number:
            self._clear()
            new = list(dict.fromkeys(words))
        begin = len(self.number)
        self._room(begin + len(new))
        for i in range(0, len(new), WORDS_AT_ONCE):
            some = new[i : i + WORDS_AT_ONCE]
            t = features.word_table(some, FeatureConfig(self.model.n_min, self.model.n_max))
            ids = _rows(t.keys, self.model).astype(np.intp)
            at = slice(begin + i, begin + i + len(some))
            for k, c in enumerate(self.columns):
                self.sums[k, at] = np.add.reduceat(c[ids], t.off[:-1])
            self.hash[at], self.size[at] = t.hash, np.diff(t.off)
        self.number.update(zip(new, range(begin, begin + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def text_sums(texts: pa.Array, m: Model, table: np.ndarray, known: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums [texts, columns], tokens of each text). Rows of a distinct word are added up
    once, and with ``known`` once for all batches."""
    known = known or Words(m, table)
    index, off, distinct = features.split(texts)
    n, c = len(off) - 1, len(known.columns)
    kind = np.float64 if table.dtype.kind == "f" else table.dtype
    if not len(index):
        return np.zeros((n, c), kind), np.zeros(n, np.int64)
    index = known.index(distinct)[index]
    words = np.diff(off)
    full = np.flatnonzero(words)
    begin = off[:-1][full]
    first = np.zeros(len(index), bool)
    first[begin] = True
    pair = np.flatnonzero(~first)
    ids = _rows(features.pair_keys(known.hash[index[pair - 1]], known.hash[index[pair]]), m).astype(np.intp)
    some = np.flatnonzero(words > 1)
    pair_begin = (np.cumsum(words[some] - 1) - (words[some] - 1)) if len(some) else some
    sums = np.zeros((c, n), kind)
    for k, column in enumerate(known.columns):
        sums[k, full] = np.add.reduceat(known.sums[k][index], begin, dtype=kind)
        if len(some):
            sums[k, some] += np.add.reduceat(column[ids], pair_begin, dtype=kind)
    count = np.zeros(n, np.int64)
    count[full] = np.add.reduceat(known.size[index] + ~first, begin)
    return np.ascontiguousarray(sums.T), count


_KNOWN: dict[int, Words] = {}


def known_words(key: int, m: Model, table: np.ndarray) -> Words:
    """This worker's words for the model that was sent as ``key``; one model's at a time."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Words(m, table)
    return _KNOWN[key]


def _rows(keys: np.ndarray, m: Model) -> np.ndarray:
    b, neg = features.hashing.buckets(keys, m.log2_d, m.hash, m.seed)
    return np.where(neg, b + m.num_buckets + 1, b)


def read_out(sums: np.ndarray, count: np.ndarray, bias: np.ndarray, last_wins: bool = True, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best column, its softmax) of mean-pooled sums plus bias."""
    logits = sums.astype(np.float64) / np.maximum(count, 1)[:, None] + bias
    if allowed is not None:
        logits = np.where(allowed, logits, -np.inf)
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    best = p.shape[1] - 1 - p[:, ::-1].argmax(1) if last_wins else p.argmax(1)
    return best, p[np.arange(len(p)), best]


def _slices(arr: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield arr.slice(i, j - i)
        i = j


def _detected(texts: pa.Array, m: Model, known: Words, restrict_to_group: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language or None, confidence, whether it is uncertain) of each text."""
    names = np.array(m.languages, object)
    all_lang, all_conf, all_unsure = np.empty(len(texts), object), np.empty(len(texts), np.float32), np.empty(len(texts), bool)
    at = 0
    for piece in _slices(texts):
        route = scripts.routes(piece)
        lang, conf, unsure = (x[at : at + len(piece)] for x in (all_lang, all_conf, all_unsure))
        at += len(piece)
        lang[:] = np.array([None, None, None, *scripts.DIRECT], object)[route]
        conf[:], unsure[:] = np.where(route < 3, 0.0, 1.0), route < 3
        rows = np.flatnonzero((route == scripts.LATIN) | (route == scripts.CYRILLIC))
        if not len(rows):
            continue
        sums, count = text_sums(piece if len(rows) == len(piece) else piece.take(pa.array(rows)), m, known.columns.T, known)
        allowed = None
        if restrict_to_group:
            col = np.arange(len(known.columns))
            span = np.array([COLUMN_RANGE["Latin" if r == scripts.LATIN else "Cyrillic"] for r in route[rows]])
            allowed = (col >= span[:, :1]) & (col < span[:, 1:])
        best, p = read_out(sums, count, m.bias, allowed=allowed)
        lang[rows], conf[rows] = names[best], p
        unsure[rows] = conf[rows] < np.float32(m.theta)
    return all_lang, all_conf, all_unsure


def detect_batch(texts: list[str], m: Model, max_batch: int | None = None, known: Words | None = None) -> list[dict]:
    """Detection of a few texts in this process: lang (None if undetermined), confidence, is_uncertain.
    More than ``max_batch`` texts are an error."""
    if max_batch is not None and len(texts) > max_batch:
        raise ValueError(f"{len(texts)} texts; a batch has {max_batch} at most")
    found = _detected(pa.array(texts, pa.string()), m, known or Words(m, m.doubled()), False)
    return [{"lang": a, "confidence": float(b), "is_uncertain": bool(c)} for a, b, c in zip(*found)]


def detection(spark: SparkSession, m: Model, column: Column | str = "text", restrict_to_group: bool = False) -> Column:
    """struct(lang, confidence, is_uncertain) of a text; lang is null if undetermined.

    The best of all thirty columns wins, the last of equals. With
    ``restrict_to_group``, only the columns of the routed script are compared.
    """
    t = F.col(column) if isinstance(column, str) else column
    sent, key = spark.sparkContext.broadcast(m), random.getrandbits(62)

    @F.arrow_udf(DETECTION)
    def detect(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        known = known_words(key, m, m.doubled())
        for texts in parts:
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(_detected(texts, m, known, restrict_to_group), (pa.string(), pa.float32(), pa.bool_()))], ["lang", "confidence", "is_uncertain"])

    return detect(t).alias("detection")


def detect(df: DataFrame, m: Model, column: str = "text", **options) -> DataFrame:
    """``df`` with lang_detected, confidence, is_uncertain."""
    d = df.withColumn("__d", detection(df.sparkSession, m, column, **options))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__d.lang").alias("lang_detected"), F.col("__d.confidence").alias("confidence"), F.col("__d.is_uncertain").alias("is_uncertain"))


def judge(spark: SparkSession, m: Model, column: Column | str = "text", max_chars: int | None = 1200, min_tokens: int = 8) -> Column:
    """struct(pred, conf): the verdict of a judge, without routing; the first of equals
    wins, and a text of fewer than ``min_tokens`` tokens gets null."""
    t = F.col(column) if isinstance(column, str) else column
    sent, key = spark.sparkContext.broadcast(m), random.getrandbits(62)

    @F.arrow_udf("struct<pred string, conf double>")
    def verdict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        table = m.doubled()
        known = known_words(key, m, table)
        for texts in parts:
            pred: list = []
            conf = [np.zeros(0)]
            for piece in _slices(texts):
                sums, count = text_sums(piece, m, table, known)
                best, p = read_out(sums, count, m.bias, last_wins=False)
                pred += [m.languages[b] if n >= max(min_tokens, 1) else None for b, n in zip(best, count)]
                conf.append(p)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.concatenate(conf))], ["pred", "conf"])

    return verdict(F.substring(t, 1, max_chars) if max_chars else t)


def votes(spark: SparkSession, m: Model, column: Column | str = "text") -> Column:
    """The judge's verdict on the first 400 characters, with no minimum."""
    return judge(spark, m, column, max_chars=400, min_tokens=0)["pred"]


def token_ids(df: DataFrame, m: Model, column: str = "text", k: int | None = None) -> DataFrame:
    """``df`` with ``ids``: the rows of the doubled table that each text adds up."""
    log2_d, which, seed, cfg = m.log2_d, m.hash, m.seed, FeatureConfig(m.n_min, m.n_max)

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = [pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))]
            for piece in _slices(texts):
                x, off = features.signed_ids(piece, log2_d, which, seed, cfg, k)
                out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x)))
            yield pa.concat_arrays(out)

    return df.withColumn("ids", ids(F.col(column)))


def token_numbers(column: Column | str = "text") -> Column:
    """The number of feature keys of a text at n = 1..5, as :func:`functions.text.token_count` has it: each
    distinct word of a piece is looked at once."""
    t = F.col(column) if isinstance(column, str) else column

    @F.arrow_udf("bigint")
    def numbers(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = [np.zeros(0, np.int64)]
            for piece in _slices(texts):
                index, off, distinct = features.split(piece)
                n = features.word_lengths(distinct)
                keys = np.where(n == 1, 7, np.where(n == 2, 11, 5 * n + 1))
                total = np.concatenate([[0], np.cumsum(keys[index])])
                out.append(np.diff(total[off]) + np.maximum(np.diff(off) - 1, 0))
            yield pa.array(np.concatenate(out))

    return numbers(t)


def table_frame(spark: SparkSession, m: Model) -> DataFrame:
    """The doubled table as rows (id, w)."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(m.doubled().astype(float).tolist())], "id int, w array<double>")


def scores_by_join(df: DataFrame, m: Model, key: str, column: str = "text") -> DataFrame:
    """(key, n_tokens, sums) by joining counted ids with the table: the relational
    form of scoring, with partial aggregation before the shuffle."""
    counted = token_ids(df.select(F.col(key).alias("__key"), F.col(column).alias("text")), m).select("__key", F.explode("ids").alias("id")).groupBy("__key", "id").agg(F.count(F.lit(1)).alias("c"))
    joined = counted.join(table_frame(df.sparkSession, m), "id")
    n = len(m.languages)
    return joined.groupBy(F.col("__key").alias(key)).agg(F.sum("c").alias("n_tokens"), F.array(*[F.sum(F.col("c") * F.col("w")[i]) for i in range(n)]).alias("sums"))


def detection_line(lang: Column, confidence: Column, uncertain: Column, as_json: bool = False) -> Column:
    """What the command line prints: a bare code, or JSON."""
    from ..functions.langs import lookup

    if not as_json:
        return F.coalesce(lang, F.lit("und"))
    return F.to_json(F.struct(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(lookup(lang, "name"), F.lit("Undetermined")).alias("name"), confidence.alias("confidence"), uncertain.alias("uncertain")))


def register(spark: SparkSession, m: Model | None = None) -> None:
    """SQL functions: route_script, classify_word, token_keys, feature_buckets, and
    detect_language where a model is given."""
    @F.pandas_udf("string")
    def route_script(t: pd.Series) -> pd.Series:
        from ..functions.scripts import route

        return t.map(route)

    @F.pandas_udf("string")
    def classify(w: pd.Series) -> pd.Series:
        return w.map(lambda x: None if x is None else features.classify_word(x))

    @F.arrow_udf("array<bigint>")
    def keys(t: pa.Array) -> pa.Array:
        k, off = features.text_keys(t)
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(k.view(np.int64)))

    @F.arrow_udf("array<int>")
    def feature_buckets(t: pa.Array) -> pa.Array:
        x, off = features.signed_ids(t, 17)
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x))

    for name, f in (("route_script", route_script), ("classify_word", classify), ("token_keys", keys), ("feature_buckets", feature_buckets)):
        spark.udf.register(name, f)
    if m is not None:
        sent = spark.sparkContext.broadcast(m)

        @F.pandas_udf("string")
        def detect_language(t: pd.Series) -> pd.Series:
            from ..functions.scripts import route

            m = sent.value
            r = t.map(route)
            out = r.where(~r.isin(["latin", "cyrillic", "unknown"]), None)
            todo = r.isin(["latin", "cyrillic"])
            if todo.any():
                sums, count = text_sums(pa.array(t[todo], pa.string()), m, m.doubled())
                out[todo] = np.array(m.languages, object)[read_out(sums, count, m.bias)[0]]
            return out

        spark.udf.register("detect_language", detect_language)
