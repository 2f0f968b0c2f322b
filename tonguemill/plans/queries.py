"""Registered queries: each applies operators to whole tables. Most have SQL."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fragments, langs, scripts
from ..functions import text as tx
from ..operators import detect as dt
from ..operators import hygiene, metrics, mix, select, train
from ..operators.model import Model, damage, quantize
from ..plans.sweep import sentence_rows, sweep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over the cores where it is one file that can't be split; a
    table of many files is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores // 2 else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labeled samples (lang, text, _src, _pos)."""
    return _docs(spark, sf_dir).select(langs.from_iso1(F.col("lang")).alias("lang"), "text", F.substring("source", 4, 9).cast("int").alias("_src"), F.col("doc_id").alias("_pos"))


S = tx.SPACE
P = tx.PY_SPACE
_ISO = " ".join(f"WHEN '{l.iso1}' THEN '{l.iso3}'" for l in langs.ALL if l.iso1)
_LANG = f"CASE lang {_ISO} END"
_SAMPLES = f"(SELECT {_LANG} AS lang, text, substr(source, 4)::INTEGER AS _src, doc_id AS _pos FROM documents)"


def _n(inside: str, t: str = "text") -> str:
    return f"length(regexp_replace({t}, '[^{inside}]+', '', 'g'))"


def _words(t: str = "text") -> str:
    return f"list_filter(string_split_regex(coalesce({t}, ''), '[{S}]+'), lambda w: w <> '')"


_RETAINED = f"list_filter(list_transform({_words()}, lambda w: regexp_replace(w, '^#', '')), lambda w: w <> '')"
_DOMAIN = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


def _class(w: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({w}, '^[^\x00-\x7F]') THEN 'word' WHEN regexp_matches({w}, '(?s)^@.+') THEN 'mention' WHEN regexp_matches({w}, '^(?i:https?://|www\.)') THEN 'url' "
        rf"WHEN regexp_matches({w}, '^[A-Za-z0-9._%+-]+@{_DOMAIN}$') THEN 'email' WHEN regexp_matches({w}, '^[\x00-\x7F]*$') AND regexp_matches({w}, '[0-9]') THEN 'num' WHEN regexp_matches({w}, '^{_DOMAIN}$') THEN 'url' ELSE 'word' END"
    )


def _route() -> str:
    l, c, h = (_n(tx.SCRIPTS[s]) for s in ("Latin", "Cyrillic", "Han"))
    has = lambda s: f"regexp_matches(text, '[{tx.SCRIPTS[s]}]')"
    return f"CASE WHEN {has('Kana')} THEN 'direct:jpn' WHEN {h} > 0 AND {h} >= {l} AND {h} >= {c} THEN 'direct:cmn' WHEN {c} > 0 AND {c} >= {l} THEN 'cyrillic' WHEN {l} > 0 THEN 'latin' WHEN {has('Devanagari')} THEN 'direct:hin' WHEN {has('Arabic')} THEN 'direct:ara' ELSE 'unknown' END"


@_query("route_documents", f"SELECT doc_id, split_part(r, ':', 1) AS route, nullif(split_part(r, ':', 2), '') AS direct_lang FROM (SELECT doc_id, {_route()} AS r FROM documents)")
def route_documents(spark, sf_dir):
    r = tx.route("text")
    return _docs(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.route", "r.direct_lang")


@_query("route_histogram", f"SELECT split_part(r, ':', 1) AS route, nullif(split_part(r, ':', 2), '') AS direct_lang, count(*) AS n FROM (SELECT {_route()} AS r FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT html FROM pages)) GROUP BY r")
def route_histogram(spark, sf_dir):
    """Flagship: where all texts of all tables are to be scored."""
    texts = _docs(spark, sf_dir).select("text").unionByName(_t(spark, sf_dir, "conversations").select("text")).unionByName(_t(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return texts.select(tx.route("text").alias("r")).groupBy("r.route", "r.direct_lang").agg(F.count(F.lit(1)).alias("n"))


@_query("script_counts", "SELECT doc_id, " + ", ".join(f"{_n(v)} AS {k.lower()}" for k, v in tx.SCRIPTS.items()) + f", {_n('A-Za-z')} AS ascii_letters FROM documents")
def script_counts(spark, sf_dir):
    inside = {k.lower(): v for k, v in tx.SCRIPTS.items()}
    n = scripts.letters("text", ascii_letters="A-Za-z", **inside)  # Latin without ASCII letters, as a letter counts once
    latin = (F.col("n.latin") + F.col("n.ascii_letters")).alias("latin")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n")).select("doc_id", *[latin if k == "latin" else F.col(f"n.{k}").alias(k) for k in inside], "n.ascii_letters")


@_query("char_scripts", "SELECT script, count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT ch, count(*) AS c, CASE " + " ".join(f"WHEN regexp_matches(ch, '^[{v}]$') THEN '{k}'" for k, v in tx.SCRIPTS.items()) + " END AS script FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch) GROUP BY script")
def char_scripts(spark, sf_dir):
    """Distinct characters by script, and how often they occur."""
    ch = _docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("c"))
    return ch.groupBy(tx.char_script("ch").alias("script")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"))


@_query("length_buckets", "SELECT CASE WHEN length(text) <= 20 THEN 0 WHEN length(text) <= 100 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(tx.length_bucket("text").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query("word_class_counts", f"SELECT class, count(*) AS n FROM (SELECT {_class('w')} AS class FROM (SELECT unnest({_RETAINED}) AS w FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT url FROM pages))) GROUP BY class")
def word_class_counts(spark, sf_dir):
    """Words of documents and pages by class; each distinct word is classified once."""
    pages = _t(spark, sf_dir, "pages")
    texts = _docs(spark, sf_dir).select("text").union(pages.select("html")).union(pages.select("url"))
    words = texts.select(F.explode(tx.retained_words("text")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return words.groupBy(tx.classify_word("w").alias("class")).agg(F.sum("c").alias("n"))


_TOKENS = f"list_filter({_words()}, lambda w: regexp_matches(w, '\\p{{L}}'))"
for _k in (1, 2, 3):

    @_query(f"fragments_{_k}", f"SELECT lang, fragment, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(0, len(ws) - {_k - 1}), lambda i: array_to_string(list_slice(ws, i + 1, i + {_k}), ' '))) AS fragment FROM (SELECT lang, {_TOKENS} AS ws FROM documents)) GROUP BY ALL")
    def _fragments(spark, sf_dir, k=_k):
        return fragments.counts(_docs(spark, sf_dir), "lang", k)


@_query("token_count", f"SELECT doc_id, (coalesce(list_sum(list_transform(ws, lambda w: 1 + CASE length(CASE WHEN {_class('w')} = 'word' THEN lower(w) ELSE '.' END) WHEN 1 THEN 6 WHEN 2 THEN 10 ELSE 5 * length(CASE WHEN {_class('w')} = 'word' THEN lower(w) ELSE '.' END) END)), 0) + greatest(len(ws) - 1, 0))::BIGINT AS n_tokens FROM (SELECT doc_id, {_RETAINED} AS ws FROM documents)")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", dt.token_numbers("text").alias("n_tokens"))


_2_64 = "18446744073709551616::UHUGEINT"
_FNV = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(w, ''), lambda c: unicode(c)::UHUGEINT)), lambda a, c: (xor(a::UBIGINT, c::UBIGINT)::UHUGEINT * 1099511628211) % {_2_64})::UBIGINT"
_DISTINCT = f"(SELECT DISTINCT lower(w) AS w FROM (SELECT unnest({_RETAINED}) AS w FROM documents) WHERE {_class('w')} = 'word')"


def _own_keys(spark, sf_dir) -> DataFrame:
    """(w, key): distinct words and the keys of their own features."""
    from ..functions import features

    @F.arrow_udf("bigint")
    def key(w: pa.Array) -> pa.Array:
        t = features.word_table(w.to_pylist())
        return pa.array(t.keys[t.off[1:] - 1].view(np.int64))

    words = _docs(spark, sf_dir).select(F.explode(tx.retained_words("text")).alias("w")).where(tx.classify_word("w") == "word").select(F.lower("w").alias("w")).distinct()
    return words.withColumn("key", key(F.col("w")))


_TAG6 = 6 * 0x9E3779B97F4A7C15 % (1 << 64)
_KEY = f"xor({_FNV}, {_TAG6}::UBIGINT)"


@_query("word_keys", f"SELECT w, (CASE WHEN k >= 9223372036854775808 THEN k::HUGEINT - 18446744073709551616 ELSE k::HUGEINT END)::BIGINT AS key FROM (SELECT w, {_KEY} AS k FROM {_DISTINCT})")
def word_keys(spark, sf_dir):
    """The hash of each distinct word over its code points, tagged."""
    return _own_keys(spark, sf_dir)


def _bucket_sql() -> str:
    m = "4294967296"
    return f"""
WITH k AS (SELECT w, {_KEY} AS k FROM {_DISTINCT}),
a AS (SELECT w, xor(xor(k % {m}, ({0x9E3779B9} * {0x85EBCA6B}::UBIGINT) % {m}), ((k >> 32) * {0xC2B2AE35}::UBIGINT) % {m}) AS h FROM k),
b AS (SELECT w, (xor(h, h >> 16) * {0x85EBCA6B}::UBIGINT) % {m} AS h FROM a),
c AS (SELECT w, (xor(h, h >> 13) * {0xC2B2AE35}::UBIGINT) % {m} AS h FROM b),
d AS (SELECT w, xor(h, h >> 16) AS h FROM c)
SELECT w, (h >> 15)::INTEGER AS bucket, h % 2 = 1 AS negative FROM d"""


@_query("word_buckets", _bucket_sql())
def word_buckets(spark, sf_dir):
    """Bucket and sign of each distinct word at 2**17 buckets."""
    from ..functions import hashing

    @F.arrow_udf("struct<bucket int, negative boolean>")
    def bucket(k: pa.Array) -> pa.Array:
        b, neg = hashing.buckets(k.to_numpy(zero_copy_only=False).view(np.uint64), 17)
        return pa.StructArray.from_arrays([pa.array(b), pa.array(neg)], ["bucket", "negative"])

    return _own_keys(spark, sf_dir).select("w", bucket(F.col("key")).alias("b")).select("w", "b.bucket", "b.negative")


def _crc_table() -> str:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]"


_BYTES = "list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::UTINYINT::UBIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}), lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"
_SPLIT = f"(SELECT lang, text, _src, _pos, CASE WHEN crc % 10 < 8 THEN 'train' WHEN crc % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_CRC} AS crc FROM (SELECT *, lang || chr(0) || text AS s, {_crc_table()}::UBIGINT[] AS tab FROM {_SAMPLES})))"


@_query("crc32_split", f"SELECT _pos AS doc_id, split FROM {_SPLIT}")
def crc32_split(spark, sf_dir):
    return mix.with_split(_samples(spark, sf_dir)).select(F.col("_pos").alias("doc_id"), "split")


_FLAT = f"trim(regexp_replace(text, '[{P}]+', ' ', 'g'))"


@_query("flatten", f"SELECT doc_id, md5({_FLAT}) AS digest, length({_FLAT}) AS n FROM documents")
def flatten(spark, sf_dir):
    t = tx.flatten("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


_LETTERS = r"regexp_replace(text, '[^\p{L}]+', '', 'g')"


@_query("cyrillic_gate", rf"SELECT doc_id, CASE WHEN length(l) > 0 THEN (length(l) - length(regexp_replace(l, '[\x{{0400}}-\x{{04FF}}]+', '', 'g'))) / length(l) ELSE 0.0 END::DOUBLE AS ratio, {_n(chr(92) + 'x{0400}-' + chr(92) + 'x{052F}')} > {_n('A-Za-z')} AS is_cyrillic FROM (SELECT doc_id, text, {_LETTERS} AS l FROM documents)")
def cyrillic_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.cyrillic_ratio("text").alias("ratio"), tx.is_cyrillic("text").alias("is_cyrillic"))


@_query("source_gates", f"SELECT doc_id, t AS text FROM (SELECT doc_id, {_FLAT} AS t FROM documents WHERE lang = 'en') WHERE length(t) BETWEEN 20 AND 2000")
def source_gates(spark, sf_dir):
    """A CSV-like source: label, flatten, least and most length."""
    from ..sources.readers import gates

    return gates(_docs(spark, sf_dir).where("lang = 'en'"), 20, 2000).select("doc_id", "text")


@_query("source_truncated", f"SELECT doc_id, left(t, 200) AS text FROM (SELECT doc_id, {_FLAT} AS t FROM documents) WHERE length(t) >= 20 AND NOT regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]')")
def source_truncated(spark, sf_dir):
    """A raw document source: longer texts are cut, texts with CJK dropped."""
    from ..sources.readers import gates

    return gates(_docs(spark, sf_dir), 20, 200, truncate=True, drop_cjk=True).select("doc_id", "text")


_SENT = f"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?…])[{P}]+', '\\1\x1e', 'g'), '\x1e|\\n+'), lambda s: trim(regexp_replace(s, '[{P}]+', ' ', 'g'))), lambda s: length(s) BETWEEN 20 AND 200)"


@_query("sentences_regex", f"SELECT doc_id, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents))")
def sentences_regex(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences("text")).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("bigint"))


_W = r"[\p{L}\p{N}_]"


@_query("judge_text", rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^RT(?:[:{P}]+|$)', ' '), '@{_W}+', ' ', 'g'), 'https?://[^{P}]+|\bwww\.[^{P}]+', ' ', 'g'), '[{P}]+', ' ', 'g'))) AS digest FROM documents")
def judge_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.judge_text("text")).alias("digest"))


def _language_values() -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({l.index}, {q(l.iso3)}, {q(l.iso1)}, {q(l.nllb)}, {q(l.whisper)}, {q(l.name)}, {q(l.script)}, {q(l.group)}, {q(langs.TWIN_OF.get(l.iso3))})" for l in langs.ALL)


_DIM = f"(SELECT * FROM (VALUES {_language_values()}) AS v(idx, iso3, iso1, nllb, whisper, name, script, grp, twin))"


@_query("language_lookup", f"SELECT d.doc_id, v.iso3, v.name, v.nllb, v.whisper, v.script, v.grp AS model_group, v.idx AS model_column FROM documents d JOIN {_DIM} v ON v.iso1 = d.lang")
def language_lookup(spark, sf_dir):
    dim = langs.languages(spark)  # 30 rows
    return _docs(spark, sf_dir).join(F.broadcast(dim), F.col("lang") == F.col("iso1")).select("doc_id", "iso3", "name", "nllb", "whisper", "script", F.col("group").alias("model_group"), F.col("index").alias("model_column"))


@_query("label_aliases", "SELECT d.doc_id, a.lang AS iso3 FROM documents d JOIN (VALUES " + ", ".join(f"('{l}', '{c}')" for c, ls in langs.LABEL_ALIASES["lid176"].items() for l in ls) + ") AS a(label, lang) ON a.label = d.lang")
def label_aliases(spark, sf_dir):
    """Labels of another identifier in our codes."""
    return _docs(spark, sf_dir).withColumnRenamed("lang", "label").join(F.broadcast(langs.label_aliases(spark, "lid176")), "label").select("doc_id", F.col("lang").alias("iso3"))


_DEDUP = f"(SELECT lang, text, _src, _pos FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY _src, _pos) AS r FROM {_SAMPLES}) WHERE r = 1)"


@_query("dedup_first", f"SELECT _src, _pos, lang FROM {_DEDUP}")
def dedup_first(spark, sf_dir):
    return mix.dedup_first(_samples(spark, sf_dir)).select("_src", "_pos", "lang")


@_query("unique_counts", f"SELECT _src, count(*) AS n FROM {_DEDUP} GROUP BY _src")
def unique_counts(spark, sf_dir):
    return mix.unique_counts(mix.dedup_first(_samples(spark, sf_dir)))


_SENT_ROWS = f"(SELECT doc_id, {_LANG} AS lang, unnest({_SENT}) AS text FROM documents)"


def _sentence_samples(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", langs.from_iso1(F.col("lang")).alias("lang"), F.explode(tx.sentences("text")).alias("text"))


@_query("exclude_benchmark", f"SELECT doc_id, lang, text FROM {_SENT_ROWS} WHERE text NOT IN (SELECT unnest({_SENT}) FROM benchmark)")
def exclude_benchmark(spark, sf_dir):
    """Sentences of documents without those of the test set."""
    test = _t(spark, sf_dir, "benchmark").select(F.explode(tx.sentences("text")).alias("text"))
    return mix.exclude(_sentence_samples(spark, sf_dir), test, ["text"])


_DS = f"(SELECT DISTINCT lang, text FROM {_SENT_ROWS})"
_K = "md5('42' || chr(31) || lang || chr(31) || text)"


@_query("cap_per_lang", f"SELECT lang, text FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY {_K}, lang, text) AS r FROM {_DS}) WHERE r <= 500")
def cap_per_lang(spark, sf_dir):
    return mix.balanced_sample(_sentence_samples(spark, sf_dir).select("lang", "text").distinct(), 500)


@_query("stratified_cap", f"""
WITH f AS (SELECT DISTINCT lang, unnest(list_transform(range(0, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i + 1, i + 3), ' '))) AS text FROM (SELECT {_LANG} AS lang, {_TOKENS} AS ws FROM documents)),
g AS (SELECT *, length(text) <= 19 AS short FROM f), s AS (SELECT lang, count(*) FILTER (short) AS s, count(*) FILTER (NOT short) AS l FROM g GROUP BY lang),
p AS (SELECT lang, s, l, least(s, 150) + greatest(0, 500 - least(s, 150) - l) AS ws, least(500 - least(s, 150), l) AS wl FROM s),
r AS (SELECT g.*, p.s + p.l AS size, CASE WHEN short THEN ws ELSE wl END AS want, row_number() OVER (PARTITION BY g.lang, short ORDER BY {_K.replace('lang', 'g.lang').replace('text', 'g.text')}, g.lang, g.text) AS r FROM g JOIN p USING (lang))
SELECT lang, text FROM r WHERE size <= 500 OR r <= want""")
def stratified_cap(spark, sf_dir):
    """Word triples with a share of short ones."""
    rows = fragments.counts(_docs(spark, sf_dir).select(langs.from_iso1(F.col("lang")).alias("lang"), "text"), "lang", 3).select("lang", F.col("fragment").alias("text"))
    return mix.cap_stratified(rows, 500, 0.3, by=("lang",))


_LEMMA = r"regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')"
_DF = f"(SELECT lang, lemma, count(*) AS df FROM (SELECT lang, unnest(list_distinct({_LEMMA})) AS lemma FROM documents) GROUP BY ALL)"


@_query("lemma_df", f"SELECT * FROM {_DF}")
def lemma_df(spark, sf_dir):
    return select.document_frequency(_docs(spark, sf_dir), tx.lemma_tokens("text"), "lang")


@_query("top_lemmas", f"SELECT lang, lemma, df FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, lemma) AS r FROM {_DF}) WHERE r <= 200")
def top_lemmas(spark, sf_dir):
    return select.top_lemmas(lemma_df(spark, sf_dir), 200, "lang")


@_query("length_bands", f"SELECT lang, band, n, cap FROM (SELECT lang, band, n, CASE WHEN abs(x - floor(x) - 0.5) < 1e-12 THEN 2 * round(x / 2) ELSE round(x) END::BIGINT AS cap FROM (SELECT lang, band, n, 1000 * n / sum(n) OVER (PARTITION BY lang) AS x FROM (SELECT lang, least((length(text) - 20) // 20, 9)::INTEGER AS band, count(*) AS n FROM {_SENT_ROWS} GROUP BY ALL)))")
def length_bands(spark, sf_dir):
    rows = _sentence_samples(spark, sf_dir).select("lang", select.band("text").alias("band"))
    return select.band_caps(rows, 1000, "lang")


@_query("stem_clusters", f"""
WITH v AS (SELECT DISTINCT lang, lemma AS token FROM {_DF}), p AS (SELECT *, lag(token) OVER (PARTITION BY lang ORDER BY token) AS prev FROM v),
c AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(prev), length(token)) + 1), lambda i: left(prev, i) = left(token, i))), 0) AS common FROM p),
n AS (SELECT lang, token, CASE WHEN prev IS NOT NULL AND common >= 3 AND common >= least(length(prev), length(token)) - 2 AND abs(length(prev) - length(token)) <= 6 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT lang, token, sum(new) OVER (PARTITION BY lang ORDER BY token ROWS UNBOUNDED PRECEDING) AS c FROM n)
SELECT lang, token, first_value(token) OVER (PARTITION BY lang, c ORDER BY token) AS lemma FROM g""")
def stem_clusters(spark, sf_dir):
    return select.stem_clusters(lemma_df(spark, sf_dir).select("lang", F.col("lemma").alias("token")), "lang")


# -- metrics, on a judge that SQL can repeat: the language of accented letters

_ACCENTS = {"deu": "äöüßÄÖÜ", "spa": "ñíóúáÑÍÓÚÁ", "fra": "éèêçàùœÉÈÊÇÀ"}


def _predictions(rows: DataFrame) -> DataFrame:
    """(gold, pred, conf, text, _pos, _src): a judge by letters; null without Latin letters."""
    rows = rows.withColumn("__a", scripts.letters("text", **_ACCENTS, latin=tx.SCRIPTS["Latin"]))  # counted once, from the bytes
    d, s, f = (F.col(f"__a.{k}") for k in ("deu", "spa", "fra"))
    pred = F.when(d + s + f + F.col("__a.latin") == 0, None).when((d > 0) & (d >= s) & (d >= f), "deu").when((s > 0) & (s >= f), "spa").when(f > 0, "fra").otherwise("eng")
    conf = F.when(d + s + f > 0, F.greatest(d, s, f) / (d + s + f)).otherwise(0.5)
    return rows.select(F.col("lang").alias("gold"), pred.alias("pred"), conf.alias("conf"), "text", *[c for c in ("_pos", "_src") if c in rows.columns])


_NA = {k: f"(length(text) - length(regexp_replace(text, '[{v}]+', '', 'g')))" for k, v in _ACCENTS.items()}
_D, _E, _R = _NA["deu"], _NA["spa"], _NA["fra"]


def _pred_sql(table: str, keep: str = "_pos, _src") -> str:
    return f"(SELECT lang AS gold, CASE WHEN {_n(tx.SCRIPTS['Latin'])} = 0 THEN NULL WHEN {_D} > 0 AND {_D} >= {_E} AND {_D} >= {_R} THEN 'deu' WHEN {_E} > 0 AND {_E} >= {_R} THEN 'spa' WHEN {_R} > 0 THEN 'fra' ELSE 'eng' END AS pred, CASE WHEN {_D} + {_E} + {_R} > 0 THEN greatest({_D}, {_E}, {_R}) / ({_D} + {_E} + {_R}) ELSE 0.5 END::DOUBLE AS conf, text, {keep} FROM {table})"


_PRED = _pred_sql(_SAMPLES)
_EQ = "(gold IS NOT DISTINCT FROM pred)::INTEGER"


def _doc_predictions(spark, sf_dir) -> DataFrame:
    return _predictions(_samples(spark, sf_dir))


@_query("accuracy_by_lang", f"SELECT gold, sum({_EQ})::BIGINT AS ok, count(*) AS n, sum({_EQ}) / count(*) AS accuracy FROM {_PRED} GROUP BY gold")
def accuracy_by_lang(spark, sf_dir):
    return metrics.accuracy(_doc_predictions(spark, sf_dir), "gold")


@_query("confusion", f"SELECT gold, pred, count(*) AS n FROM {_PRED} GROUP BY gold, pred")
def confusion(spark, sf_dir):
    return metrics.confusion(_doc_predictions(spark, sf_dir))


@_query("top_confusions", f"SELECT gold, pred, count(*) AS n FROM {_PRED} WHERE gold <> pred GROUP BY gold, pred ORDER BY n DESC, gold, pred LIMIT 12")
def top_confusions(spark, sf_dir):
    return metrics.top_confusions(_doc_predictions(spark, sf_dir))


@_query("precision_recall", f"""
WITH p AS (SELECT * FROM {_PRED}), g AS (SELECT gold AS lang, count(pred) AS gold_total, sum({_EQ})::BIGINT AS tp, count(*) - count(pred) AS n_und FROM p WHERE gold IS NOT NULL GROUP BY gold),
m AS (SELECT pred AS lang, count(*) AS pred_total FROM p WHERE pred IS NOT NULL GROUP BY pred),
x AS (SELECT coalesce(g.lang, m.lang) AS lang, coalesce(tp, 0) AS tp, coalesce(gold_total, 0) AS gold_total, coalesce(pred_total, 0) AS pred_total, coalesce(n_und, 0) AS n_und FROM g FULL JOIN m ON g.lang = m.lang),
y AS (SELECT *, CASE WHEN pred_total > 0 THEN tp / pred_total END AS precision, CASE WHEN gold_total > 0 THEN tp / gold_total END AS recall FROM x)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / nullif(precision + recall, 0) END::DOUBLE AS f1 FROM y""")
def precision_recall(spark, sf_dir):
    return metrics.prf(_doc_predictions(spark, sf_dir))


@_query("accuracy_by_length", f"SELECT CASE WHEN length(text) <= 20 THEN 0 WHEN length(text) <= 100 THEN 1 ELSE 2 END AS bucket, sum({_EQ})::BIGINT AS ok, count(*) AS n, sum({_EQ}) / count(*) AS accuracy FROM {_PRED} GROUP BY 1")
def accuracy_by_length(spark, sf_dir):
    return metrics.by_length(_doc_predictions(spark, sf_dir))


@_query("coverage", f"SELECT count(*) AS n, sum(s)::BIGINT AS n_supported, sum(e)::BIGINT AS ok, sum(s * e)::BIGINT AS ok_supported, sum(e) / count(*) AS accuracy_all, sum(s * e) / sum(s) AS accuracy_supported FROM (SELECT (gold IN ('deu', 'fra', 'eng'))::INTEGER AS s, {_EQ} AS e FROM {_PRED})")
def coverage(spark, sf_dir):
    """A tool that knows three of the languages."""
    return metrics.coverage(_doc_predictions(spark, sf_dir), ["deu", "fra", "eng"])


_LADDER = "(SELECT lang, 0 AS n, text FROM s" + "".join(f" UNION ALL SELECT lang, {k} AS n, unnest(list_transform(range(0, len(ws) - {k - 1}), lambda i: array_to_string(list_slice(ws, i + 1, i + {k}), ' '))) AS text FROM (SELECT lang, {_TOKENS} AS ws FROM s)" for k in (1, 2, 3)) + ")"
_LADDER_SQL = f"WITH s AS (SELECT * FROM {_SAMPLES}), p AS {_pred_sql(_LADDER, 'n')}, l AS (SELECT n, gold, sum({_EQ})::BIGINT AS ok, count(*) AS n_rows, sum({_EQ}) / count(*) AS accuracy FROM p GROUP BY n, gold)"


def _ladder(spark, sf_dir) -> DataFrame:
    return metrics.ladder(_samples(spark, sf_dir), lambda d: _predictions(d.withColumn("lang", F.col("gold")).withColumn("_pos", F.struct("n", "c"))).select("gold", "pred", "_pos.n", "_pos.c"))


@_query("granularity_ladder", f"{_LADDER_SQL} SELECT * FROM l")
def granularity_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir)


@_query("worst_languages", f"{_LADDER_SQL} SELECT * FROM l WHERE n = 1 ORDER BY accuracy, gold LIMIT 15")
def worst_languages(spark, sf_dir):
    return metrics.worst(_ladder(spark, sf_dir))


@_query("error_dump", f"SELECT gold, coalesce(pred, 'und') AS pred, printf('%.3f', conf) AS conf, CASE WHEN conf < 0.9 THEN 'uncertain' ELSE '' END AS flag, {_FLAT} AS text FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY _pos) AS r FROM {_PRED} WHERE gold IS DISTINCT FROM pred) WHERE r <= 20")
def error_dump(spark, sf_dir):
    p = _doc_predictions(spark, sf_dir).withColumn("confidence", F.col("conf")).withColumn("is_uncertain", F.col("conf") < 0.9)
    return metrics.error_dump(p, 20)


@_query("theta", f"SELECT quantile_cont(conf, 0.05) AS theta FROM {_PRED}")
def theta(spark, sf_dir):
    return metrics.theta(_doc_predictions(spark, sf_dir), "conf")


# -- verdicts

_TWIN = " OR ".join(f"(lang IN ({', '.join(repr(c) for c in g.split())}) AND pred IN ({', '.join(repr(c) for c in g.split())}))" for g in langs.TWIN_GROUPS.values())
# judged rows with languages of one group among them: English and German are read as Russian and Ukrainian
_RELABEL = "CASE {0} WHEN 'eng' THEN 'rus' WHEN 'deu' THEN 'ukr' ELSE {0} END"
_JUDGED = f"(SELECT _pos, {_RELABEL.format('gold')} AS lang, {_RELABEL.format('pred')} AS pred, conf, text, _src FROM {_PRED})"


def _judged(spark, sf_dir) -> DataFrame:
    p = _doc_predictions(spark, sf_dir)
    r = lambda c: F.when(F.col(c) == "eng", "rus").when(F.col(c) == "deu", "ukr").otherwise(F.col(c))
    return p.select("_pos", r("gold").alias("lang"), r("pred").alias("pred"), "conf", "text", "_src")


_CYR = ", ".join(repr(c) for c in hygiene.CYRILLIC)
_LATIN_ROW = f"(lang IN ({_CYR}) AND {_n('A-Za-z')} >= greatest(4, {_n(chr(92) + 'x{0400}-' + chr(92) + 'x{04FF}')} + 1) AND length(text) % 3 = 0)"


@_query("hygiene", f"SELECT _pos, lang, pred, CASE WHEN coalesce(pred <> lang AND conf >= 0.8, false) THEN NOT ({_TWIN}) ELSE {_LATIN_ROW} END AS dropped FROM {_JUDGED}")
def hygiene_verdicts(spark, sf_dir):
    """Kept and dropped rows; a second judge finds Latin script in one row of three."""
    rows = _judged(spark, sf_dir).withColumns({"latin_top": F.lit("en"), "latin_p": F.when(F.length("text") % 3 == 0, 0.95).otherwise(0.1)})
    return hygiene.marked(rows, 0.8).select("_pos", "lang", "pred", "dropped")


@_query("hard_negatives", f"SELECT source, _pos, lang, pred, conf FROM (SELECT _src AS source, _pos, lang, pred, conf, row_number() OVER (PARTITION BY _src ORDER BY conf DESC, text) AS r FROM {_JUDGED} WHERE pred <> lang AND conf >= 0.6 AND NOT ({_TWIN})) WHERE r <= 4000")
def hard_negatives(spark, sf_dir):
    return hygiene.hard_negatives(_judged(spark, sf_dir).withColumn("source", F.col("_src")), 0.6).select("source", "_pos", "lang", "pred", "conf")


_VOTES = f"(SELECT *, CASE WHEN length(text) % 4 = 0 THEN NULL ELSE lang END AS j2, CASE WHEN length(text) % 5 = 0 THEN 'ukr' WHEN length(text) % 5 = 1 THEN NULL ELSE lang END AS j3 FROM {_JUDGED})"


def _voted(spark, sf_dir) -> DataFrame:
    n = F.length("text")
    return _judged(spark, sf_dir).withColumns({"j2": F.when(n % 4 != 0, F.col("lang")), "j3": F.when(n % 5 == 0, "ukr").when(n % 5 != 1, F.col("lang"))})


@_query("short_verify", f"SELECT _pos, lang, coalesce((pred = lang)::INTEGER, 0) + coalesce((j2 = lang)::INTEGER, 0) + coalesce((j3 = lang)::INTEGER, 0) >= 2 AS kept FROM {_VOTES}")
def short_verify(spark, sf_dir):
    kept, dropped = hygiene.short_verify(_voted(spark, sf_dir), ["pred", "j2", "j3"])
    return kept.select("_pos", "lang", F.lit(True).alias("kept")).unionByName(dropped.select("_pos", "lang", F.lit(False).alias("kept")))


def _vote(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'abstain' WHEN {p} = lang THEN 'affirm' WHEN {_TWIN.replace('pred', p)} THEN 'twin' ELSE 'contradict' END"


@_query("referee_votes", f"SELECT _pos, v1, v2, (v1 = 'affirm')::INTEGER + (v2 = 'affirm')::INTEGER >= 2 OR ((v1 = 'affirm')::INTEGER + (v2 = 'affirm')::INTEGER = 1 AND v1 <> 'contradict' AND v2 <> 'contradict' AND len({_words()}) >= 2) AS accepted FROM (SELECT _pos, text, {_vote('pred')} AS v1, {_vote('j3')} AS v2 FROM {_VOTES})")
def referee_votes(spark, sf_dir):
    v1, v2 = hygiene.vote(F.col("pred"), F.col("lang")), hygiene.vote(F.col("j3"), F.col("lang"))
    return _voted(spark, sf_dir).select("_pos", v1.alias("v1"), v2.alias("v2"), hygiene.referee_accepts([v1, v2], F.col("text")).alias("accepted"))


@_query("certified", "SELECT doc_id, CASE lang WHEN 'en' THEN regexp_matches(text, '[ыъёэ]') AND NOT regexp_matches(text, '[іїєґ]|[ў]') ELSE false END AS certified FROM documents")
def certified(spark, sf_dir):
    """Spelling proof (English texts stand in for Russian ones)."""
    return _docs(spark, sf_dir).select("doc_id", tx.certified(F.when(F.col("lang") == "en", "rus").otherwise(F.col("lang")), F.col("text")).alias("certified"))


# -- the same functions on other scripts: the documents with their letters exchanged

_ABC = "abcdefghijklmnopqrstuvwxyzäöüßéèñ"
_OTHER_LETTERS = {
    0: "абцдэфгхийклмнопярстувьыжзщёюєіїў",  # Cyrillic, with the letters that prove a language
    1: "абцдefghijklmnopqrstuvwxyzїєґіўўў",  # mixed, with Ukrainian letters for German and a Belarusian one for French
    2: "一二三四efghijklmnopqrstuvwxyzäöüßéè中",
    3: "一二三四五六七八九十百千万上下左右大小山川日月火水木金土人入力",
    4: "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसहअआइउ",
    5: "ابتثجحخدذرزسشصضطظعغفقكلمنهويىءآأؤ",
    6: "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみ",
    7: "1234567890!?;:,.()[]{}+-=*&%$#/<>",
}
_PRINTED = {k: v[: len(_ABC)] for k, v in _OTHER_LETTERS.items()}
_SCRIPTED = "(SELECT doc_id, lang, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN translate(lower(text), '{_ABC[: len(v)]}', '{v}')" for k, v in _PRINTED.items()) + " ELSE text END AS text FROM documents)"
_EAST = "CASE lang WHEN 'en' THEN 'rus' WHEN 'de' THEN 'ukr' WHEN 'fr' THEN 'bel' ELSE lang END"


def _scripted(spark, sf_dir) -> DataFrame:
    """All documents; eight in nine with letters of other scripts, whole texts."""
    text, k = F.col("text"), F.col("doc_id") % 9
    out = text
    for i, v in _PRINTED.items():
        out = F.when(k == i, F.translate(F.lower(text), _ABC[: len(v)], v)).otherwise(out)
    return _docs(spark, sf_dir).select("doc_id", "lang", out.alias("text"))


@_query("scripted_routes", f"SELECT doc_id, split_part(r, ':', 1) AS route, nullif(split_part(r, ':', 2), '') AS direct_lang FROM (SELECT doc_id, {_route()} AS r FROM {_SCRIPTED})")
def scripted_routes(spark, sf_dir):
    return _scripted(spark, sf_dir).select("doc_id", scripts.route_column("text").alias("r")).select("doc_id", "r.route", "r.direct_lang")


@_query("scripted_letters", "SELECT doc_id, " + ", ".join(f"{_n(v)} AS {k.lower()}" for k, v in tx.SCRIPTS.items()) + f" FROM {_SCRIPTED}")
def scripted_letters(spark, sf_dir):
    """Letters of each script, counted from the bytes."""
    n = scripts.letters("text", **{k.lower(): v for k, v in tx.SCRIPTS.items()})
    return _scripted(spark, sf_dir).select("doc_id", n.alias("n")).select("doc_id", "n.*")


@_query("scripted_chars", "SELECT script, count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT ch, count(*) AS c, CASE " + " ".join(f"WHEN regexp_matches(ch, '^[{v}]$') THEN '{k}'" for k, v in tx.SCRIPTS.items()) + f" END AS script FROM (SELECT unnest(string_split(text, '')) AS ch FROM {_SCRIPTED}) WHERE ch <> '' GROUP BY ch) GROUP BY script")
def scripted_chars(spark, sf_dir):
    ch = _scripted(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("c"))
    return ch.groupBy(tx.char_script("ch").alias("script")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"))


@_query("scripted_cyrillic", rf"SELECT doc_id, CASE WHEN length(l) > 0 THEN (length(l) - length(regexp_replace(l, '[\x{{0400}}-\x{{04FF}}]+', '', 'g'))) / length(l) ELSE 0.0 END::DOUBLE AS ratio, {_n(chr(92) + 'x{0400}-' + chr(92) + 'x{052F}')} > {_n('A-Za-z')} AS is_cyrillic FROM (SELECT doc_id, text, {_LETTERS} AS l FROM {_SCRIPTED})")
def scripted_cyrillic(spark, sf_dir):
    return _scripted(spark, sf_dir).select("doc_id", tx.cyrillic_ratio("text").alias("ratio"), tx.is_cyrillic("text").alias("is_cyrillic"))


_FOREIGN = {"rus": ("[ыъёэ]", "[іїєґ]|[ў]"), "ukr": ("[іїєґ]", "[ыъёэ]|[ў]"), "bel": ("[ў]", "[ыъёэ]|[іїєґ]")}


@_query("scripted_certified", "SELECT doc_id, lang, CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_matches(text, '{a}') AND NOT regexp_matches(text, '{b}')" for k, (a, b) in _FOREIGN.items()) + f" ELSE false END AS certified FROM (SELECT doc_id, {_EAST} AS lang, text FROM {_SCRIPTED})")
def scripted_certified(spark, sf_dir):
    """Spelling proof, where English stands for Russian, German for Ukrainian and French for Belarusian."""
    lang = F.when(F.col("lang") == "en", "rus").when(F.col("lang") == "de", "ukr").when(F.col("lang") == "fr", "bel").otherwise(F.col("lang"))
    return _scripted(spark, sf_dir).select("doc_id", lang.alias("lang"), "text").select("doc_id", "lang", tx.certified("lang", "text").alias("certified"))


@_query("scripted_words", f"SELECT class, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT w, {_class('w')} AS class FROM (SELECT unnest({_RETAINED}) AS w FROM {_SCRIPTED})) GROUP BY class")
def scripted_words(spark, sf_dir):
    words = _scripted(spark, sf_dir).select(F.explode(tx.retained_words("text")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return words.groupBy(tx.classify_word("w").alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("words"))


# -- stored tables


@_query("quantize_rows", """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::FLOAT) AS v FROM embeddings), s AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) / 127::FLOAT AS s FROM e),
q AS (SELECT id, v, CASE WHEN s = 0 THEN 1::FLOAT ELSE s END AS s FROM s),
r AS (SELECT id, v, s, list_transform(v, lambda x: CASE WHEN abs(x / s - floor(x / s) - 0.5) < 1e-12 THEN 2 * round(x / s / 2) ELSE round(x / s) END::INTEGER) AS q FROM q)
SELECT id, array_to_string(q, ',') AS q, round(s::DOUBLE, 9) AS scale, round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs((q[i] * s)::FLOAT - v[i])))::DOUBLE, 7) AS max_error, len(list_filter(q, lambda x: x = 0)) AS zeros FROM r""")
def quantize_rows(spark, sf_dir):
    """Vectors stored as 8-bit integers with a scale each, and what that costs: the model's quantiser, by row."""
    e = _t(spark, sf_dir, "embeddings")
    vec = next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")

    @F.arrow_udf("struct<q string, scale double, max_error double, zeros bigint>")
    def store(v: pa.Array) -> pa.Array:
        out = []
        for x in v.to_pylist():  # rows may differ in length
            p = np.array([x], np.float32)
            stored, scales = quantize(p, "int8", "row")
            cost = damage(p, stored, scales, "int8", "row")
            out.append({"q": ",".join(map(str, stored[0].tolist())), "scale": round(float(scales[0]), 9), "max_error": round(cost["max_error"], 7), "zeros": int((stored == 0).sum())})
        return pa.array(out, pa.struct([("q", pa.string()), ("scale", pa.float64()), ("max_error", pa.float64()), ("zeros", pa.int64())]))

    return e.select(F.col(e.columns[0]).alias("id"), store(F.col(vec)).alias("x")).select("id", "x.*")


# -- models


_MODELS: dict[tuple[str, str], Model] = {}


def _model(spark, sf_dir) -> Model:
    """A table trained on all documents, once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = train.train_counts(_samples(spark, sf_dir), 12)
    return _MODELS[key]


def _int_model() -> Model:
    """A table of small whole numbers, so that sums are exact and SQL can repeat them."""
    b, c = np.meshgrid(np.arange(4097), np.arange(30), indexing="ij")
    return Model((b * 31 + c * 17) % 255 - 127.0, np.zeros(30), 12)


_M32 = "4294967296"
_TAGS = [n * 0x9E3779B97F4A7C15 % (1 << 64) for n in range(8)]


def _mix64_sql(x: str, multiplier: int) -> str:
    return f"((xor({x}, {x} >> 33)::UHUGEINT * {multiplier}::UHUGEINT) % {_2_64})::UBIGINT"


def _keys_sql(rows: str) -> str:
    """CTEs for ``rows`` (id, text): occ (id, i, w), word (w, h), wkey (w, key) and pair (id, key), the definition of all keys."""
    sentinels = " ".join(f"WHEN '{k}' THEN [{v}]" for k, v in (("url", 0xE001), ("email", 0xE002), ("mention", 0xE003), ("num", 0xE004)))
    grams = " UNION ALL ".join(f"SELECT w, xor({x}, {_TAGS[n]}::UBIGINT) AS key FROM place WHERE i >= {n}" for n, x in ((1, "c0"), (2, "(c0 | (c1 << 21))"), (3, "(c0 | (c1 << 21) | (c2 << 42))"), (4, "(c0 | (c1 << 21) | (c2 << 42) | ((c3 & 1) << 63))"), (5, "(c0 | (c1 << 21) | (c2 << 42) | ((c3 & 1) << 63))")))
    return f"""
src AS ({rows}),
lists AS (SELECT id, {_RETAINED} AS ws FROM src),
occ AS (SELECT id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM lists),
letters AS (SELECT w, CASE {_class("w")} {sentinels} ELSE list_transform(string_split(lower(w), ''), lambda c: unicode(c)) END AS l FROM (SELECT DISTINCT w FROM occ)),
word AS MATERIALIZED (SELECT w, l, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(l, lambda c: c::UHUGEINT)), lambda a, c: (xor(a::UBIGINT, c::UBIGINT)::UHUGEINT * 1099511628211) % {_2_64})::UBIGINT AS h FROM letters),
marked AS (SELECT w, list_append(list_prepend(2, l), 3) AS m FROM word),
place AS (SELECT w, i, m[i]::UBIGINT AS c0, coalesce(m[i - 1], 0)::UBIGINT AS c1, CASE WHEN i > 2 THEN m[i - 2] ELSE 0 END::UBIGINT AS c2, CASE WHEN i > 3 THEN m[i - 3] ELSE 0 END::UBIGINT AS c3 FROM (SELECT w, m, unnest(range(1, len(m) + 1)) AS i FROM marked)),
wkey AS ({grams} UNION ALL SELECT w, xor(h, {_TAGS[6]}::UBIGINT) FROM word),
two AS (SELECT id, xor(prev, ((h % {_M32}) * {_M32}::UBIGINT) | (h >> 32)) AS x FROM (SELECT id, h, lag(h) OVER (PARTITION BY id ORDER BY i) AS prev FROM occ JOIN word USING (w)) WHERE prev IS NOT NULL),
two1 AS (SELECT id, {_mix64_sql("x", 0xFF51AFD7ED558CCD)} AS x FROM two),
two2 AS (SELECT id, {_mix64_sql("x", 0xC4CEB9FE1A85EC53)} AS x FROM two1),
pair AS (SELECT id, xor(xor(x, x >> 33), {_TAGS[7]}::UBIGINT) AS key FROM two2)"""


def _fmix_sql(table: str, keep: str, name: str) -> str:
    """CTEs that end in ``name`` (keep, h): the 32-bit hash of ``key``."""
    return f"""
{name}_a AS (SELECT {keep}, xor(xor(key % {_M32}, ({0x9E3779B9} * {0x85EBCA6B}::UBIGINT) % {_M32}), ((key >> 32) * {0xC2B2AE35}::UBIGINT) % {_M32}) AS h FROM {table}),
{name}_b AS (SELECT {keep}, (xor(h, h >> 16) * {0x85EBCA6B}::UBIGINT) % {_M32} AS h FROM {name}_a),
{name}_c AS (SELECT {keep}, (xor(h, h >> 13) * {0xC2B2AE35}::UBIGINT) % {_M32} AS h FROM {name}_b),
{name} AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {name}_c)"""


def _sums_sql(rows: str) -> str:
    """CTEs that end in scored (id, n, s): number of keys, and the sums of the whole-number table over them."""
    value = lambda c: f"sum((CASE WHEN h % 2 = 1 THEN -1 ELSE 1 END) * ((((h >> 20) * 31 + {c * 17}) % 255)::BIGINT - 127))::BIGINT AS s{c}"
    sums = ", ".join(value(c) for c in range(30))
    total = "[" + ", ".join(f"sum(s{c})::BIGINT" for c in range(30)) + "]"
    return f"""{_keys_sql(rows)},{_fmix_sql("wkey", "w", "wh")},{_fmix_sql("pair", "id", "ph")},
per_word AS MATERIALIZED (SELECT w, count(*) AS n, {sums} FROM wh GROUP BY w),
per_pair AS (SELECT id, count(*) AS n, {sums} FROM ph GROUP BY id),
scored AS (SELECT id, sum(n)::BIGINT AS n, {total} AS s FROM (SELECT id, per_word.* EXCLUDE (w) FROM occ JOIN per_word USING (w) UNION ALL SELECT * FROM per_pair) GROUP BY id)"""


_CODES = "[" + ", ".join(repr(c) for c in langs.CODES) + "]"
_DETECTED = f"CASE WHEN r LIKE 'direct:%' THEN substr(r, 8) WHEN r IN ('latin', 'cyrillic') THEN coalesce({_CODES}[31 - list_position(list_reverse(s), list_max(s))], {_CODES}[30]) END"
_CONF = "CASE WHEN r LIKE 'direct:%' THEN 1.0 WHEN r IN ('latin', 'cyrillic') THEN coalesce(1 / list_sum(list_transform(s, lambda x: exp((x - list_max(s)) / n))), 1 / 30) ELSE 0.0 END"


def _detected_sql(rows: str) -> str:
    """CTEs that end in found (id, lang, unsure)."""
    return f"{_sums_sql(rows)}, routed AS (SELECT id, {_route()} AS r FROM src), found AS (SELECT id, {_DETECTED} AS lang, {_CONF}::FLOAT < 0.5 AS unsure FROM routed LEFT JOIN scored USING (id))"


_TEXT_ID = "SELECT conv_id || ':' || turn || ':' || row_number() OVER () AS id, text FROM conversations"


@_query("detect_documents")
def detect_documents(spark, sf_dir):
    """Train a table on all documents, then detect the language of each."""
    d = dt.detect(_docs(spark, sf_dir), _model(spark, sf_dir))
    return d.select("doc_id", "lang", "lang_detected", F.round(F.col("confidence").cast("double"), 3).alias("confidence"), "is_uncertain")


@_query("integer_detection", f"WITH {_detected_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, lang AS lang_detected, unsure AS is_uncertain FROM found")
def integer_detection(spark, sf_dir):
    """Detection with a table of whole numbers: route, keys, hashes, sums, the best column, and the threshold."""
    return dt.detect(_docs(spark, sf_dir), _int_model()).select("doc_id", "lang_detected", "is_uncertain")


@_query("scripted_detection", f"WITH {_detected_sql(f'SELECT doc_id AS id, text FROM {_SCRIPTED}')} SELECT id AS doc_id, lang AS lang_detected, unsure AS is_uncertain FROM found")
def scripted_detection(spark, sf_dir):
    """Routed languages, undetermined texts, and scored ones in Latin and Cyrillic letters."""
    return dt.detect(_scripted(spark, sf_dir), _int_model()).select("doc_id", "lang_detected", "is_uncertain")


@_query("detect_histogram", f"WITH {_detected_sql(_TEXT_ID)} SELECT coalesce(lang, 'und') AS lang, count(*) AS n, sum(unsure::BIGINT)::BIGINT AS n_uncertain FROM found GROUP BY 1")
def detect_histogram(spark, sf_dir):
    """Languages of all turns, by a table of whole numbers."""
    return metrics.histogram(dt.detect(_t(spark, sf_dir, "conversations"), _int_model()))


@_query("sentence_sweep")
def sentence_sweep(spark, sf_dir):
    return sweep(_docs(spark, sf_dir), _model(spark, sf_dir), "doc_id")


@_query("sentences_rule")
def sentences_rule(spark, sf_dir):
    return sentence_rows(_docs(spark, sf_dir), "doc_id")


@_query("judge_verdicts", f"WITH {_sums_sql('SELECT doc_id AS id, left(text, 1200) AS text FROM documents')} SELECT doc_id, CASE WHEN n >= 8 THEN {_CODES}[list_position(s, list_max(s))] END AS pred FROM documents LEFT JOIN scored ON id = doc_id")
def judge_verdicts(spark, sf_dir):
    """A judge reads the first 1,200 characters: that many are its feature."""
    return _docs(spark, sf_dir).select("doc_id", dt.judge(spark, _int_model())["pred"].alias("pred"))


@_query("judge_confidence")
def judge_confidence(spark, sf_dir):
    """The same judge with a trained table, and its confidence."""
    j = dt.judge(spark, _model(spark, sf_dir))
    return _docs(spark, sf_dir).select("doc_id", j.alias("j")).select("doc_id", "j.pred", F.round("j.conf", 3).alias("conf"))


@_query("detection_lines")
def detection_lines(spark, sf_dir):
    d = dt.detect(_docs(spark, sf_dir), _model(spark, sf_dir))
    return d.select("doc_id", dt.detection_line(F.col("lang_detected"), F.round("confidence", 2), F.col("is_uncertain"), True).alias("line"))


@_query("integer_scores", f"WITH {_sums_sql('SELECT doc_id AS id, text FROM documents')} SELECT doc_id, coalesce(n, 0) AS n_tokens, array_to_string(coalesce(s, list_resize([0], 30, 0)), ',') AS sums FROM documents LEFT JOIN scored ON id = doc_id")
def integer_scores(spark, sf_dir):
    """Sums of a whole-number table over all tokens, in the function's form."""
    sent, key = spark.sparkContext.broadcast(_int_model()), random.getrandbits(62)

    @F.arrow_udf("struct<n bigint, sums array<bigint>>")
    def score(texts: pa.Array) -> pa.Array:
        m = sent.value
        table = m.doubled().astype(np.int64)
        known = dt.known_words(key, m, table)
        got = [dt.text_sums(piece, m, table, known) for piece in dt._slices(texts)] or [(np.zeros((0, 30), np.int64), np.zeros(0, np.int64))]
        sums, n = (np.concatenate(x) for x in zip(*got))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 30), pa.array(sums.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(n), lists], ["n", "sums"])

    return _docs(spark, sf_dir).select("doc_id", score(F.col("text")).alias("s")).select("doc_id", F.col("s.n").alias("n_tokens"), F.array_join(F.col("s.sums").cast("array<string>"), ",").alias("sums"))


def _spread_sql() -> str:
    m, k = "1540483477::UBIGINT", "(({0} * 1540483477::UBIGINT) % 4294967296)"
    seed, turned = 0x9E3779B9, 0x79B99E37

    def murmur(word: str, seed: int) -> str:
        """CASE-free MurmurHash2 of one word, step by step in a chain of lambdas."""
        a = f"list_transform([{k.format(word)}], lambda x: (xor(x, x >> 24) * {m}) % {_M32})[1]"
        b = f"list_transform([xor({seed * 0x5BD1E995 % (1 << 32)}::UBIGINT, {a})], lambda x: (xor(x, x >> 13) * {m}) % {_M32})[1]"
        return f"list_transform([{b}], lambda x: xor(x, x >> 15))[1]"

    chi = "SELECT '{0}' AS hash, round((sum(o * o) / (sum(o) / 4096) - sum(o)) / 4095, 9) AS chi2_by_dof FROM (SELECT h >> 20 AS b, count(*)::DOUBLE AS o FROM {1} GROUP BY 1)"
    return f"""WITH {_keys_sql('SELECT doc_id AS id, text FROM documents')},
keys AS MATERIALIZED (SELECT key FROM wkey UNION SELECT key FROM pair),{_fmix_sql("keys", "key", "f")},
g AS (SELECT xor({murmur(f"xor(key % {_M32}, {seed}::UBIGINT)", seed)}, {murmur(f"xor(key >> 32, {turned}::UBIGINT)", turned)}) AS h FROM keys),
s AS (SELECT xor(((key::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {_2_64})::UBIGINT >> 32, {seed}::UBIGINT) AS h FROM keys)
{chi.format("fmix32", "f")} UNION ALL {chi.format("murmur2", "g")} UNION ALL {chi.format("multiply_shift", "s")}"""


@_query("hash_spread", _spread_sql())
def hash_spread(spark, sf_dir):
    spread = train.hash_spreads(_docs(spark, sf_dir), 12)
    return spark.createDataFrame([(w, round(float(x), 9)) for w, x in spread.items()], "hash string, chi2_by_dof double")


@_query("augmented_mix")
def augmented_mix(spark, sf_dir):
    rows = mix.with_split(mix.dedup_first(_samples(spark, sf_dir)))
    return mix.augmented(rows, 0.3, 0.3).select("lang", "split", "_pos", "kind", F.md5("text").alias("digest"))


@_query("coverage_selection")
def coverage_selection(spark, sf_dir):
    pool = _sentence_samples(spark, sf_dir).select("lang", F.xxhash64("doc_id", "text").alias("row_id"), "text").distinct().withColumn("lemmas", tx.lemma_tokens("text"))
    return select.select_coverage(pool, budget=500)


@_query("document_windows")
def document_windows(spark, sf_dir):
    from ..sources.readers import windows

    return windows(_docs(spark, sf_dir).select("text", F.col("doc_id").alias("_pos")), 4, 42)
