"""Document fingerprints: closed syncmers over words.

A k-mer is a run of ``k`` words of one document; its s-mers are its
``k - s + 1`` runs of ``s`` words. The k-mer is chosen when its smallest s-mer
hash stands at its first or last place (a tie with an edge counts). Whether it is
chosen depends on nothing but its own words, so equal passages give equal anchors
at equal distances whatever surrounds them, and of any ``k - s`` consecutive
k-mers at least one is chosen. Nothing is shuffled: one pass over the text.

Nulls and odd input: a null or empty text, or one of fewer than ``k`` words, has
no anchors; very long texts give all of theirs; of equal smallest s-mers (ties) each counts; a null
``doc_id`` is carried along; a repeated row gives its anchors again; an empty table gives none; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk
from .tables import session_of

K, S = 12, 4
SCHEMA = "doc_id bigint, pos int, anchor bigint"


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    have, m = 1, h
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - have : len(h) - have + 1]) if have < w else m


def anchors(w: tk.Words, k: int = K, s: int = S) -> tuple[np.ndarray, ...]:
    """(document index, word position, k-mer hash) of each closed syncmer."""
    kh, first, koff = tk.windows(w.hash, w.off, k)
    if not len(kh):
        z = np.zeros(0, np.int64)
        return z, z, kh
    sm, _, soff = tk.windows(w.hash, w.off, s)
    doc = np.repeat(np.arange(len(koff) - 1), np.diff(koff))
    at = soff[doc] + (np.arange(len(kh)) - koff[doc])
    span = k - s + 1
    least = sliding_min(sm, span)[at]
    chosen = (sm[at] == least) | (sm[at + span - 1] == least)
    return doc[chosen], (first - w.off[doc])[chosen], kh[chosen]


def closed_syncmers(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row (doc_id, pos, anchor) for each closed syncmer of each document."""
    if not 0 < s < k:
        raise ValueError("0 < s < k is needed")
    session_of(docs)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                d, pos, h = anchors(tk.words(b.column(1)), k, s)
                if len(d):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(pos.astype(np.int32)), pa.array(tk.signed(h))], ["doc_id", "pos", "anchor"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return closed_syncmers(table(spark, sf_dir, "documents"))




def _sql(k: int = K, s: int = S) -> str:
    def roll(n: int, name: str) -> str:
        x = "h::UHUGEINT"
        for i in range(1, n):
            x = f"(({x}) * {tk.BASE}::UHUGEINT + lead(h, {i}) OVER o) % 18446744073709551616::UHUGEINT"
        return f"({x})::UBIGINT AS {name}"

    def mixed(table: str, columns: list[str], keep: str) -> str:
        a = ", ".join(f"((xor({c}, {c} >> 33)::UHUGEINT * {tk.MIX1}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS {c}" for c in columns)
        b = ", ".join(f"((xor({c}, {c} >> 33)::UHUGEINT * {tk.MIX2}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS {c}" for c in columns)
        c_ = ", ".join(f"xor({c}, {c} >> 33) AS {c}" for c in columns)
        return f"(SELECT {keep}, {c_} FROM (SELECT {keep}, {b} FROM (SELECT {keep}, {a} FROM {table})))"

    span = k - s
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{tk.WORD_RE}') AS ws FROM documents),
t AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM d),
v0 AS (SELECT w, list_reduce(list_prepend(0::UHUGEINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::UTINYINT::UHUGEINT)),
    lambda acc, x: (acc * {tk.BASE}::UHUGEINT + x) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM (SELECT DISTINCT w FROM t)),
v AS {mixed("v0", ["h"], "w")},
h AS (SELECT doc_id, pos, h FROM t JOIN v USING (w)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, {roll(s, "sm")}, {roll(k, "km")} FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS {mixed("r", ["sm", "km"], "doc_id, pos, n")},
g AS (SELECT doc_id, pos, n, sm, km, min(sm) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {span} FOLLOWING) AS least,
    lead(sm, {span}) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM m)
SELECT doc_id, pos::INTEGER AS pos, (CASE WHEN km >= 9223372036854775808 THEN km::HUGEINT - 18446744073709551616 ELSE km::HUGEINT END)::BIGINT AS anchor
FROM g WHERE pos + {k} <= n AND (sm = least OR last = least)"""


SQL = _sql()
