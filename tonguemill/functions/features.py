"""Hashed features of texts: character n-grams within words, whole words, word pairs.

A text is split at white space; one leading ``#`` is taken off each word and empty
words are dropped. A word is its lower-cased characters, or one sentinel for a web
address, mail address, mention or number, between a begin and an end mark. Each place in
it gives the n-grams that end there; then come the word's own key and the key of the
pair with the word before.

The batch form works on Arrow columns: words are split and dictionary-encoded there,
and only distinct words are ever looked at one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import hashing

BEGIN, END = 2, 3
SENTINEL = {"url": 0xE001, "email": 0xE002, "mention": 0xE003, "num": 0xE004}
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_GOLD = 0x9E3779B97F4A7C15
TAGS = [n * _GOLD & (1 << 64) - 1 for n in range(8)]  # 1..5: n-grams, 6: word, 7: pair
CP_BITS = 21
_U = np.uint64


@dataclass(frozen=True)
class FeatureConfig:
    """Lengths of the n-grams."""

    n_min: int = 1
    n_max: int = 5

    def __post_init__(self):
        if not 1 <= self.n_min <= self.n_max <= 5:
            raise ValueError("1 <= n_min <= n_max <= 5 is needed")


DEFAULT = FeatureConfig()
_DOMAIN = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_RULES = [
    ("word", re.compile(r"[^\x00-\x7f].*", re.S)),
    ("mention", re.compile(r"@.+", re.S)),
    ("url", re.compile(r"(?:https?://|www\.).*", re.S | re.I | re.A)),
    ("email", re.compile(rf"[A-Za-z0-9._%+-]+@{_DOMAIN}")),
    ("num", re.compile(r"(?=[^0-9]*[0-9])[\x00-\x7f]*", re.S)),
    ("url", re.compile(_DOMAIN)),
]


_SPECIAL = re.compile(r"[0-9@:]|\..|^www\.", re.S | re.I | re.A)


def classify_word(word: str) -> str:
    """word | url | email | mention | num, the first rule that fits."""
    if word.isalpha() or not _SPECIAL.search(word):  # all other classes need one of these
        return "word"
    return next((kind for kind, rule in _RULES if rule.fullmatch(word)), "word")


_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """Words by Unicode white space, ``#`` taken off."""
    found = _WHITE.split(text) if _ODD_SPACE.search(text) else text.split()
    return [w for w in (x[1:] if x.startswith("#") else x for x in found) if w]


def _lower(word: str) -> str:
    """Letter by letter, so that no letter's form depends on its place."""
    return word.lower() if word.isascii() or "Σ" not in word else "".join(c.lower() for c in word)


def _letters(word: str) -> str:
    kind = classify_word(word)
    return chr(SENTINEL[kind]) if kind != "word" else _lower(word)


def _all_letters(words: list[str]) -> list[str]:
    return [w.lower() if w.isalpha() and "Σ" not in w else _letters(w) for w in words]


def word_lengths(words: list[str]) -> np.ndarray:
    """Characters that each word's features are made of."""
    return np.fromiter(map(len, _all_letters(words)), np.int64, len(words))


@dataclass
class WordTable:
    """Keys of distinct words: those of word i are ``keys[off[i]:off[i + 1]]``, the
    last of them its own; ``hash`` is the hash that pairs are made of."""

    keys: np.ndarray
    off: np.ndarray
    hash: np.ndarray


def word_table(words: list[str], cfg: FeatureConfig = DEFAULT) -> WordTable:
    """Keys of all words at once, in order of place, then n."""
    if not words:
        return WordTable(np.zeros(0, _U), np.zeros(1, np.int64), np.zeros(0, _U))
    letters = _all_letters(words)
    joined = "".join(letters)
    flat = np.frombuffer(joined.encode("utf_32_le", errors="surrogatepass"), np.uint32)
    n = np.array([len(x) for x in letters])
    start = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        h = np.full(len(words), FNV_START, _U)
        by_length = np.argsort(-n, kind="stable")
        live = len(words)
        for i in range(int(n.max())):
            live = int(np.searchsorted(-n[by_length], -i, "left"))
            w = by_length[:live]
            h[w] = (h[w] ^ flat[start[w] + i].astype(_U)) * _U(FNV_PRIME)
        own = h ^ _U(TAGS[6])
        size = n + 2
        off = np.cumsum(size) - size
        cps = np.empty(int(size.sum()), _U)
        cps[off] = BEGIN
        cps[off + size - 1] = END
        inner = np.ones(len(cps), bool)
        inner[off] = inner[off + size - 1] = False
        cps[inner] = flat
        place = np.arange(len(cps)) - np.repeat(off, size)
        before = lambda k: np.where(place >= k, np.concatenate([np.zeros(k, _U), cps[:-k]]) if k < len(cps) else np.zeros(len(cps), _U), _U(0))
        one = cps
        two = one | before(1) << _U(CP_BITS)
        three = two | before(2) << _U(2 * CP_BITS)
        register = three | before(3) << _U(3 * CP_BITS)  # older characters have left the register
        grams = {1: one, 2: two, 3: three, 4: register, 5: register}
        columns = [np.where(place >= k - 1, grams[k] ^ _U(TAGS[k]), _U(0)) for k in range(cfg.n_min, cfg.n_max + 1)]
        valid = np.stack([place >= k - 1 for k in range(cfg.n_min, cfg.n_max + 1)], 1)
        matrix = np.stack(columns, 1)
    per_place = valid.sum(1)
    per_word = np.add.reduceat(per_place, off) + 1
    out_off = np.concatenate([[0], np.cumsum(per_word)])
    keys = np.empty(int(out_off[-1]), _U)
    last = np.zeros(len(keys), bool)
    last[out_off[1:] - 1] = True
    keys[~last] = matrix[valid]
    keys[last] = own
    return WordTable(keys, out_off, h)


def pair_keys(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = prev ^ (cur << _U(32) | cur >> _U(32))
        x ^= x >> _U(33)
        x *= _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(33)
        x *= _U(0xC4CEB9FE1A85EC53)
        x ^= x >> _U(33)
        return x ^ _U(TAGS[7])


@dataclass
class Encoded:
    """Words of a batch of texts as indexes into distinct words."""

    index: np.ndarray
    off: np.ndarray
    table: WordTable


def word_lists(texts: pa.Array) -> pa.Array:
    """Runs without Unicode white space of each text; none of null. An empty one may stand at the ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # not white space here
        return pa.array([_WHITE.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of a batch: (indexes into distinct words, offsets by text, distinct words)."""
    lists = word_lists(texts)
    flat = lists.flatten().dictionary_encode()
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
    if pc.any(pc.starts_with(flat.dictionary, "#")).as_py():
        distinct = [w[1:] if w.startswith("#") else w for w in distinct]
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
    if not kept.all():
        good = kept[index]
        off = np.concatenate([[0], np.cumsum(good)])[off]
        number = np.cumsum(kept) - 1
        index = number[index[good]]
        distinct = [w for w in distinct if w]
    return index, off, distinct


def encode(texts: pa.Array, cfg: FeatureConfig = DEFAULT) -> Encoded:
    """Split, dictionary-encode, and make the keys of the distinct words."""
    index, off, distinct = split(texts)
    return Encoded(index, off, word_table(distinct, cfg))


def text_keys(texts: pa.Array, cfg: FeatureConfig = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts in order, offsets by text)."""
    e = encode(texts, cfg)
    t = e.table
    size = t.off[e.index + 1] - t.off[e.index]
    first = np.zeros(len(e.index), bool)
    first[e.off[:-1][e.off[:-1] < len(e.index)]] = True
    has_pair = ~first
    total = size + has_pair
    begin = np.cumsum(total) - total
    keys = np.empty(int(total.sum()), _U)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    keys[at] = t.keys[np.repeat(t.off[e.index] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    where = np.flatnonzero(has_pair)
    keys[begin[where] + size[where]] = pair_keys(t.hash[e.index[where - 1]], t.hash[e.index[where]])
    return keys, np.concatenate([[0], np.cumsum(total)])[e.off]


def token_keys(text: str | None, cfg: FeatureConfig = DEFAULT) -> list[int]:
    return [int(k) for k in text_keys(pa.array([text]), cfg)[0]]


def bucket_tokens(texts: pa.Array, log2_d: int, which: str = "fmix32", seed: int = hashing.SEED, cfg: FeatureConfig = DEFAULT) -> tuple[np.ndarray, ...]:
    """(buckets, signs, offsets by text)."""
    keys, off = text_keys(texts, cfg)
    b, neg = hashing.buckets(keys, log2_d, which, seed)
    return b, neg, off


def signed_ids(texts: pa.Array, log2_d: int, which: str = "fmix32", seed: int = hashing.SEED, cfg: FeatureConfig = DEFAULT, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the doubled table, offsets); the first ``k`` of each text if given."""
    b, neg, off = bucket_tokens(texts, log2_d, which, seed, cfg)
    ids = hashing.signed_index(b, neg, log2_d)
    if k is None:
        return ids, off
    n = np.minimum(np.diff(off), k)
    at = np.repeat(off[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return ids[at], np.concatenate([[0], np.cumsum(n)])
