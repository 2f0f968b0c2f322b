"""Vectorised words over Arrow string columns.

A word is a maximal run of ASCII letters and digits or of characters from
U+00C0 on, without the punctuation blocks U+2000-206F and U+3000-303F, in lower
case. The same rule as a regular expression is :data:`WORD_RE` (for lower-cased
text). Each word has a 64-bit hash: Horner's rule over its UTF-8 bytes with the
odd base :data:`BASE` modulo 2**64, then a finaliser. All words of a batch are
found and hashed at once from the Arrow buffers; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[0-9a-z\x{00C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Bytes of text that are worked on at once; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(MIX1)
    h ^= h >> _U(33)
    h = h * _U(MIX2)
    h ^= h >> _U(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                t = np.full(size, base, _U)
                t[0] = 1
                _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """``hash``, byte ``start`` and ``end`` of each word; words of document i
    are ``off[i]:off[i + 1]``; ``data`` is the lower-cased text of all."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    data: np.ndarray
    text_off: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = arr.buffers()
    off = np.frombuffer(o, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[off[0] : off[-1]] if d is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(arr: pa.Array) -> Words:
    """The words of each text of ``arr``."""
    data, toff = buffers(pc.utf8_lower(arr if pa.types.is_string(arr.type) else arr.cast(pa.string())))
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), z, z, np.zeros(len(toff), np.int64), data, toff)
    inside = _WORD[data]
    high = np.flatnonzero(data >= 0xC2)
    if len(high):
        lead = data[high]
        i = high[lead == 0xC2]
        inside[i] = inside[i + 1] = False
        i = high[lead == 0xE2]
        if len(i):
            a, b = data[i + 1], data[i + 2]
            i = i[(a == 0x80) | ((a == 0x81) & (b <= 0xAF))]
            inside[i] = inside[i + 1] = inside[i + 2] = False
        i = high[lead == 0xE3]
        if len(i):
            i = i[data[i + 1] == 0x80]
            inside[i] = inside[i + 1] = inside[i + 2] = False
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cut = toff[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):  # two documents meet inside a run of letters
        at = np.sort(np.concatenate([at, np.unique(cut), np.unique(cut)]))
    s, e = at[0::2], at[1::2]
    up, down = _power_tables(n)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(data * down[:n], out=total[1:])
    h = mix64((total[e] - total[s]) * up[e - 1])
    return Words(h, s, e, np.searchsorted(s, toff), data, toff)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def hash_word(word: str) -> int:
    """The hash of one word, in plain Python."""
    h, m = 0, (1 << 64) - 1
    for b in word.encode():
        h = (h * BASE + b) & m
    h ^= h >> 33
    h = h * MIX1 & m
    h ^= h >> 33
    h = h * MIX2 & m
    return h ^ (h >> 33)


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Order-dependent hash of each run of ``k`` words inside one document:
    (hash, index of the first word, offsets by document)."""
    n = np.maximum(np.diff(off) - (k - 1), 0)
    woff = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(off[:-1] - woff[:-1], n) + np.arange(woff[-1])
    acc = np.zeros(len(first), _U)
    for i in range(k):
        acc = acc * _U(BASE) + h[first + i]
    return mix64(acc), first, woff


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
