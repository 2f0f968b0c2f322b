"""Runs of words in Arrow columns, counted over a whole table.

Almost all runs of two or three words are different, so partial aggregates of rows don't help
and rows of strings are costly to move. Here a task counts the runs of some texts, and sends them on
as packed bytes by range of a hash; ranges are counted one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import features

#: Bytes of text whose runs are made at once, runs that a task holds before it sends them on, ranges, and rows of a result's batch.
PIECE_BYTES, HELD_RUNS, RANGES, OUT_ROWS = 2 << 20, 1 << 19, 4096, 50_000
_U = np.uint64
_ODD, _EVEN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, a few at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
        yield texts.slice(i, j - i)
        i = j


def _hash(words: pa.Array) -> np.ndarray:
    """64 bits of each string, by its bytes alone."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    words = pa.concat_arrays([words])
    _, offsets, body = words.buffers()
    off = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    size = np.diff(off)
    h = size.astype(_U)
    data = np.frombuffer(body or b"", np.uint8)
    with np.errstate(over="ignore"):
        by_length = np.argsort(-size, kind="stable")
        falling = -size[by_length]
        for i in range(int(size.max())):
            w = by_length[: int(np.searchsorted(falling, -i, "left"))]
            h[w] = (h[w] ^ data[off[w] + i]) * _ODD
            if len(w) < 4:  # a few very long ones: their first bytes will do
                if i > 1000:
                    break
        return h ^ h >> _U(29)


class Words:
    """The words with a letter of some texts."""

    def __init__(self, texts: pa.Array):
        lists = features.word_lists(texts)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        self.distinct = flat.dictionary
        index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        good = pc.match_substring_regex(self.distinct, r"\p{L}").to_numpy(zero_copy_only=False)[index]
        self.owner, self.index = np.repeat(np.arange(len(size)), size)[good], index[good]

    def runs(self, k: int) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
        """(text of each run of ``k`` words, the run joined by spaces, its words)."""
        m = max(0, len(self.index) - k + 1)
        at = np.flatnonzero(self.owner[:m] == self.owner[k - 1 :][:m])
        ids = [self.index[at + i] for i in range(k)]
        words = [self.distinct.take(pa.array(x)) for x in ids]
        return self.owner[at], words[0] if k == 1 else pc.binary_join_element_wise(*words, " "), ids


def _marked(by: pa.Array) -> pa.Array:
    """Values as the beginning of a key; null is one of them. A run holds no line end."""
    by = by.cast(pa.string())
    return pc.if_else(pc.is_null(by), "0\n", pc.binary_join_element_wise("1", pc.fill_null(by, ""), "\n", ""))


def packed_runs(k: int):
    """mapInArrow: (by, text) to (part, ends, body, counts): keys of runs with how often they were seen."""

    def send(keys: list[pa.Array], hashes: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        order = np.argsort(h)
        h, body = h[order], pa.concat_arrays(keys).take(pa.array(order))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        again = np.flatnonzero(~new)
        if len(again):
            if pc.all(pc.equal(body.take(pa.array(again)), body.take(pa.array(again - 1)))).as_py():
                first = np.flatnonzero(new)
                body, h, n = body.take(pa.array(first)), h[first], np.diff(np.append(first, len(h))).astype(np.int64)
            else:  # two runs with one hash: counted apart
                n = np.ones(len(h), np.int64)
        else:
            n = np.ones(len(h), np.int64)
        part = (h >> _U(64 - RANGES.bit_length() + 1)).astype(np.int32)
        ends = np.frombuffer(body.buffers()[1], np.int32)[: len(body) + 1]
        data = memoryview(body.buffers()[2])
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        rows = [(int(part[i]), (ends[i + 1 : j + 1] - ends[i]).tobytes(), bytes(data[ends[i] : ends[j]]), n[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3)]], ["part", "ends", "body", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, held = [], [], 0
        for b in batches:
            at, by = 0, _marked(b.column(0))
            some = by.dictionary_encode()
            hashes_by = pa.array(_hash(some.dictionary)[some.indices.to_numpy(zero_copy_only=False)])
            for piece in pieces(b.column(1)):
                w = Words(piece)
                owner, runs, ids = w.runs(k)
                mine = by.slice(at, len(piece)).take(pa.array(owner))
                if not len(owner):
                    at += len(piece)
                    continue
                keys.append(pc.binary_join_element_wise(mine, runs, ""))
                hw, h = _hash(w.distinct), hashes_by.slice(at, len(piece)).to_numpy(zero_copy_only=False)[owner]
                at += len(piece)
                with np.errstate(over="ignore"):
                    for x in ids:
                        h = (h ^ hw[x]) * _EVEN
                        h ^= h >> _U(32)
                    hashes.append(h * _ODD)
                held += len(owner)
                if held >= HELD_RUNS:
                    yield send(keys, hashes)
                    keys, hashes, held = [], [], 0
        if held:
            yield send(keys, hashes)

    return run


def _counted(name: str):
    def count(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ends, bodies, counts = zip(*parts)
        ends = [np.frombuffer(x, np.int32) for x in ends]
        base = np.cumsum([0, *[len(x) for x in bodies]])
        off = np.concatenate([[0], *[x + s for x, s in zip(ends, base)]])
        if off[-1] < 1 << 31:
            keys = pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(b"".join(bodies))])
        else:
            keys = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(b"".join(bodies))])
        enc = keys.dictionary_encode()
        n = np.zeros(len(enc.dictionary), np.int64)
        np.add.at(n, enc.indices.to_numpy(zero_copy_only=False), np.frombuffer(b"".join(counts), np.int64))
        for i in range(0, len(n), OUT_ROWS):
            some = pc.split_pattern(enc.dictionary.slice(i, OUT_ROWS), "\n", max_splits=1, reverse=True)
            by, runs = pc.list_element(some, 0).cast(pa.string()), pc.list_element(some, 1).cast(pa.string())
            by = pc.if_else(pc.equal(by, "0"), pa.scalar(None, pa.string()), pc.utf8_slice_codeunits(by, 1))
            yield pa.RecordBatch.from_arrays([by, runs, pa.array(n[i : i + OUT_ROWS])], [name, "fragment", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            for part, *row in zip(*(b.column(c).to_pylist() for c in range(4))):
                if part != now and held:
                    yield from count(held)
                    held = []
                now = part
                held.append(row)
        if held:
            yield from count(held)

    return run


def counts(rows: DataFrame, by: str, k: int, text: str = "text") -> DataFrame:
    """(by, fragment, n): how often each run of ``k`` words with a letter occurs by the string column ``by``."""
    parts = rows.select(by, text).mapInArrow(packed_runs(k), "part int, ends binary, body binary, counts binary").repartition("part").sortWithinPartitions("part")
    return parts.mapInArrow(_counted(by), f"`{by}` string, fragment string, n bigint")


def in_pieces(sizes: tuple[int, ...] = (1, 2, 3)):
    """mapInArrow: (gold, text) to (gold, n, text, c): runs of ``n`` words, each once for some texts, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, gold = 0, b.column(0).cast(pa.string()).dictionary_encode()
            for piece in pieces(b.column(1)):
                w, mine = Words(piece), gold.slice(at, len(piece)).indices
                mine = pc.fill_null(mine, len(gold.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                at += len(piece)
                names = pa.concat_arrays([gold.dictionary, pa.nulls(1, pa.string())])
                for k in sizes:
                    owner, runs, _ = w.runs(k)
                    if not len(owner):
                        continue
                    enc = runs.dictionary_encode()
                    both = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + mine[owner]
                    one, c = np.unique(both, return_counts=True)
                    for i in range(0, len(one), OUT_ROWS):
                        x = one[i : i + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(x % len(names))), pa.array(np.full(len(x), k, np.int32)), enc.dictionary.take(pa.array(x // len(names))), pa.array(c[i : i + OUT_ROWS].astype(np.int64))], ["gold", "n", "text", "c"])

    return run
