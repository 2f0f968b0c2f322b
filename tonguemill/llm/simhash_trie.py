"""SimHash near-dedup: binary trie self-join.

A document's fingerprint has 128 bits: each distinct word votes with a weight that grows
with the logarithm of its count. Two documents are near copies when their fingerprints
differ in at most :data:`BUDGET` bits (and, only where a ``ratio`` is given, their numbers of
distinct words are within it). Groups are the connected components.

The join traverses a binary trie of fingerprints against itself. A step takes pairs of
nodes at one level, extends each to the pairs of their children, adds up differing bits, and
drops a pair as soon as its budget is exceeded; a subtree with few fingerprints is a
leaf, and pairs of leaves are settled by counting the bits that are left. All node pairs of a
level are handled at once as arrays; leaves are compared by shifting one array along itself.

To spread the trie over tasks, its levels are permuted. Of the two halves of the fingerprint
one differs in at most BUDGET // 2 bits, and of that half's two 32-bit words one in at most BUDGET // 4.
Masks of 16 or 17 bits cover such words (see :class:`Covering`): of any two, one mask at least has no
bit that differs. So each fingerprint goes to a cell for each
word and each mask, with the word's bits under it (124 cells of 16 or 17 bits), and
in its cell the trie is walked with the word's bits on top, where only BUDGET // 4 differences
are allowed, and BUDGET // 2 in its half. Fingerprints travel packed by groups of cells, as one binary
value for each group and batch. Cells are counted where one might be hot. One of more than
:data:`CELL` fingerprints is split by a block of its other three words (one of them differs in
at most BUDGET // 3 bits, and one of its seven blocks not at all); what is still too large
is cut into parts by its own count, and each pair of parts is a cell. No pair within the budget
is missed, and each is counted in the first cell that it shares only.

Equal fingerprints are one node, so thousands of exact copies cost one row. Of the
pairs that a task finds it returns a spanning forest, which has the same components, and the
number of links of each fingerprint.

Nulls and odd input: a text without words (null, empty, marks only) has no
fingerprint and is in no group; very long texts are read whole; a null ``doc_id`` counts as the
largest; rows that are repeated are copies; of each group the row with the smallest (doc_id, text
hash) stays, one of them where rows are wholly equal; an empty table gives no groups; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .components import connected_components
from .tables import fresh, quoted, sent_if_small, session_of, table, written

BUDGET, RATIO = 19, 0.0
WORDS, BLOCKS = 4, 6
CELL = 200_000
LEAF = 256  # fingerprints of a node that are compared one by one
COVER = 7  # differences up to which masks are used; their number doubles with each
GROUP = 1 << 14  # rows of a group of cells, about
_SALT = np.uint64(0xA24BAED4963EE407)


def fingerprints(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) 64-bit halves and the number of distinct words of each document."""
    docs = len(w.off) - 1
    out, count = np.zeros((docs, 2), np.uint64), np.zeros(docs, np.int64)
    if not len(w.hash):
        return out, count
    shift = np.uint64(44)
    key = np.sort((w.doc.astype(np.uint64) << shift) | (w.hash >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    doc = (key >> shift).astype(np.int64)
    a = tk.mix64((key & np.uint64((1 << 44) - 1)) * np.uint64(tk.BASE))
    bits = np.unpackbits(np.stack([a, tk.mix64(a ^ _SALT)], 1).view(np.uint8), axis=1, bitorder="little")
    weight = (1 + np.floor(np.log2(tf))).astype(np.uint8)
    bits *= weight[:, None]
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    have = doc[begin]
    votes = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    total = np.add.reduceat(weight, begin, dtype=np.int32)
    out[have] = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(np.uint64)
    count[have] = np.diff(np.concatenate([begin, [len(doc)]]))
    return out, count


def name(halves: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The id of a fingerprint (low and high half) and size."""
    with np.errstate(over="ignore"):
        return tk.signed(tk.mix64(tk.mix64(halves[:, 0] * np.uint64(tk.BASE) + n.astype(np.uint64)) ^ tk.mix64(halves[:, 1])))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, id, hi, lo, n) of each row with words; equal fingerprints and sizes have one id."""
    session_of(docs)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                f, n = fingerprints(tk.words(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name(f, n)), pa.array(tk.signed(f[:, 1].copy())), pa.array(tk.signed(f[:, 0].copy())), pa.array(n.astype(np.int32))], ["doc_id", "text_key", "id", "hi", "lo", "n"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, id bigint, hi bigint, lo bigint, n int")


def _bits32(x: np.ndarray, n: int) -> np.ndarray:
    return ((x[:, None] >> np.arange(n - 1, -1, -1, dtype=x.dtype)) & 1).astype(np.uint8)


def trie_pairs(top: np.ndarray, halves: np.ndarray, size: np.ndarray, top_budget: int | np.ndarray, budget: int, ratio: float, cell: np.ndarray | None = None, part: np.ndarray | None = None, wide: np.ndarray | None = None, wide_budget: int | None = None) -> Iterator[np.ndarray]:
    """Arrays of pairs (i, j) whose ``top`` words (uint32) differ in at most ``top_budget`` bits (one number, or one by row and alike in a cell),
    their ``halves`` (n, 2 uint64) in at most ``budget``, and whose sizes are
    within ``ratio``. With ``cell``, only pairs within one cell; with ``part``,
    only pairs of different parts where they are not negative; with ``wide`` (uint64), only
    pairs that differ in at most ``wide_budget`` of its bits. The tries of all
    cells and size classes are walked together."""
    if wide is None:
        wide, wide_budget = halves[:, 0], budget
    if ratio <= 0:
        klass = np.zeros(len(top), np.int64)
    else:
        klass = np.floor(np.log(np.maximum(size, 1)) / -np.log(ratio)).astype(np.int64) if ratio < 1 else size.astype(np.int64)
    cell = np.zeros(len(top), np.int64) if cell is None else cell
    part = np.full(len(top), -1, np.int64) if part is None else part
    if not len(top):
        return
    order = np.argsort(cell) if ratio <= 0 else np.lexsort((top, klass, cell))
    cell, klass = cell[order], klass[order]
    begin = np.flatnonzero(np.concatenate([[True], (klass[1:] != klass[:-1]) | (cell[1:] != cell[:-1])]))
    end = np.concatenate([begin[1:], [len(klass)]])
    if ratio <= 0:  # only where the trie is walked must it be in order
        at = np.flatnonzero(np.repeat(end - begin > LEAF, end - begin))
        order[at] = order[at][np.lexsort((top[order[at]], cell[at]))]
    top_budget = np.broadcast_to(top_budget, len(top))
    row_top, row_budget = top, top_budget
    top, wide, top_budget = top[order], wide[order], top_budget[order]
    next_to = np.flatnonzero((cell[begin[1:]] == cell[begin[:-1]]) & (klass[begin[1:]] == klass[begin[:-1]] + 1))
    roots = np.concatenate([np.stack([begin, end, begin, end], 1), np.stack([begin[next_to], end[next_to], begin[next_to + 1], end[next_to + 1]], 1)])
    roots = roots[(roots[:, 1] - roots[:, 0] > 1) | (roots[:, 0] != roots[:, 2])]
    stack = [(roots, np.zeros(len(roots), np.int64), 0)]
    while stack:
        pair, diff, level = stack.pop()
        if len(pair) > 1 << 17:  # bounds the frontier's memory
            half = len(pair) // 2
            stack.append((pair[:half], diff[:half], level))
            pair, diff = pair[half:], diff[half:]
        width = np.maximum(pair[:, 1] - pair[:, 0], pair[:, 3] - pair[:, 2])
        leaf = (width <= LEAF) | (level == 32)
        if leaf.any():
            for i, j in _leaves(pair[leaf], wide, wide_budget):
                i, j = order[i], order[j]
                good = np.bitwise_count(row_top[i] ^ row_top[j]) <= row_budget[i]
                i, j = i[good], j[good]
                good = np.bitwise_count(halves[i, 0] ^ halves[j, 0]).astype(np.int64) + np.bitwise_count(halves[i, 1] ^ halves[j, 1]) <= budget
                good &= (part[i] != part[j]) | (part[i] < 0)
                if ratio > 0:
                    good &= np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
                if good.any():
                    yield np.stack([i[good], j[good]], 1)
            pair, diff = pair[~leaf], diff[~leaf]
        if not len(pair):
            continue
        mask = np.uint32(1 << (31 - level))
        # a node's fingerprints agree above this level, so those with the bit set come last
        cut = []
        for lo, hi in ((pair[:, 0], pair[:, 1]), (pair[:, 2], pair[:, 3])):
            prefix = top[lo] & ~np.uint32((1 << (32 - level)) - 1) if level else np.zeros(len(lo), np.uint32)
            target = prefix | mask
            cut.append(_lower(top, lo, hi, target))
        same, most = pair[:, 0] == pair[:, 2], top_budget[pair[:, 0]]
        a0, a1 = (pair[:, 0], cut[0]), (cut[0], pair[:, 1])
        b0, b1 = (pair[:, 2], cut[1]), (cut[1], pair[:, 3])
        nxt, nd = [], []
        for x, y, add, mine in ((a0, b0, 0, None), (a1, b1, 0, None), (a0, b1, 1, None), (a1, b0, 1, ~same)):
            ok = (x[1] > x[0]) & (y[1] > y[0]) & (diff + add <= most)
            if mine is not None:
                ok &= mine
            nxt.append(np.stack([x[0][ok], x[1][ok], y[0][ok], y[1][ok]], 1))
            nd.append(diff[ok] + add)
        pair, diff = np.concatenate(nxt), np.concatenate(nd)
        if len(pair):
            stack.append((pair, diff, level + 1))


def trie_join(*args, **kw) -> np.ndarray:
    """All pairs of :func:`trie_pairs` in one array."""
    return np.concatenate([np.zeros((0, 2), np.int64), *trie_pairs(*args, **kw)])


def _lower(top: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose value is at least ``target``, for many ranges."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        less = open_ & (top[np.minimum(mid, len(top) - 1)] < target)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def _leaves(pair: np.ndarray, wide: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of rows (i, j) of two nodes that differ in at most ``budget`` bits of ``wide``."""
    same = pair[:, 0] == pair[:, 2]
    yield from _within(pair[same, 0], pair[same, 1], wide, budget)
    pair = pair[~same]
    na, nb = pair[:, 1] - pair[:, 0], pair[:, 3] - pair[:, 2]
    many = na * nb >= 1 << 12
    left, right, held = [], [], 0
    for a0, a1, b0, b1 in pair[many].tolist():
        step = max(1, (1 << 16) // (b1 - b0))
        for a in range(a0, a1, step):
            found = np.flatnonzero(np.bitwise_count(wide[a : min(a + step, a1), None] ^ wide[b0:b1]) <= budget)
            if len(found):
                i, j = np.divmod(found, b1 - b0)
                left.append(i + a)
                right.append(j + b0)
                held += len(found)
            if held > 1 << 14:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)
    yield from _across(pair[~many], na[~many], nb[~many], wide, budget)


def _within(begin: np.ndarray, end: np.ndarray, wide: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same within each of many ranges: the ranges side by side, the longest first, are held
    against themselves shifted by 1, 2 and so on."""
    order = np.argsort(begin - end)
    begin, width = begin[order], (end - begin)[order]
    total = np.cumsum(width)
    start = 0
    while start < len(width):  # about so many rows as a processor keeps at hand
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + (1 << 14), "right")))
        w, last = width[start:stop], total[start:stop] - done
        row = np.repeat(begin[start:stop] - (last - w), w) + np.arange(last[-1])
        own = np.repeat(np.arange(len(w)), w)
        x = wide[row]
        differ, count, near = np.empty(len(x), np.uint64), np.empty(len(x), np.uint8), np.empty(len(x), bool)
        longer = last[np.searchsorted(-w, -np.arange(1, w[0]), "left") - 1].tolist()  # rows of ranges longer than the shift
        at, shifts = [], []
        for shift, rows in enumerate(longer, 1):
            n = rows - shift
            np.bitwise_xor(x[shift:rows], x[:n], out=differ[:n])
            np.bitwise_count(differ[:n], out=count[:n])
            np.less_equal(count[:n], budget, out=near[:n])
            found = np.flatnonzero(near[:n])
            if len(found):
                found = found[own[found] == own[found + shift]]
                if len(found) > 1 << 12:
                    yield row[found], row[found + shift]
                else:
                    at.append(found)
                    shifts.append(shift)
        if at:
            i = np.concatenate(at)
            yield row[i], row[i + np.repeat(shifts, [len(f) for f in at])]
        start = stop


def _across(pair: np.ndarray, na: np.ndarray, nb: np.ndarray, wide: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of many pairs of small nodes."""
    row = np.repeat(pair[:, 0] - (np.cumsum(na) - na), na) + np.arange(int(na.sum()))
    begin, n = np.repeat(pair[:, 2], na), np.repeat(nb, na)
    total = np.cumsum(n)
    start = 0
    while start < len(row):  # about half a million at once
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 19), "right")))
        m = n[start:stop]
        j = np.repeat(begin[start:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        near = np.flatnonzero(np.bitwise_count(np.repeat(wide[row[start:stop]], m) ^ wide[j]) <= budget)
        yield row[start:stop][np.searchsorted(np.cumsum(m), near, "right")], j[near]
        start = stop


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """A forest of (node, smallest node) edges with the components of the pairs on ``n`` nodes."""
    least = np.arange(n)
    while len(pairs):
        low = np.minimum(least[pairs[:, 0]], least[pairs[:, 1]])
        new = least.copy()
        for side in (0, 1):
            np.minimum.at(new, least[pairs[:, side]], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
        pairs = pairs[least[pairs[:, 0]] != least[pairs[:, 1]]]
    while (least[least] != least).any():
        least = least[least]
    at = np.flatnonzero(least != np.arange(n))
    return np.stack([at, least[at]], 1)


class Pigeonhole:
    """Choices of blocks of a 32-bit word: of ``n`` neighbouring blocks, ``n - most`` at least are equal
    in words that differ in ``most`` bits."""

    def __init__(self, n: int, most: int):
        at = [32 * i // n for i in range(n + 1)]
        self.most, self.blocks = most, [(32 - e, (1 << (e - a)) - 1) for a, e in zip(at, at[1:])]
        self.choices = list(combinations(range(n), n - most))

    def values(self, word: np.ndarray) -> Iterator[np.ndarray]:
        """The value of each choice's blocks."""
        for choice in self.choices:
            out = np.zeros(len(word), np.int64)
            for k in choice:
                shift, mask = self.blocks[k]
                out = out << mask.bit_length() | (word >> np.uint32(shift) & np.uint32(mask)).astype(np.int64)
            yield out

    def first(self, x: np.ndarray) -> np.ndarray:
        """The first choice whose blocks have no bit in ``x``, or -1."""
        out = np.full(len(x), -1)
        same = [(x >> np.uint32(shift) & np.uint32(mask)) == 0 for shift, mask in self.blocks]
        for c in range(len(self.choices) - 1, -1, -1):
            out[np.logical_and.reduce([same[k] for k in self.choices[c]])] = c
        return out


class Covering:
    """Masks of a 32-bit word. Each bit has a vector of ``most + 1`` bits that isn't zero, and each
    such vector v a mask of the bits whose vectors have an odd product with v. ``most`` differences
    leave a v that is orthogonal to the vectors of all, so its mask has none of them.
    All masks have about half of the bits, where as many choices of blocks would have fewer."""

    def __init__(self, most: int):
        every = (1 << most + 1) - 1
        vectors = [1 + i % every for i in range(32)]
        self.most = most
        self.choices = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, every + 1)]

    def values(self, word: np.ndarray) -> Iterator[np.ndarray]:
        for mask in self.choices:
            yield (word & np.uint32(mask)).astype(np.int64)

    def first(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1)
        for c in range(len(self.choices) - 1, -1, -1):
            out[x & np.uint32(self.choices[c]) == 0] = c
        return out


@dataclass
class Cells:
    """The cells of fingerprints: a word, a mask of it and the value under it; besides, a block
    and its value in a second word where that is ``hot``; and two parts where that is hot, too.
    Codes in ``hot`` are sorted; ``parts`` go with ``hot2``."""

    budget: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot2: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        most, most2 = self.budget // WORDS, self.budget // (WORDS - 1)
        self.one = Covering(most) if most <= COVER else Pigeonhole(max(BLOCKS, most + 1), most)
        self.two = Pigeonhole(most2 + 1, most2)

    @property
    def most(self) -> tuple[int, int]:
        return self.one.most, self.two.most

    def first(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """Codes of a word, a choice, and its value: one array for each word and choice."""
        for w in range(WORDS):
            for k, value in enumerate(self.one.values(words[:, w])):
                yield (w << 8 | k) << 32 | value

    def second(self, words: np.ndarray, code: np.ndarray) -> Iterator[np.ndarray]:
        """The same for each other word, within first cells ``code``."""
        own, every = code >> 40, np.arange(len(words))
        for step in range(1, WORDS):
            w = (own + step) % WORDS
            for k, value in enumerate(self.two.values(words[every, w])):
                yield _named(code, w << 8 | k, value)

    def all(self, words: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, cell, kind) of every cell of the fingerprints; see :func:`_kind`."""
        n1, n2 = len(self.one.choices), len(self.two.choices)
        none = np.int64(-1)
        for c, code in enumerate(self.first(words)):
            hot = _among(code, self.hot)
            cold = np.flatnonzero(~hot)
            yield cold, code[cold], np.full(len(cold), _kind(np.int64(c // n1), np.int64(c % n1), none, none, none))
            at = np.flatnonzero(hot)
            if not len(at):
                continue
            for c2, code2 in enumerate(self.second(words[at], code[at])):
                rest = (np.int64((c // n1 + 1 + c2 // n2) % WORDS), np.int64(c2 % n2), np.int64(c // n1), np.int64(c % n1))
                hot2 = _among(code2, self.hot2)
                f = np.flatnonzero(~hot2)
                yield at[f], code2[f], np.full(len(f), _kind(*rest, none))
                f = np.flatnonzero(hot2)
                if len(f):
                    parts = self.parts[np.searchsorted(self.hot2, code2[f])]
                    own = (ids[at[f]].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
                    for other in range(int(parts.max())):
                        g = np.flatnonzero(other < parts)
                        lo, hi = np.minimum(own[g], other), np.maximum(own[g], other)
                        yield at[f[g]], _named(code2[f[g]], lo, hi), _kind(*rest, np.where(lo == hi, -1, own[g]))

    def mine(self, x: np.ndarray, word: np.ndarray, block: np.ndarray, word1: np.ndarray, block1: np.ndarray) -> np.ndarray:
        """Whether pairs that differ by ``x`` (n, 4 uint32) share this cell first."""
        every = np.arange(len(x))
        own, choice = np.where(word1 < 0, word, word1), np.where(word1 < 0, block, block1)
        count = np.bitwise_count(x)
        low = (count <= self.one.most) & np.repeat(count[:, ::2] + count[:, 1::2] <= self.budget // 2, 2, axis=1)
        good = (low.argmax(1) == own) & low[every, own] & (self.one.first(x[every, own]) == choice)
        inner = np.flatnonzero(good & (word1 >= 0))
        if len(inner):
            y, step = x[inner], (word[inner] - word1[inner]) % WORDS
            few = np.arange(len(y))
            turn = np.stack([np.bitwise_count(y[few, (word1[inner] + s) % WORDS]) <= self.two.most for s in range(1, WORDS)], 1)
            good[inner] = (turn.argmax(1) + 1 == step) & turn[few, step - 1] & (self.two.first(y[few, word[inner]]) == block[inner])
        return good


def _kind(word, block, word1, block1, part):
    """A cell's word on top, its choice of blocks, its first word and choice (or -1), and the part of
    the fingerprint (or -1), in one number."""
    return (part + 1) << 40 | (block1 + 1) << 24 | (word1 + 1) << 16 | block << 8 | word


def _parse_kind(kind: np.ndarray) -> tuple[np.ndarray, ...]:
    return kind & 0xFF, kind >> 8 & 0xFF, (kind >> 16 & 0xFF) - 1, (kind >> 24 & 0xFFFF) - 1, (kind >> 40) - 1


def _named(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for (code, a, b); two cells of one number would be walked together, which
    costs time only, as a pair counts in its own cell alone."""
    with np.errstate(over="ignore"):
        h = tk.mix64(code.view(np.uint64) * np.uint64(tk.BASE) + np.asarray(a, np.int64).astype(np.uint64))
        return (tk.mix64(h * np.uint64(tk.BASE) + np.asarray(b, np.int64).astype(np.uint64)) >> np.uint64(1)).view(np.int64)


def _among(code: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(code), bool)
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code


def _fingerprint_columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    ids, hi, lo, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    return ids, np.stack([lo, hi], 1).copy().view(np.uint32).reshape(-1, 4), size


def _hot(nodes: DataFrame, codes, limit: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with more than ``limit`` fingerprints, sorted, and their counts; ``rows`` codes are
    expected. Buckets of codes are counted first, and then the codes of buckets above the limit
    only. Each task adds up its own first."""
    buckets = 1 << max(12, min(22, (32 * rows // limit).bit_length()))

    def counted(batches, names):
        total: dict[int, int] = {}
        for b in batches:
            ids, words, _ = _fingerprint_columns(b)
            for c, n in zip(*(x.tolist() for x in np.unique(names(words), return_counts=True))):
                total[c] = total.get(c, 0) + n
            if len(total) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"c": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})
                total = {}
        yield pa.RecordBatch.from_pydict({"c": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    def coarse(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            ids, words, _ = _fingerprint_columns(b)
            for code in _joined(codes(words)):
                total += np.bincount(_group(code, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

    def fine(batches):
        def names(words):
            return np.concatenate([np.zeros(0, np.int64), *(code[_among(_group(code, buckets), full)] for code in codes(words))])

        return counted(batches, names)

    def above(run):
        found = nodes.select("id", "hi", "lo", "n").mapInArrow(run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") > limit).orderBy("c").toArrow()
        return found.column(0).to_numpy(), found.column(1).to_numpy()

    full, n = above(coarse)
    return above(fine) if len(full) else (full, n)


def _joined(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same in fewer arrays, of a bounded size."""
    held, rows = [], 0
    for x in arrays:
        held.append(x)
        rows += len(x)
        if rows > 1 << 21:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _group(code: np.ndarray, groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tk.mix64(code.view(np.uint64) * np.uint64(tk.BASE)) % np.uint64(groups)).astype(np.int64)


def cells_of(nodes: DataFrame, budget: int, limit: int, count: int) -> Cells:
    cells = Cells(budget)
    rows = count * WORDS * len(cells.one.choices)
    if count > limit:  # else no cell can hold so many
        cells.hot, _ = _hot(nodes, cells.first, limit, rows)
    if len(cells.hot):

        def second(words):
            for code in cells.first(words):
                at = np.flatnonzero(_among(code, cells.hot))
                if len(at):
                    yield from cells.second(words[at], code[at])

        cells.hot2, n = _hot(nodes, second, limit, rows)
        cells.parts = -(-n // max(limit // 2, 1))
    return cells


_ROW = np.dtype([("cell", "<i8"), ("kind", "<i8"), ("hi", "<i8"), ("lo", "<i8"), ("n", "<i4")])


def near_pairs(nodes: DataFrame, budget: int = BUDGET, ratio: float = RATIO, cell: int = CELL) -> DataFrame:
    """Of the near-copy graph of ``nodes`` (id, hi, lo, n): edges (a, b, 0) that span its
    components, and rows (a, a, links) that add up to the links of each node."""
    count = nodes.count()
    cells = cells_of(nodes, budget, cell, count)
    groups = max(1, count * WORDS * len(cells.one.choices) // GROUP)
    sent = nodes.sparkSession.sparkContext.broadcast(cells)  # at most 8,192 and 2**20 codes or so

    def packed(b, at, code, kind, size):
        """A row for each group of cells: its number, and its fingerprints' rows."""
        group = _group(code, groups)
        order = np.argsort(group)
        group, at = group[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rows = np.empty(len(at), _ROW)
        rows["cell"], rows["kind"], rows["n"] = code[order], kind[order], size[at]
        rows["hi"], rows["lo"] = b.column(1).to_numpy()[at], b.column(2).to_numpy()[at]
        cut = (np.append(first, len(rows)) * _ROW.itemsize).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut), pa.py_buffer(rows.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(group[first]), values], ["part", "rows"])

    def scatter(batches):
        for b in batches:
            ids, words, size = _fingerprint_columns(b)
            waiting, held = [], 0
            for x in sent.value.all(words, ids):
                waiting.append(x)
                held += len(x[0])
                if held > 1 << 21:
                    yield packed(b, *(np.concatenate(c) for c in zip(*waiting)), size)
                    waiting, held = [], 0
            if held:
                yield packed(b, *(np.concatenate(c) for c in zip(*waiting)), size)

    def join(batches):
        data = b"".join(x for b in batches for x in b.column(1).to_pylist())
        if not data:
            return
        rows = np.frombuffer(data, _ROW)
        cell, kind, size = (rows[c].copy() for c in ("cell", "kind", "n"))
        halves = np.stack([rows["lo"], rows["hi"]], 1).view(np.uint64)
        del rows, data
        cells = sent.value
        words = halves.view(np.uint32).reshape(-1, 4)
        word, block, word1, block1, part = _parse_kind(kind)
        every = np.arange(len(words))
        top, wide = words[every, word], halves[every, np.where(word1 < 0, word, word1) // 2]
        most = np.where(word1 < 0, *cells.most)
        links = np.zeros(len(words), np.int64)
        edges, waiting, held = np.zeros((0, 2), np.int64), [], 0
        for pairs in trie_pairs(top, halves, size.astype(np.int64), most, budget, ratio, cell, part, wide, budget // 2):
            i, j = pairs[:, 0], pairs[:, 1]
            good = cells.mine(words[i] ^ words[j], word[i], block[i], word1[i], block1[i]) & (kind[i] << 24 == kind[j] << 24)
            found = pairs[good]
            np.add.at(links, found.reshape(-1), 1)
            waiting.append(found)
            held += len(found)
            if held > 1 << 20:
                edges, waiting, held = spanning(np.concatenate([edges, *waiting]), len(words)), [], 0
        edges = spanning(np.concatenate([edges, *waiting]), len(words))
        own = np.flatnonzero(links)  # a fingerprint may have rows in several cells
        same, node = np.unique(name(halves[own], size[own]), return_inverse=True)
        edges = spanning(node[np.searchsorted(own, edges)], len(same))
        total = np.zeros(len(same), np.int64)
        np.add.at(total, node, links[own])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([same[edges[:, 0]], same])), pa.array(np.concatenate([same[edges[:, 1]], same])), pa.array(np.concatenate([np.zeros(len(edges), np.int64), total]))], ["a", "b", "links"])

    return nodes.select("id", "hi", "lo", "n").mapInArrow(scatter, "part bigint, rows binary").repartition("part").mapInArrow(join, "a bigint, b bigint, links bigint")


def grouped(docs: DataFrame, budget: int = BUDGET, ratio: float = RATIO, cell: int = CELL) -> DataFrame:
    """(doc_id, text_key, group, links) of each row with at least one near copy; written."""
    marks = written(with_fingerprints(docs), "fingerprints")
    nodes = marks.groupBy("id").agg(F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes, "nodes")
    pairs = written(near_pairs(nodes, budget, ratio, cell), "near-pairs")
    comp = connected_components(pairs.where("a <> b").select("a", "b"))
    comp = comp.join(pairs.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node")
    # equal fingerprints are a group even without an edge
    alone = nodes.where("rows > 1").select(F.col("id").alias("node")).join(comp, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(0).cast("bigint").alias("links"))
    group = alone.unionByName(comp.select("node", "component", "links"))
    return written(marks.join(group, marks["id"] == group["node"]).select("doc_id", "text_key", F.col("component").alias("group"), "links"), "groups")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row (doc_id, group, size, links, stays) for each row that has near copies; the
    group is named by its smallest doc_id, and ``links`` counts the other fingerprints within
    the budget of the row's own."""
    g = grouped(docs)
    named = g.groupBy("group").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.min(_rank()).alias("best"))
    return g.join(named, "group").select("doc_id", F.col("first").alias("group"), "size", "links", (_rank() == F.col("best")).alias("stays"))


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("y"), F.col("text_key").alias("z"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, columns as they are."""
    g = grouped(docs)
    name, no = fresh(docs.columns, "__tm_key", "__tm_no")
    best = g.groupBy("group").agg(F.min(_rank()).alias("best"))
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    g = g.withColumn(name, F.xxhash64("doc_id", "text_key")).join(best, "group")
    # rows of one key are equal in id and text: they stay or go together, but for one
    marked = written(g.groupBy(name).agg(F.max((_rank() == F.col("best")).cast("int")).alias("stay"), F.count(F.lit(1)).alias("rows")), "marked")
    gone = sent_if_small(marked.where("stay = 0").select(name))
    cols = quoted(docs.columns)
    kept = docs.withColumn(name, key).join(gone, name, "left_anti")
    equal = marked.where("stay = 1 and rows > 1").select(name)
    if equal.isEmpty():
        return kept.select(*cols)
    equal = sent_if_small(equal)
    once = kept.join(equal, name, "left_semi").withColumn(no, F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))).where(F.col(no) == 1)
    return kept.join(equal, name, "left_anti").select(*cols).unionByName(once.select(*cols))


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
