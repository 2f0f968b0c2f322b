"""The router on plain Python strings, and on the bytes of Arrow columns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import SCRIPTS

_CLASS = {k: re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", v) + "]") for k, v in SCRIPTS.items()}


def count(text: str, script: str) -> int:
    return len(_CLASS[script].findall(text))


def route(text: str | None) -> str:
    """latin | cyrillic | the code of a language that its script tells | unknown."""
    if not text:
        return "unknown"
    if _CLASS["Kana"].search(text):
        return "jpn"
    n, name = max((count(text, s), rank, s) for rank, s in enumerate(("Latin", "Cyrillic", "Han")))[::2]
    if n:
        return "cmn" if name == "Han" else name.lower()
    return next((lang for s, lang in (("Devanagari", "hin"), ("Arabic", "ara")) if _CLASS[s].search(text)), "unknown")


UNKNOWN, LATIN, CYRILLIC = 0, 1, 2
#: The languages that a script tells, from code 3 on.
DIRECT = ("jpn", "cmn", "hin", "ara")
_KIND = np.zeros(1 << 16, np.uint8)  # of each code point: 1 + its place in _ORDER
_ORDER = ("Latin", "Cyrillic", "Han", "Kana", "Devanagari", "Arabic")
for _i, _name in enumerate(_ORDER):
    for _a, _b in re.findall(r"(\\x\{[0-9A-F]+\}|[A-Za-z])-(\\x\{[0-9A-F]+\}|[A-Za-z])", SCRIPTS[_name]):
        _lo, _hi = (int(x[3:-1], 16) if len(x) > 1 else ord(x) for x in (_a, _b))
        _KIND[_lo : _hi + 1] = _i + 1


#: Bytes of text whose letters are counted at once; bounds a worker's memory.
PIECE_BYTES = 1 << 20


def kinds(*classes: str) -> np.ndarray:
    """For :func:`letter_counts`: 1 + the number of the class that holds a code point; the first of several."""
    out = np.zeros(1 << 16, np.uint8)
    for i, inside in reversed(list(enumerate(classes))):
        one = re.compile("[" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{m[1]}", inside) + "]")
        out[[c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and one.match(chr(c))]] = i + 1
    return out


def letter_counts(texts: pa.Array, kind: np.ndarray = _KIND, classes: int = len(_ORDER)) -> np.ndarray:
    """[texts, classes; those of _ORDER if none are given]: letters of each, from the UTF-8 bytes, a few texts at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, i = np.zeros((len(texts), classes), np.int64), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
        _count_piece(texts.slice(i, j - i), kind, out[i:j])
        i = j
    return out


def _count_piece(texts: pa.Array, kind: np.ndarray, out: np.ndarray) -> None:
    n, classes = out.shape
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.string())
    _, offsets, body = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if off[-1] == off[0]:
        return
    whole, off = np.frombuffer(body, np.uint8)[off[0] : off[-1]], off - off[0]
    ascii_kinds = np.where(np.arange(256) < 128, kind[:256], 0)
    for begin in range(0, len(whole), 4 * PIECE_BYTES):  # a very long text in parts
        end = min(len(whole), begin + 4 * PIECE_BYTES)
        while end < len(whole) and whole[end] & 0xC0 == 0x80:
            end += 1
        while begin < end and whole[begin] & 0xC0 == 0x80:  # counted with the part before
            begin += 1
        data, mine = whole[begin:end], np.clip(off, begin, end) - begin
        full = np.flatnonzero(np.diff(mine))
        for c in set(ascii_kinds.tolist()) - {0}:
            out[full, c - 1] += np.add.reduceat((ascii_kinds == c)[data], mine[:-1][full], dtype=np.int64)
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xF0)).astype(np.int32)
        if len(lead):
            two = data[lead] < 0xE0
            cp = np.empty(len(lead), np.uint16)
            a = lead[two]
            cp[two] = (data[a] & 0x1F).astype(np.uint16) << 6 | data[a + 1] & 0x3F
            a = lead[~two]
            cp[~two] = (data[a] & 0x0F).astype(np.uint16) << 12 | (data[a + 1] & 0x3F).astype(np.uint16) << 6 | data[a + 2] & 0x3F
            k = kind[cp]
            some = np.flatnonzero(k)
            row = np.searchsorted(mine, lead[some], "right") - 1
            out += np.bincount(row * classes + k[some] - 1, minlength=out.size).reshape(out.shape)


def routes(texts: pa.Array) -> np.ndarray:
    """UNKNOWN, LATIN, CYRILLIC, or 3 + the place in DIRECT of each text."""
    latin, cyr, han, kana, deva, arab = letter_counts(texts).T
    rules = [(kana > 0, 3), ((han > 0) & (han >= latin) & (han >= cyr), 4), ((cyr > 0) & (cyr >= latin), CYRILLIC), (latin > 0, LATIN), (deva > 0, 5), (arab > 0, 6)]
    return np.select([r for r, _ in rules], [k for _, k in rules], UNKNOWN)


def letters(column, **classes: str):
    """struct(name: bigint, ...): letters of each class in a text, the first class of several; null of null. Classes are
    written as in :data:`SCRIPTS`; the function works on bytes, in pieces of bounded size."""
    from pyspark.sql import functions as F

    kind, names = kinds(*classes.values()), list(classes)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    def count(texts: pa.Array) -> pa.Array:
        c = letter_counts(texts, kind, len(names))
        return pa.StructArray.from_arrays([pa.array(x) for x in c.T], names, mask=pc.is_null(texts))

    return count(F.col(column) if isinstance(column, str) else column)


def route_column(column):
    """struct(route, direct_lang) as :func:`functions.text.route` has it, from the bytes."""
    from pyspark.sql import functions as F

    @F.arrow_udf("struct<route: string, direct_lang: string>")
    def route_of(texts: pa.Array) -> pa.Array:
        r = routes(texts)
        return pa.StructArray.from_arrays([pa.array(["unknown", "latin", "cyrillic", *["direct"] * len(DIRECT)]).take(pa.array(r)), pa.array([None, None, None, *DIRECT], pa.string()).take(pa.array(r))], ["route", "direct_lang"])

    return route_of(F.col(column) if isinstance(column, str) else column)
