"""Sentences of a line by rule, and as a table function for SQL."""

from __future__ import annotations

import re

_CLOSING = frozenset("»\"”')]")
_RUN = re.compile("[.!?…]+[»\"”')\\]]*")


def split_line(line: str) -> list[str]:
    """A run of sentence marks, with closing marks glued to it, ends a sentence before
    white space or the end of the line; not after a one-letter initial, not in a number."""
    out, begin = [], 0
    for m in _RUN.finditer(line):
        run, i = m.span()
        if i < len(line) and not line[i].isspace():
            continue
        lone = run > 0 and line[run - 1].isalpha() and not (run > 1 and line[run - 2].isalpha())
        if lone:
            continue
        piece = line[begin:i].strip()
        if piece:
            out.append(piece)
        begin = i
    rest = line[begin:].strip()
    return [*out, rest] if rest else out


def glue_short(pieces: list[str], min_chars: int) -> list[str]:
    """A short piece that begins with a dash joins a piece before it that ends with a closing mark."""
    out: list[str] = []
    for p in pieces:
        if out and p.startswith("—") and len(p) < min_chars and out[-1][-1:] in _CLOSING:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def line_sentences(text: str | None, min_chars: int = 20) -> list[str]:
    """Sentences of all lines that aren't blank or headings."""
    out: list[str] = []
    for line in (text or "").splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            out += glue_short(split_line(line), min_chars)
    return out
