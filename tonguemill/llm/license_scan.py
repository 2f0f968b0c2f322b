"""License scans: template markup compiled to token automata.

A template is the wording of a licence or notice in the markup of public licence
templates: ``<<beginOptional>>...<<endOptional>>`` may be absent, and
``<<var;name=...;match=REGEX;words=LO-HI>>`` stands for LO to HI words that each match
REGEX. All other words are mandatory, in order, exactly (letter case, punctuation and
white space don't count). A template compiles to a nondeterministic automaton over
words; its subsets are made deterministic as texts need them.

A text is searched only where it can match: each template has an anchor, two
neighbouring mandatory words, and a match has the anchor at one of a bounded number
of offsets. Anchors of all templates are looked up at once among the hashed word
pairs of a batch; the automaton runs from the possible starts. One pass, no shuffle.

Nulls and odd input: null and empty texts hold no licence; a null ``doc_id`` is
carried along; a repeated row is reported again; very long texts are searched whole; where
several licences match (ties) each is reported, and of one licence's matches from a place the longest;
an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk
from .tables import session_of, table

_HOLDER = '<<var;name="holder";match="[^ ]+";words=1-12>>'
_YEAR = '<<var;name="year";match="[0-9]+";words=1-4>>'
_COPY = f"<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> {_YEAR} {_HOLDER} <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>"
_VERSION = '<<var;name="version";match="[0-9]+";words=1-2>>'
_SCHEME = '<<beginOptional>><<var;name="scheme";match="https?";words=1-1>><<endOptional>>'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_CLAIM = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = f'THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str) -> str:
    """The header of a GNU licence; the postal address of old ones may follow."""
    work = '<<var;name="work";match="program|library|software";words=1-1>>'
    return f"This {work} is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version {_VERSION} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {work}<<beginOptional>>. If not, see {_SCHEME} www.gnu.org/licenses/<<endOptional>><<beginOptional>>; if not, write to the Free Software Foundation<<beginOptional>>, Inc.<<endOptional>><<endOptional>>"


#: Licence id -> template: the whole mandatory wording of a licence or file header; ids that
#: end in -notice are one-line mentions.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "<<beginOptional>>This work is<<endOptional>> <<beginOptional>>This software is<<endOptional>> <<var;name=\"verb\";match=\"released|licensed|distributed\";words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "Apache-notice": f"Licensed under the Apache License, Version {_VERSION}",
    "GPL-notice": f"<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>>, version {_VERSION}<<endOptional>>",
    "CC-notice": f"<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>><<beginOptional>>-ND<<endOptional>> {_VERSION}",
    "CC0-notice": "<<beginOptional>>To the extent possible under law, <<endOptional>>dedicated to the public domain",
    "MIT": f"<<beginOptional>>MIT License<<endOptional>> {_COPY} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL {_HOLDER} {_CLAIM}",
    "ISC": f"<<beginOptional>>ISC License<<endOptional>> {_COPY} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND {_HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{_COPY} {_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"{_COPY} {_BSD_START} <<beginOptional>>3.<<endOptional>> Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "Apache-2.0-header": f"Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<beginOptional>>{_SCHEME} www.apache.org/licenses/LICENSE-2.0<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-header": _gnu("General Public License"),
    "LGPL-header": _gnu("Lesser General Public License"),
    "AGPL-header": _gnu("Affero General Public License"),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {_SCHEME} mozilla.org/MPL/2.0/.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "Unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} IN NO EVENT SHALL THE AUTHORS {_CLAIM} <<beginOptional>>For more information, please refer to {_SCHEME} unlicense.org<<endOptional>>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an <<var;name=\"ack\";match=\"acknowledge?ment\";words=1-1>> in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.",
}

# The bodies of longer licences are kept as files; how to apply them, addresses and titles are optional there.
TEMPLATES |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}

SCHEMA = "doc_id bigint, license_id string, first_pos int, found int"


def _plain_words(text: str) -> list[str]:
    w = tk.words(pa.array([text]))
    return [w.word(i) for i in range(len(w.hash))]


def parse(template: str) -> list:
    """Nested items: str (word), ('opt', items), ('var', regex, lo, hi)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<(?:beginOptional|endOptional|var;.*?)>>|<<[a-z]+>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            done = stack.pop()
            if done:
                stack[-1].append(("opt", done))
        elif part.startswith("<<var"):
            rule = re.search(r'match="(.*?)"', part)
            count = re.search(r"words=(\d+)-(\d+)", part)
            lo, hi = (int(count[1]), int(count[2])) if count else (1, 1)
            if hi < max(lo, 1):
                raise ValueError(f"bad word counts: {part}")
            stack[-1].append(("var", rule[1] if rule else "[^ ]+", lo, hi))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup: {part}")
        else:
            stack[-1].extend(_plain_words(part))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """The token automaton of a template, with lazily built deterministic steps."""

    def __init__(self, template: str):
        self.items = parse(template)
        self.word: list[str | None] = []
        self.rule: list[re.Pattern | None] = []
        self.eps: list[list[int]] = [[]]
        self.step: list[int] = [-1]
        self.word.append(None)
        self.rule.append(None)
        self.final = self._build(self.items, 0)
        self.vocabulary = {w for w in self.word if w}
        self.start = self._closure({0})
        self._memo: dict[tuple[frozenset, str], frozenset] = {}
        self.anchor, self.back = self._anchor()

    def _state(self) -> int:
        for x in (self.word, self.rule):
            x.append(None)
        self.eps.append([])
        self.step.append(-1)
        return len(self.word) - 1

    def _build(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, str):
                to = self._state()
                self.word[at], self.step[at] = x, to
                at = to
            elif x[0] == "opt":
                enter = self._state()
                self.eps[at].append(enter)
                end = self._build(x[1], enter)
                after = self._state()
                self.eps[end].append(after)
                self.eps[at].append(after)
                at = after
            else:
                ends = []
                for i in range(x[3]):
                    if i >= x[2]:
                        ends.append(at)
                    to = self._state()
                    self.rule[at], self.step[at] = re.compile(x[1]), to
                    at = to
                after = self._state()
                for e in [*ends, at]:
                    self.eps[e].append(after)
                at = after
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def advance(self, states: frozenset, word: str) -> frozenset:
        key = (states, word)
        have = self._memo.get(key)
        if have is None:
            have = self._closure({self.step[s] for s in states if self.step[s] >= 0 and (self.word[s] == word or (self.rule[s] is not None and self.rule[s].fullmatch(word)))})
            if len(self._memo) < 50_000:
                self._memo[key] = have
        return have

    def longest(self, word_at, begin: int, end: int) -> int:
        """End of the longest match that begins at ``begin``, or -1."""
        states, best, i = self.start, -1, begin
        while True:
            if self.final in states and i > begin:
                best = i
            if i >= end or not states:
                return best
            states = self.advance(states, word_at(i))
            i += 1

    def _anchor(self) -> tuple[tuple[str, str], tuple[int, int]]:
        """Two neighbouring mandatory words, and the least and greatest number
        of words that may stand before them in a match."""
        def width(x) -> tuple[int, int]:
            if isinstance(x, str):
                return 1, 1
            if x[0] == "var":
                return x[2], x[3]
            return 0, sum(width(y)[1] for y in x[1])

        lo = hi = 0
        best = None
        common = {"the", "of", "and", "in", "to", "is", "this", "a", "or", "for", "under", "licensed", "be", "that", "with"}
        for a, b in zip(self.items, [*self.items[1:], None]):
            if isinstance(a, str) and isinstance(b, str):
                score = (len({a, b} & common), hi - lo)
                if best is None or score < best[0]:
                    best = (score, (a, b), (lo, hi))
            w = width(a)
            lo, hi = lo + w[0], hi + w[1]
        if best is None:
            raise ValueError("a template needs two neighbouring mandatory words")
        return best[1], best[2]


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, Automaton]], np.ndarray]:
    autos = [(k, Automaton(t)) for k, t in templates]
    with np.errstate(over="ignore"):
        pairs = [tk.windows(np.array([tk.hash_word(x) for x in a.anchor], np.uint64), np.array([0, 2]), 2)[0][0] for _, a in autos]
    return autos, np.array(pairs, np.uint64)


def scan(w: tk.Words, templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, int, int]]:
    """(document index, licence, word position of the first match, matches that
    don't overlap), by document and licence. Matches are leftmost-longest."""
    autos, pairs = _compiled(templates)
    h, first, _ = tk.windows(w.hash, w.off, 2)
    hits = np.flatnonzero(np.isin(h, pairs))
    starts: dict[tuple[int, int], set[int]] = {}
    for i in hits:
        at = int(first[i])
        d = int(np.searchsorted(w.off, at, "right")) - 1
        for t in np.flatnonzero(pairs == h[i]):
            lo, hi = autos[t][1].back
            starts.setdefault((d, int(t)), set()).update(range(max(int(w.off[d]), at - hi), at - lo + 1))
    out = []
    for (d, t), where in sorted(starts.items()):
        name, a = autos[t]
        end, first_pos, found, free = int(w.off[d + 1]), -1, 0, -1
        for s in sorted(where):
            if s < free:
                continue
            e = a.longest(w.word, s, end)
            if e > 0:
                found += 1
                free = e
                if first_pos < 0:
                    first_pos = s - int(w.off[d])
        if found:
            out.append((d, name, first_pos, found))
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row (doc_id, license_id, first_pos, found) for each licence in each document."""
    session_of(docs)
    rules = tuple(templates.items())
    _compiled(rules)  # bad markup fails here, not in a task

    def run(batches):
        with np.errstate(over="ignore"):
            for b in tk.chunks(batches):
                got = scan(tk.words(b.column(1)), rules)
                if got:
                    d, names, pos, n = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(names), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "license_id", "first_pos", "found"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def to_regex(template: str) -> str:
    """The same language over text in which each word stands as ' word '."""
    def go(items: list) -> str:
        out = ""
        for x in items:
            if isinstance(x, str):
                out += f" {re.escape(x)} "
            elif x[0] == "opt":
                out += f"(?:{go(x[1])})?"
            else:
                out += f"(?: (?:{x[1]}) ){{{x[2]},{x[3]}}}"
        return out

    return go(parse(template))


def _sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{tk.WORD_RE}'), '  ') || ' ' AS t FROM documents),
m AS ({" UNION ALL ".join("SELECT doc_id, t, '{0}' AS license_id, regexp_extract_all(t, '{1}') AS found FROM d".format(k, to_regex(x).replace("'", "''")) for k, x in TEMPLATES.items())})
SELECT doc_id, license_id, (length(replace_from) - length(replace(replace_from, ' ', '')))::INTEGER // 2 AS first_pos, len(found)::INTEGER AS found
FROM (SELECT doc_id, license_id, found, left(t, strpos(t, found[1]) - 1) AS replace_from FROM m WHERE len(found) > 0)"""


SQL = _sql()
