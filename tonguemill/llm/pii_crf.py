"""Personal data and secrets: a skip-chain conditional random field.

The tokens of a document (runs without white space, as Unicode has it) carry a label: O, EMAIL,
PHONE, CARD, IP, SECRET, SSN or IBAN. Potentials: a token's shape with its label, the shapes before and
after it with its label, a cue word shortly before it, neighbouring labels, and skip
edges that join each token to the next one in the document with the same or a similar
written form (the same digits, or the same letters, whatever marks surround
them): they share their evidence however far apart they stand. A number that is a phone number or an
order number, a dotted quad that is an address or a version, a run of hexadecimal digits that is a
key or a checksum, or a pass phrase of letters: one mention with a cue decides on all.
Inference is loopy belief propagation over all edges of many documents at once: neighbours form
paths, and so do repeats, and messages go along whole paths, forward and backward, first of
one kind, then of the other, until a document's messages no longer change. The label
is the most probable one of each token's belief; of equals the first in :data:`LABELS`.

A token is *active* if it holds a digit, an ``@``, or an assignment (``key=value``, ``key:value``), is
:data:`LONG` bytes or longer, follows a token that ends in ``:`` or ``=`` or a cue word for secrets, or has
the written form of one that does (of :data:`REPEAT` bytes or more). All others have the label O with
certainty: they send their neighbours a constant, so the graph falls apart there, and
inference on the rest is the same as on the whole; that rest is a small part of the
text. Tokens are found in one vectorised pass over whole texts. No shuffle; the
weights are a few hundred numbers.

The weights are trained here by likelihood (:func:`train`) on generated documents
(:func:`generate`): formats of each kind, with and without cues, repeated mentions of which one
has a cue, and numbers of other kinds as counter-examples. :func:`evaluate` gives held-out accuracy.

Nulls and odd input: null and empty texts hold nothing; very long texts and tokens are read whole; a
null ``doc_id`` is carried along; a repeated row is reported again; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import random
import re
import warnings
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk
from .tables import session_of, table

LABELS = ["O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN"]
LONG, REPEAT = 32, 8
#: Messages are damped from sweep EASY on, where loops keep them changing; SWEEPS is a guard only.
SWEEPS, EASY, DAMPING = 200, 6, 0.3
TRAIN_DOCS, HELD_OUT, SEED = 1500, 400, 11
PSEUDO, LIKELY = 100, 150
SCHEMA = "doc_id bigint, label string, start int, end int, value string"

_EDGE = "!\"#$%&'*,.:;<=>?[]^_`{|}~«»“”‘’…/\\"
_KEY = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|auth|bearer|credentials?|(?:[a-z]+[_-])?(?:key|token|secret|password))"
_ASSIGNED = re.compile(rf"(?i)(?P<key>['\"]?{_KEY}['\"]?[=:]['\"]?)(?P<value>[^'\"\s]{{6,}})")
_SHAPES: list[tuple[str, re.Pattern]] = [
    (k, re.compile(p))
    for k, p in (
        ("assigned", _ASSIGNED.pattern),
        ("email", r"(?i)[\w.%+-]+@[\w-]+(\.[\w-]+)*\.[a-z]{2,}"),
        ("at", r"(?s).*@.*"),
        ("ip", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
        ("ip6", r"(?i)(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}|(?=[0-9a-f:]*\d)(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}|::(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4}"),
        ("quad", r"\d+\.\d+\.\d+\.\d+"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("date", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"),
        ("time", r"\d{1,2}:\d{2}(:\d{2})?"),
        ("country", r"\+\d{1,3}"),
        ("area", r"\(\d{2,4}\)"),
        ("local", r"\d{3,4}-\d{4}"),
        ("phone", r"\+?\d{1,3}[-.]?\(?\d{2,4}\)?[-.]\d{3,4}[-.]?\d{3,4}|\(\d{3}\)\d{3}-\d{4}|\+\d{8,14}"),
        ("trunk", r"0\d{2,4}"),
        ("group4", r"\d{4}"),
        ("cardsep", r"\d{4}([- ]\d{4}){2,3}\d{0,3}|\d{4}-\d{6}-\d{5}"),
        ("card", r"\d{13,19}"),
        ("int12", r"\d{9,12}"),
        ("int8", r"\d{5,8}"),
        ("pair", r"\d{2}"),
        ("int3", r"\d{1,3}"),
        ("decimal", r"[-+]?\d+([.,]\d+)+%?"),
        ("iban", r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
        ("ibanhead", r"[A-Z]{2}\d{2}"),
        ("hexkey", r"(?i)(?=.*[0-9])[0-9a-f]{24,}"),
        ("keyed", r"(?:AKIA|ghp_|sk-|xox[a-z]-|AIza|eyJ)[\w.-]{12,}"),
        ("mixedkey", r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{24,}"),
        ("mixedcase", r"(?=[^a-z]*[a-z])(?=.[^A-Z]*[A-Z])[A-Za-z+/_-]{10,}"),
        ("letters", r"[a-z]{14,31}"),
        ("joined", r"[A-Za-z]{2,}(?:[-_.][A-Za-z]{2,}){2,}"),
        ("long", r"\S{32,}"),
        ("wordnum", r"(?=.*\d)\w+"),
        ("other", r"(?s).*"),
    )
]
_N = len(_SHAPES) + 3
PLAIN, EDGE_OF_TEXT, BINDER = len(_SHAPES), len(_SHAPES) + 1, len(_SHAPES) + 2
_CUES = {
    "EMAIL": "email mail e-mail contact correo courriel",
    "PHONE": "phone tel telephone call mobile fax telefon teléfono téléphone whatsapp",
    "CARD": "card visa mastercard credit karte tarjeta carte",
    "IP": "ip ipv6 host server address login from_ip",
    "SECRET": "token key secret password passwd passphrase api_key apikey api-key access_token auth bearer credential pwd",
    "SSN": "ssn social-security",
    "IBAN": "iban account konto",
    "NUMBER": "page chapter year in section total no nr",
    "OTHER": "order invoice serial isbn part model build commit sha hash checksum version",
}
_CUE_OF = {w: i + 1 for i, ws in enumerate(_CUES.values()) for w in ws.split()}
N_CUES = len(_CUES) + 1


_WRAPPED = re.compile(r"\([^()]{5,}\)")  # not an area code


def core(token: str) -> str:
    """The token without surrounding marks."""
    t = token.strip(_EDGE)
    if _WRAPPED.fullmatch(t):
        t = t[1:-1].strip(_EDGE)
    if t.startswith("(") and ")" not in t:
        t = t[1:]
    if t.endswith(")") and "(" not in t:
        t = t[:-1]
    return t.strip(_EDGE)


@lru_cache(maxsize=200_000)
def shape(token: str) -> int:
    c = core(token)
    if not c:
        return BINDER if token in ("=", ":", ":=", "=>") else PLAIN
    if c.isalpha() and len(c) < 14 and (c.islower() or c.isupper() or c.istitle()):
        return PLAIN
    marked = any(x in "0123456789@" for x in c)
    for i, (name, p) in enumerate(_SHAPES):
        if p.fullmatch(c):
            return i if marked or name not in ("wordnum", "other") and (name != "long" or c.isascii() and c.isalnum()) else PLAIN
    return PLAIN


def skip_key(token: str) -> str:
    """Equal for tokens with the same or a similar written form."""
    c = core(token).lower()
    digits = re.sub(r"\D", "", c)
    return digits if len(digits) >= 7 and not re.search(r"[a-z]", c) and "." not in c else c


def _cue(before: list[str]) -> int:
    for t in reversed(before):
        k = _CUE_OF.get(core(t).lower(), 0)
        if k:
            return k
    return 0


def _sizes() -> dict[str, tuple[int, ...]]:
    n = len(LABELS)
    return {"here": (_N, n), "prev": (_N, n), "next": (_N, n), "cue": (N_CUES, n), "herecue": (_N * N_CUES, n), "chain": (n, n), "skip": (n, n)}


class Weights(dict):
    pass


# -- generated training documents


def _filler(rng: random.Random) -> str:
    w = "".join(rng.choice("abcdefghilmnoprstuvwéüñ") for _ in range(rng.randint(1, 11)))
    if rng.random() < 0.1:
        w = w.capitalize()
    return w + rng.choice(["", "", "", "", ",", ".", "###", "!!", "***"])


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _run(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _entity(kind: str, rng: random.Random) -> list[str]:
    d = lambda n: _digits(rng, n)
    word = lambda: _run(rng, "abcdefghijklmnoprstuvw", rng.randint(2, 9))
    if kind == "EMAIL":
        return [rng.choice([word(), f"{word()}.{word()}", f"{word()}.{d(2)}", f"{d(2)}", f"{word()}+{word()}"]) + "@" + rng.choice([word(), f"mail{d(1)}.{word()}", f"{word()}-{word()}"]) + rng.choice([".com", ".org", ".de", ".co.uk", ".example.com"])]
    if kind == "PHONE":
        return rng.choice([["+" + d(rng.randint(1, 2)), f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(11)}"], [f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"], ["0" + d(2), d(4), d(4)], ["+" + d(2), "0" + d(2), d(4), d(4)], ["0" + d(1), d(2), d(2), d(2), d(2)]])
    if kind == "CARD":
        return rng.choice([[rng.choice("23456") + d(15)], [rng.choice("23456") + d(15)], [rng.choice("3456") + d(3), d(4), d(4), d(4)], [f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"], [rng.choice("3456") + d(14)]])
    if kind == "IP":
        hexa = lambda: _run(rng, "0123456789abcdef", rng.randint(1, 4))
        return rng.choice([[".".join(str(rng.randint(1, 254)) for _ in range(4))]] * 3 + [[f"2001:{hexa()}::{hexa()}:{hexa()}:{d(4)}"], [":".join(f"{d(1)}{hexa()[:3]}" for _ in range(8))]])
    if kind == "SSN":
        return [f"{d(3)}-{d(2)}-{d(4)}"]
    if kind == "IBAN":
        head = _run(rng, _UPPER, 2) + d(2)
        return rng.choice([[head + d(18)], [head + _run(rng, _UPPER, 4) + d(14)], [head, d(4), d(4), d(4), d(4), d(2)], [head, d(4), d(4), d(4), d(4)]])
    mixed = lambda n: _run(rng, _UPPER + _LOWER + "0123456789", n - 1) + rng.choice("0123456789")
    hexa = lambda n: _run(rng, "0123456789abcdef", n)
    return [rng.choice([hexa(40), hexa(32), hexa(64), "AKIA" + mixed(16), "ghp_" + mixed(36), mixed(40), "sk-" + mixed(40), f"{rng.choice(['password', 'api_key', 'token', 'secret'])}{rng.choice('=:')}{rng.choice([_letters_only(rng), mixed(12), mixed(8)])}"])]


def _letters_only(rng: random.Random) -> str:
    """A pass phrase without digits."""
    return rng.choice([_run(rng, _LOWER, rng.randint(14, 28)), _run(rng, _LOWER + _UPPER, rng.randint(12, 26)) + "aZb", "-".join(_run(rng, _LOWER, rng.randint(3, 7)) for _ in range(4))])


#: Forms that only their surroundings tell apart: what they are with a cue of their kind, and how they look.
_AMBIGUOUS = {
    "PHONE": lambda rng: _digits(rng, rng.randint(9, 12)),
    "CARD": lambda rng: rng.choice("3456") + _digits(rng, 15),
    "IP": lambda rng: ".".join(str(rng.randint(1, 99)) for _ in range(4)),
    "SECRET": lambda rng: rng.choice([_letters_only(rng), _letters_only(rng), _run(rng, "0123456789abcdef", rng.choice([32, 40]))]),
    "SSN": lambda rng: f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}",
}


def _decoy(rng: random.Random) -> list[str]:
    d = lambda n: _digits(rng, n)
    return rng.choice([
        [str(rng.randint(1900, 2030))], [d(rng.randint(1, 3))], [f"{d(1)}.{d(1)}"], [f"{d(1)}.{d(1)}."], ["version", f"{d(1)}."], [f"{d(2)}:{d(2)}"], [f"20{d(2)}-{rng.randint(10, 12)}-{d(2)}"], [f"{d(2)},{d(3)}"],
        [f"v{d(1)}.{d(1)}.{d(1)}"], [d(rng.randint(5, 8))], [f"{d(3)}px"], [f"{d(2)}%"], ["@", _filler(rng)], ["@" + "nick" + d(2)], [d(4), d(2)], [f"covid{d(2)}"], [f"{d(1)}.{d(1)}.{d(1)}"], [d(4)], ["(" + d(4) + ")"],
        [d(2), d(2)], [_run(rng, _UPPER, 2) + d(2)], [d(rng.randint(9, 12))], [_filler(rng) + ":", _filler(rng)], ["note:", _run(rng, _LOWER, rng.randint(2, 18))], [rng.choice(["key", "token", "password", "secret"]), _run(rng, _LOWER, rng.randint(2, 12))], ["password:", _run(rng, _LOWER, rng.randint(2, 9))],
        [_run(rng, _LOWER, rng.randint(32, 40))], ["=", _filler(rng)], [f"{_run(rng, _LOWER, 4)}={_run(rng, _LOWER, 6)}"], ["http://" + _run(rng, _LOWER, 9) + ".org/?q=" + _run(rng, _LOWER, 5)],
    ])


def generate(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Labelled token lists."""
    rng = random.Random(seed)
    kinds = LABELS[1:]
    out = []
    for _ in range(n):
        toks: list[str] = []
        labs: list[int] = []
        said: list[tuple[str, list[str]]] = []

        def put(x: list[str], label: int, toks=toks, labs=labs) -> None:
            toks.extend(x)
            labs.extend([label] * len(x))

        def cue(kind: str, put=put) -> None:
            put([rng.choice(_CUES["OTHER" if kind == "O" else kind].split()) + rng.choice(["", ":"])], 0)
            if rng.random() < 0.4:
                put([rng.choice(["=", ":"])], 0)

        # one form, said several times, with a cue at one place at most
        plan: list[tuple[str, str, bool]] = []
        if rng.random() < 0.6:
            kind = rng.choice(list(_AMBIGUOUS))
            form, times = _AMBIGUOUS[kind](rng), rng.choice([1, 1, 2, 3, 4, 5, 6, 12, 25])
            marked = rng.random()
            label = kind if marked < 0.55 else "O"
            at = rng.randrange(times) if marked < 0.85 else -1
            if at < 0 and kind in ("CARD", "IP", "SSN") or (at < 0 and form.isalnum() and form[:1].isdigit() and len(form) > 30):
                label = kind  # without any cue, what the form suggests
            plan = [(label, form, k == at) for k in range(times)]
        for _ in range(rng.randint(2, 10) + len(plan)):
            put([_filler(rng) for _ in range(rng.randint(0, 9))], 0)
            if plan and rng.random() < 0.5:
                label, form, marked = plan.pop()
                if marked:
                    cue(label)
                elif rng.random() < 0.2:
                    put([rng.choice(_CUES["NUMBER"].split())], 0)
                put([form + rng.choice(["", "", ".", ",", "!!"])], LABELS.index(label))
                continue
            if rng.random() < 0.5:
                x = _decoy(rng)
                if rng.random() < 0.3:
                    put([rng.choice(_CUES[rng.choice(["NUMBER", "OTHER"])].split())], 0)
                put(x, 0)
                continue
            if said and rng.random() < 0.35:
                kind, x = rng.choice(said)  # mentioned again, without a cue
            else:
                kind = rng.choice(kinds)
                x = _entity(kind, rng)
                said.append((kind, x))
                if rng.random() < 0.4 or kind == "PHONE" and x[0][:1] == "0":
                    cue(kind)
            if toks[-1:] and toks[-1][-1] not in "=:" and rng.random() < 0.2:
                put([rng.choice(_CUES["NUMBER"].split())], 0)
            mark = rng.choice(["", "", "", "###", ".", ",", "!!", "***", "$$$"])
            y = [*x[:-1], x[-1] + mark]
            if mark in ("###", "!!", "***", "$$$"):
                y = [t + mark for t in x]
            if kind == "SECRET" and rng.random() < 0.5:
                y = ['"' + x[0] + '"' + mark]
            put(y, LABELS.index(kind))
        for label, form, marked in plan:
            put([_filler(rng)], 0)
            if marked:
                cue(label)
            put([form], LABELS.index(label))
        out.append((toks, labs))
    return out


# -- the graph


class Graph:
    """Active tokens of many documents with their features and edges."""

    def __init__(self) -> None:
        self.feat: list[tuple[int, int, int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, active: list[tuple[int, str, list[str], str | None]]) -> None:
        """One document's active tokens in order: (token index, token, the three
        tokens before it, the token after it)."""
        base, last, seen = len(self.feat), None, {}
        for i, (at, tok, before, after) in enumerate(active):
            prev = EDGE_OF_TEXT if not before else BINDER if before[-1][-1] in ":=" else shape(before[-1])
            self.feat.append((shape(tok), prev, shape(after) if after is not None else EDGE_OF_TEXT, _cue(before)))
            if last is not None and at == last + 1:
                self.chain.append((base + i - 1, base + i))
            last = at
            key = skip_key(tok)
            if key:
                if key in seen:
                    self.skip.append((seen[key], base + i))
                seen[key] = base + i

    def arrays(self):
        e = lambda x: np.array(x, np.int64).reshape(-1, 2)
        return np.array(self.feat, np.int64).reshape(-1, 4), e(self.chain), e(self.skip)


def _unary(feat: np.ndarray, w: dict) -> np.ndarray:
    return w["here"][feat[:, 0]] + w["prev"][feat[:, 1]] + w["next"][feat[:, 2]] + w["cue"][feat[:, 3]] + w["herecue"][feat[:, 0] * N_CUES + feat[:, 3]]


def _edges_to_o(n: int, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token's left and right neighbour is a token that is O for certain."""
    left, right = np.ones(n, bool), np.ones(n, bool)
    left[chain[:, 1]] = False
    right[chain[:, 0]] = False
    return left, right


def _levels(n: int, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Paths of ``edges`` by place: (nodes, their predecessors) at distance 1, 2, ... from the path's first node."""
    if not len(edges):
        return []
    before = np.full(n, -1)
    before[edges[:, 1]] = edges[:, 0]
    place, far = (before >= 0).astype(np.int64), before.copy()
    while len(i := np.flatnonzero(far >= 0)):
        place[i], far[i] = place[i] + place[far[i]], far[far[i]]
    nodes = np.argsort(place, kind="stable")
    at = np.searchsorted(place[nodes], np.arange(1, int(place.max()) + 2))
    return [(x, before[x]) for x in (nodes[a:b] for a, b in zip(at, at[1:]))]


def _along(base: np.ndarray, levels: list, pot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages into each node of the paths, from before it and from behind it."""
    ahead, back = np.zeros_like(base), np.zeros_like(base)
    for x, p in levels:
        ahead[x] = _pass(base[p] + ahead[p], pot)
    for x, p in reversed(levels):
        back[p] = _pass(base[x] + back[x], pot.T)
    return ahead, back


def _pass(out: np.ndarray, pot: np.ndarray) -> np.ndarray:
    new = np.log(np.exp(out - out.max(1, keepdims=True)) @ pot)
    return new - new.max(1, keepdims=True)


def propagate(feat: np.ndarray, chain: np.ndarray, skip: np.ndarray, w: dict, doc: np.ndarray | None = None) -> np.ndarray:
    """Beliefs [tokens, labels] by loopy belief propagation. ``doc`` (ascending) tells documents apart:
    each stops when its own messages do, whatever the others do."""
    n, m = len(feat), len(LABELS)
    if n == 0:
        return np.zeros((0, m))
    theta = _unary(feat, w)
    left, right = _edges_to_o(n, chain)
    theta = theta + left[:, None] * w["chain"][0] + right[:, None] * w["chain"][:, 0]
    doc = np.zeros(n, np.int64) if doc is None else doc
    belief, live = np.empty((n, m)), np.arange(n)
    base, edges, msg = theta, [chain, skip], [np.zeros((n, m)), np.zeros((n, m))]
    for sweep in range(SWEEPS):
        if sweep == 0 or len(live) < len(base):  # on the documents that are left
            if sweep:
                kept = np.flatnonzero(going)
                number = np.full(len(base), -1)
                number[kept] = np.arange(len(kept))
                edges = [number[e[going[e[:, 0]]]] for e in edges]
                base, msg, doc = base[kept], [x[kept] for x in msg], doc[kept]
            paths = [(_levels(len(base), e), np.exp(w[k])) for e, k in zip(edges, ("chain", "skip"))]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        change = np.zeros(len(base))
        for k in (0, 1):
            if paths[k][0]:
                new = sum(_along(base + msg[1 - k], *paths[k]))
                if sweep >= EASY:
                    new = DAMPING * msg[k] + (1 - DAMPING) * new
                change = np.maximum(change, np.abs(new - msg[k]).max(1))
                msg[k] = new
        moved = np.maximum.reduceat(change, first) >= 1e-4
        going = np.repeat(moved, np.diff(np.concatenate([first, [len(base)]])))
        belief[live[~going]] = (base + msg[0] + msg[1])[~going]
        live = live[going]
        if not len(live):
            break
    else:
        belief[live] = (base + msg[0] + msg[1])[going]
        warnings.warn(f"beliefs of {len(np.unique(doc[going]))} documents still change after {SWEEPS} sweeps", stacklevel=2)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


_STRIP = "".join(c for c in _EDGE if c.isascii()) + "()"


def repeat_key(token: str) -> str:
    return token.strip(_STRIP)


def active_tokens(toks: list[str]) -> list[int]:
    """The places of active tokens, token by token; :func:`entities` finds the same ones at once."""
    on, forms = set(), set()
    for i, t in enumerate(toks):
        if any(c in "0123456789@" for c in t) or len(t.encode()) >= LONG or any(c in "=:" and t[j + 1 :] and t[j + 1] != "/" for j, c in enumerate(t)):
            on.add(i)
        if i and (toks[i - 1][-1] in "=:" or repeat_key(toks[i - 1]).lower() in _SECRET_CUES):
            on.add(i)
            if len(repeat_key(t).encode()) >= REPEAT:
                forms.add(repeat_key(t))
    return [i for i, t in enumerate(toks) if i in on or repeat_key(t) in forms]


_SECRET_CUES = set(_CUES["SECRET"].split())


def _graph_of(docs: list[tuple[list[str], list[int]]]) -> tuple[Graph, np.ndarray, np.ndarray]:
    g, y, doc = Graph(), [], []
    for d, (toks, labs) in enumerate(docs):
        on = active_tokens(toks)
        g.add([(i, toks[i], toks[max(0, i - 3) : i], toks[i + 1] if i + 1 < len(toks) else None) for i in on])
        y += [labs[i] for i in on]
        doc += [d] * len(on)
    return g, np.array(y, np.int64), np.array(doc, np.int64)


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=c, minlength=n) for c in rows.T], 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@lru_cache(maxsize=2)
def train(n: int = TRAIN_DOCS, seed: int = SEED) -> Weights:
    """Weights that maximise the penalised likelihood: first the pseudo-likelihood, where
    neighbours have their true labels, then the likelihood with the beliefs and pair beliefs of belief
    propagation, whose messages go on from those of the step before."""
    g, y, _ = _graph_of(generate(n, seed))
    feat, chain, skip = g.arrays()
    size, m = len(y), len(LABELS)
    left, right = _edges_to_o(size, chain)
    w, mom, var = (Weights({k: np.zeros(s) for k, s in _sizes().items()}) for _ in range(3))
    one = np.eye(m)[y]
    edges = {"chain": chain, "skip": skip}
    levels = {k: _levels(size, e) for k, e in edges.items()}
    said = {k: _sums(y[e[:, 0]], one[e[:, 1]], m) for k, e in edges.items()}
    into = {k: np.zeros((size, m)) for k in edges}
    columns = {"here": feat[:, 0], "prev": feat[:, 1], "next": feat[:, 2], "cue": feat[:, 3], "herecue": feat[:, 0] * N_CUES + feat[:, 3]}
    for step in range(1, PSEUDO + LIKELY + 1):
        theta = _unary(feat, w) + left[:, None] * w["chain"][0] + right[:, None] * w["chain"][:, 0]
        grad = {}
        if step <= PSEUDO:
            for k, e in edges.items():
                theta += _sums(e[:, 1], w[k][y[e[:, 0]]], size) + _sums(e[:, 0], w[k].T[y[e[:, 1]]], size)
            d = (_softmax(theta) - one) / size
            for k, e in edges.items():
                grad[k] = _sums(y[e[:, 0]], d[e[:, 1]], m) + _sums(y[e[:, 1]], d[e[:, 0]], m).T
        else:
            for k, e in edges.items():
                base, pot = theta + into["skip" if k == "chain" else "chain"], np.exp(w[k])
                ahead, back = _along(base, levels[k], pot)
                into[k] = ahead + back
                i, j = e.T
                a, b = _softmax(base[i] + ahead[i]), _softmax(base[j] + back[j])
                pair = a[:, :, None] * pot * b[:, None, :]
                grad[k] = ((pair / pair.sum((1, 2), keepdims=True)).sum(0) - said[k]) / size
            d = (_softmax(theta + into["chain"] + into["skip"]) - one) / size
        for k, at in columns.items():
            grad[k] = _sums(at, d, len(w[k]))
        grad["chain"][0] += d[left].sum(0)
        grad["chain"][:, 0] += d[right].sum(0)
        rate = 0.1 if step <= PSEUDO else 0.05
        for k in w:
            gk = grad[k] + (2e-5 if k != "herecue" else 1e-4) * w[k]
            mom[k] = 0.9 * mom[k] + 0.1 * gk
            var[k] = 0.99 * var[k] + 0.01 * gk**2
            w[k] -= rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-9)
        w["skip"] = (w["skip"] + w["skip"].T) / 2
    return w


def evaluate(n: int = HELD_OUT, seed: int = SEED + 1, skips: bool = True) -> float:
    """Share of active tokens of fresh generated documents with the right label."""
    g, y, doc = _graph_of(generate(n, seed))
    feat, chain, skip = g.arrays()
    return float((propagate(feat, chain, skip if skips else skip[:0], train(), doc).argmax(1) == y).mean())


# -- whole texts


def _table(*of: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SPACE = _table(*range(9, 14), *range(28, 33))
_MARK = _table(*range(48, 58), 64)
_BIND = _table(ord("="), ord(":"))
_TRIM = _table(*map(ord, _STRIP))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_CUE_HASHES = np.array(sorted(tk.hash_word(w) for w in _SECRET_CUES), np.uint64)


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes that aren't white space, as str.split has it."""
    inside = ~_SPACE[data]
    for lead, width, last in ((0xC2, 2, {0x85, 0xA0}), (0xE1, 3, {0x9A80}), (0xE2, 3, {*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F}), (0xE3, 3, {0x8080})):
        at = np.flatnonzero(data == lead)
        rest = data[at + 1].astype(np.int64) if width == 2 else data[at + 1].astype(np.int64) << 8 | data[at + 2]
        at = at[np.isin(rest, list(last))]
        for k in range(width):
            inside[at + k] = False
    return inside


def _active(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which tokens are active; the rules of :func:`active_tokens`."""
    active = e - s >= LONG
    marks = np.flatnonzero(_MARK[data])
    active[np.searchsorted(s, marks, "right") - 1] = True
    bind = np.flatnonzero(_BIND[data])
    of = np.searchsorted(s, bind, "right") - 1
    inner = bind + 1 < e[of]
    active[of[inner & (data[np.minimum(bind + 1, len(data) - 1)] != 47)]] = True
    # what is left of each token without marks around it, as a hash
    a, b = s.copy(), e.copy()
    while len(i := np.flatnonzero((a < b) & _TRIM[data[np.minimum(a, len(data) - 1)]])):
        a[i] += 1
    while len(i := np.flatnonzero((b > a) & _TRIM[data[np.maximum(b - 1, 0)]])):
        b[i] -= 1
    up, down = tk._power_tables(len(data))

    def hashes(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(of) + 1, np.uint64)
        np.cumsum(of * down[: len(of)], out=total[1:])
        return np.where(b > a, tk.mix64((total[b] - total[a]) * up[np.maximum(b, 1) - 1]), np.uint64(0))

    with np.errstate(over="ignore"):
        start = np.ones(len(s), bool)
        doc = np.searchsorted(off, s, "right") - 1
        start[1:] = doc[1:] != doc[:-1]
        few = np.flatnonzero(b - a <= max(map(len, _SECRET_CUES)))
        cue = np.zeros(len(s), bool)
        cue[few] = np.isin(hashes(_LOW[data], a[few], b[few]), _CUE_HASHES)
        told = np.zeros(len(s), bool)
        told[1:] = (_BIND[data[e[:-1] - 1]] | cue[:-1]) & ~start[1:]
        active |= told
        source = np.flatnonzero(told & (b - a >= REPEAT))
        if len(source):
            key = hashes(data, a, b) * np.uint64(tk.BASE) + doc.astype(np.uint64)
            active |= np.isin(key, key[source]) & (b - a >= REPEAT)
    return active


def entities(text: pa.Array, w: dict, skips: bool = True) -> list[tuple[int, str, int, int, str]]:
    """(document index, label, first and end character, value) of each mention."""
    data, off = tk.buffers(text)
    n = len(data)
    if not n:
        return []
    inside = _inside(data)
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    s, e = at[0::2], at[1::2]
    if not len(s):
        return []
    which = np.flatnonzero(_active(data, off, s, e))
    if not len(which):
        return []
    doc = np.searchsorted(off, s[which], "right") - 1
    first = np.searchsorted(s, off)  # token range of each document
    raw = data.tobytes()
    tok = lambda i: raw[s[i] : e[i]].decode("utf-8", "replace")
    g = Graph()
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
    for x, y in zip(begin, [*begin[1:], len(doc)]):
        a, b = int(first[doc[x]]), int(first[doc[x] + 1])
        g.add([(i, tok(i), [tok(j) for j in range(max(a, i - 3), i)], tok(i + 1) if i + 1 < b else None) for i in which[x:y].tolist()])
    feat, chain, skip = g.arrays()
    lab = propagate(feat, chain, skip if skips else skip[:0], w, doc).argmax(1)
    found = np.flatnonzero(lab)
    if not len(found):
        return []
    letters = np.zeros(n + 1, np.int64)  # characters before each byte
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    out, k, stop = [], 0, len(which)
    for k0 in found.tolist():
        if k0 < k:
            continue
        k = k0 + 1
        name = LABELS[lab[k0]]
        while name in ("PHONE", "CARD", "IBAN") and k < stop and lab[k] == lab[k0] and doc[k] == doc[k0] and which[k] == which[k - 1] + 1:
            k += 1  # the others are one token each
        i, j = int(which[k0]), int(which[k - 1])
        span = raw[s[i] : e[j]].decode("utf-8", "replace")
        value = span.strip(_EDGE)
        lead = len(span) - len(span.lstrip(_EDGE))
        if _WRAPPED.fullmatch(value):
            inner = value[1:-1].lstrip(_EDGE)
            lead, value = lead + len(value) - 1 - len(inner), inner.rstrip(_EDGE)
        if name == "SECRET" and (m := _ASSIGNED.fullmatch(value)):
            lead, value = lead + m.start("value"), m["value"]
        d = int(doc[k0])
        at = int(letters[s[i]] - letters[off[d]]) + lead
        out.append((d, name, at, at + len(value), value))
    return out


def find_pii(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """One row (doc_id, label, start, end, value) for each mention; characters from 0."""
    session_of(docs)
    w = dict(weights or train())

    def run(batches):
        for b in tk.chunks(batches):
            got = entities(b.column(1), w)
            if got:
                d, lab, s, e, v = zip(*got)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(lab), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(v)], ["doc_id", "label", "start", "end", "value"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
