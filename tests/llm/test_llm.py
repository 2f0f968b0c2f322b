"""The training-data operators against brute force, on small fixtures with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import canon
from tonguemill.llm import chat_format, components, decontaminate, license_scan, mixing, paragraph_dedup, pii_crf, quality_fm, sharding, simhash_trie, syncmers
from tonguemill.llm import tokens as tk
from tonguemill.llm.queries import oracle_sql, queries

np.seterr(over="ignore")
WORD = re.compile("[0-9a-zÀ-῿⁰-⿿぀-\U0010ffff]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hi string, `group` int, shard int, id double"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows(rng):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    t = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(30, 150)), "en", f"src{i % 3}") for i in range(40)]
    rows += [(None, t, "en", None), (None, None, None, None), (50, "", None, "src1"), (51, "  \n", "en", "src1"), (52, "!!! ???", "en", "src2"), (53, prose(rng, 30_000), "en", "src0"), (54, t, "en", "src0"), (54, t, "en", "src0"), (54, t, None, "src2")]
    return [(i, x, l, s, None if x is None else len(x), "clash", 1, 2, 0.5) for i, x, l, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(random.Random(4)), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- words


def test_words_equal_regex():
    texts = ["Hello Wörld", "abc", "", 'def “x” 12—é', None, "a", "b  　c", "ab", "cd", "x" * 500, "тест — Ёлка", "日本語。テスト", " a b"]
    w = tk.words(pa.array(texts))
    for d, t in enumerate(texts):
        assert [w.word(i) for i in range(w.off[d], w.off[d + 1])] == WORD.findall((t or "").lower())
    assert all(tk.hash_word(w.word(i)) == int(w.hash[i]) for i in range(len(w.hash)))
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert sum(c.num_rows for c in tk.chunks([b], limit=10)) == len(texts)


def test_components(spark):
    rng = random.Random(1)
    e = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if x in got} and set(got) >= {x for x in root if any(find(y) == find(x) and y != x for y in root)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1


def test_license_automaton():
    scan = lambda t: {(n, p, c) for _, n, p, c in license_scan.scan(tk.words(pa.array([t])), tuple(license_scan.TEMPLATES.items()))}
    assert scan("x y. Released under the MIT License.") == {("MIT-notice", 2, 1)}
    assert scan("Released under### the*** MIT\nLicense; released under the MIT license") == {("MIT-notice", 0, 2)}
    assert scan("This work is licensed under the GNU General Public License, version 3.") == {("GPL-notice", 0, 1)}
    assert scan("licensed under CC BY-NC 4.0.") == {("CC-notice", 0, 1)}
    for t in ("Released under the BSD License", "Released under a MIT License", "MIT License", "", None, "under the mit"):
        assert scan(t) == set()
    mit = license_scan.TEMPLATES["MIT"]
    plain = re.sub(r"<<var[^>]*>>", "2024", re.sub(r"<<(begin|end)Optional>>", "", mit))
    assert ("MIT", 0, 1) in scan(plain)
    assert not any(n == "MIT" for n, _, _ in scan(plain.replace("merge", "mangle")))


def test_licenses_need_their_last_clause():
    scan = lambda t: {n for _, n, _, _ in license_scan.scan(tk.words(pa.array([t])), tuple(license_scan.TEMPLATES.items()))}
    ends = {"MIT": "dealings in the software", "ISC": "performance of this software", "BSD-2-Clause": "possibility of such damage", "BSD-3-Clause": "possibility of such damage", "Apache-2.0-header": "limitations under the license", "GPL-header": "along with this program", "MPL-2.0-header": "mozilla org mpl 2 0", "Unlicense": "dealings in the software", "Zlib": "from any source distribution"}
    for k, end in ends.items():
        plain = re.sub(r'<<var;name="(\w+)[^>]*>>', lambda m: {"work": "program", "scheme": "https", "ack": "acknowledgment"}.get(m[1], "2024"), license_scan.TEMPLATES[k])
        plain = " ".join(WORD.findall(re.sub(r"<<beginOptional>>|<<endOptional>>", " ", plain).lower()))
        assert k in scan(plain) and plain.count(end) == 1, k
        assert k not in scan(plain.replace(end, end.rsplit(" ", 1)[0] + " altered")), k
        assert k not in scan(plain[: plain.index(end)]), k
    assert scan("This is free and unencumbered software released into the public domain.") == {"Unlicense-notice"}


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_licence_bodies(name):
    """The whole body is needed, with or without its optional parts; a word changed anywhere is one too many."""
    scan = lambda t: {n for _, n, _, _ in license_scan.scan(tk.words(pa.array([t])), tuple(license_scan.TEMPLATES.items()))}
    body = license_scan.TEMPLATES[name].replace('<<var;name="scheme";match="https?";words=1-1>>', "https")
    short = re.sub(r"(?s)<<beginOptional>>.*?<<endOptional>>", " ", body)
    full = re.sub(r"<<(begin|end)Optional>>", " ", body)
    words = WORD.findall(short.lower())
    assert len(words) > 900 and name in scan(full.upper()) and name in scan("x " + " *** ".join(words) + " y")
    rng = random.Random(name)
    for k in (0, len(words) - 1, *(rng.randrange(len(words)) for _ in range(12))):
        assert name not in scan(" ".join([*words[:k], "altered", *words[k + 1 :]])), words[max(0, k - 3) : k + 3]


def test_license_scan_equals_regex(docs, empty, spark):
    extra = spark.createDataFrame([(900 + i, f"{prose(random.Random(i), 20)} {x}", "en", "s", 1, "c", 1, 1, 0.1) for i, x in enumerate(["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "licensed under the MIT license, licensed under CC BY-SA 4.0"])], SCHEMA)
    d = docs.unionByName(extra)
    got = {(r.doc_id, r.license_id, r.first_pos, r.found) for r in license_scan.license_scan(d).collect()}
    want = set()
    for r in d.collect():
        t = "".join(f" {x} " for x in WORD.findall((r.text or "").lower()))
        for k, tpl in license_scan.TEMPLATES.items():
            m = list(re.finditer(license_scan.to_regex(tpl), t))
            if m:
                want.add((r.doc_id, k, t[: m[0].start()].count(" ") // 2, len(m)))
    assert got == want and len(got) >= 4
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize("bad", ["<<beginOptional>>x", "x<<endOptional>>", "<<zap>> a b", 'a b <<var;name="x";match="a";words=3-1>>', "one"])
def test_bad_markup(bad):
    with pytest.raises(ValueError):
        license_scan.Automaton(bad)


# -- 2


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (60, 40, 25, 9, 5)]
    bench = [(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "a b"), (0, items[0]), (None, items[2])]
    edit = lambda t, every: " ".join("zzzq" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    lone = "zyzzyva"
    bench += [(93, lone), (94, "zyzzyva quokka")]
    planted = [(107, f"{prose(rng, 9)} {lone} {prose(rng, 5)}"), (100, f"{prose(rng, 50)} {items[0]} {prose(rng, 9)}"), (101, items[1].upper().replace(" ", " *** ")), (102, f"x {items[2]}"), (103, f"{prose(rng, 30)} {' '.join(items[0].split()[10:30])}"), (104, items[4]), (105, f"{prose(rng, 20)} {edit(items[0], 6)} {prose(rng, 20)}"), (106, items[3])]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id bigint, text string")).withColumn("extra", F.lit(1))
    m = decontaminate.matches(rows, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    exact = {(r.doc_id, r.item_id) for r in m if r.kind == "exact"}
    grams = {}
    for i, t in bench:
        w = WORD.findall((t or "").lower())
        n = min(decontaminate.PHRASE, len(w))
        for a in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[a : a + n]), set()).add(i)
    want = set()
    for r in rows.collect():
        w = WORD.findall((r.text or "").lower())
        for g, ids in grams.items():
            if any(tuple(w[a : a + len(g)]) == g for a in range(len(w) - len(g) + 1)):
                want |= {(r.doc_id, i) for i in ids}
    assert exact == want and {d for d, _ in exact} >= {100, 101, 102, 103, 104, 106, 107}
    assert {(r.doc_id, r.item_id) for r in m if r.kind == "near"} == {(105, 0)}
    whole = next(r for r in m if r.doc_id == 100 and r.item_id == 0 and r.kind == "exact")
    assert (whole.doc_pos, whole.item_pos, whole.n_words) == (50, 0, 60)
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    kept = decontaminate.without_contaminated(rows, b)
    assert kept.columns == rows.columns and kept.count() == docs.count() and not {r.doc_id for r in kept.collect()} & set(range(100, 108))
    assert decontaminate.matches(empty, b).count() == 0 and decontaminate.without_contaminated(docs, b.limit(0)).count() == docs.count()


def edited(text, every):
    return " ".join("zzzq" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_rounds(spark, monkeypatch, docs):
    """The result doesn't depend on how the test set falls into rounds or segments, nor on the other items."""
    texts = [r.text for r in docs.where("length(text) > 100").limit(12).collect()]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, edited(t, 3 + i % 4)) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    b = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    search = lambda items: sorted(map(tuple, decontaminate.matches(rows, items).collect()), key=str)
    whole = search(b)
    assert {r[3] for r in whole} == {"exact", "near"}
    assert search(b.where("item_id < 4")) == [r for r in whole if r[2] < 4]
    for name, small in (("MAX_SENT", 1000), ("SPREAD", 1), ("SEGMENT_BYTES", 500)):
        monkeypatch.setattr(decontaminate, name, small)
        assert search(b) == whole, name


def brute_near(texts, items):
    """(document, item) with a window whose words stand near their places, by trying all starts."""
    d = decontaminate
    docs = [WORD.findall((t or "").lower()) for t in texts]
    n = Counter(w for ws in docs for w in ws)
    total = sum(n.values())
    weight = lambda w: max(0.0, -math.log(min(1.0, max(n[w] / total, d.FLOOR) * (2 * d.SLOP + 1))))
    out = set()
    for i, t in enumerate(items):
        item = WORD.findall((t or "").lower())
        last = max(len(item) - d.WINDOW, 0)
        for s in {min(k, last) for k in range(0, last + d.STRIDE, d.STRIDE)} if len(item) > 1 else ():
            places = sorted(range(s, min(s + d.WINDOW, len(item))), key=lambda k: (n[item[k]], k))[: d.RARE]
            need = max(math.ceil(d.NEED * len(places)), min(len(places), 2))
            bar = min(d.BAR, sum(weight(item[k]) for k in places) * (1 - 1e-6))
            for x, ws in enumerate(docs):
                at = {}
                for pos, w in enumerate(ws):
                    for k in places:
                        if item[k] == w:
                            at.setdefault(pos - (k - s), set()).add(k)
                for begin in at:
                    there = set().union(*(at.get(begin + o, set()) for o in range(2 * d.SLOP + 1)))
                    if len(there) >= need and sum(weight(item[k]) for k in there) >= bar - 1e-4:
                        out.add((x, i))
    return out


def test_proximity_equals_brute_force(spark):
    rng = random.Random(80)
    items = [prose(rng, n) for n in (70, 33, 24, 25, 12, 6, 3, 2, 1)] + ["the of and a the of and", "the the the of of a", ""]

    def near(t):
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 3))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["other"], [w[k], "more"], [w[k], w[k]]])
        return " ".join(w)

    texts = [f"{prose(rng, rng.randint(0, 30))} {near(rng.choice(items[:9]))} {prose(rng, rng.randint(0, 30))}" for _ in range(150)] + ["the " * 40, None, ""]
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    exact, found = ({(r.doc_id, r.item_id) for r in got if r.kind == k} for k in ("exact", "near"))
    want = brute_near(texts, items)
    assert found <= want and want - exact == found - exact and len(found - exact) > 20


# -- 3


def test_crf(docs, empty, spark):
    assert pii_crf.evaluate() > 0.965
    w = pii_crf.train()
    got = lambda t: [(lab, v) for _, lab, s, e, v in pii_crf.entities(pa.array([t]), w) if t[s:e] == v or pytest.fail(v)]
    assert got('é mail jo.12@mail3.example.com, ip 8.196.197.208### +1 (743) 555-3824 4785380592391139$$$ token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("EMAIL", "jo.12@mail3.example.com"), ("IP", "8.196.197.208"), ("PHONE", "+1 (743) 555-3824"), ("CARD", "4785380592391139"), ("SECRET", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    for t in ("in 2020 version 3.0 and 24/7", "Licensed under CC BY-NC 4.0.", "no data", "", "3.5 100px 12:30"):
        assert got(t) == [], t
    assert pii_crf.find_pii(empty).count() == 0
    d = spark.createDataFrame([(None, "a@b.com"), (1, None), (2, "x " * 50_000 + "10.1.2.3"), (2, "10.1.2.3"), (2, "10.1.2.3")], "doc_id bigint, text string")
    assert Counter((r.doc_id, r.label) for r in pii_crf.find_pii(d).collect()) == {(None, "EMAIL"): 1, (2, "IP"): 3}


def test_propagation_is_exact_on_trees():
    """Beliefs equal marginals by enumeration where the graph has no loop."""
    import itertools

    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 1, s) for k, s in pii_crf._sizes().items()}
    feat = np.stack([rng.integers(0, n, 4) for n in (pii_crf._N, pii_crf._N, pii_crf._N, pii_crf.N_CUES)], 1)
    chain, skip = np.array([[0, 1]]), np.array([[1, 3], [0, 2]])
    got = pii_crf.propagate(feat, chain, skip, w)
    left, right = pii_crf._edges_to_o(4, chain)
    u = pii_crf._unary(feat, w) + left[:, None] * w["chain"][0] + right[:, None] * w["chain"][:, 0]
    m, want = len(pii_crf.LABELS), np.zeros((4, len(pii_crf.LABELS)))
    for y in itertools.product(range(m), repeat=4):
        p = math.exp(sum(u[i, y[i]] for i in range(4)) + sum(w["chain"][y[a], y[b]] for a, b in chain) + sum(w["skip"][y[a], y[b]] for a, b in skip))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def found(text, skips=True):
    return [(lab, v) for _, lab, s, e, v in pii_crf.entities(pa.array([text]), pii_crf.train(), skips) if text[s:e] == v or pytest.fail(v)]


def test_skip_edges_change_labels():
    """One mention with a cue decides on bare repeats, however far away; without skip edges they are lost."""
    far = " so it is" * 300
    for told, form, kind in (("tel", "5551234567", "PHONE"), ("password:", "correcthorsebatterystaple", "SECRET")):
        for text in (f"{told} {form}{far} {form},{far} ({form})", f"{form}{far} {form}{far} {told} {form}"):
            assert found(text) == [(kind, form)] * 3
    assert len(found(f"tel 5551234567{far} 5551234567", False)) == 1
    assert found(f"invoice 5551234567{far} 5551234567") == [] == found("5551234567 alone")
    assert found(f"sha 0cc175b9c0f1b6a831c399e269772661{far} 0cc175b9c0f1b6a831c399e269772661") == []
    assert len(found(f"tel 5551234567{(far + ' 5551234567') * 20}")) == 21
    assert pii_crf.evaluate() > pii_crf.evaluate(skips=False) + 0.02


def test_kinds():
    for text, want in (
        ("SSN 123-45-6789", ("SSN", "123-45-6789")), ("tel 06 12 34 56 78", ("PHONE", "06 12 34 56 78")), ("call 020 7946 0958", ("PHONE", "020 7946 0958")), ("2001:db8::ff00:42:8329", ("IP", "2001:db8::ff00:42:8329")), ("x\u2003a@b.com\u00a0x", ("EMAIL", "a@b.com")),
        ("DE89 3704 0044 0532 0130 00", ("IBAN", "DE89 3704 0044 0532 0130 00")), ("DE89370400440532013000", ("IBAN", "DE89370400440532013000")), ("password: correcthorsebatterystaple", ("SECRET", "correcthorsebatterystaple")), ("x api_key=QwErTyUiOpAsDfGhJkLz", ("SECRET", "QwErTyUiOpAsDfGhJkLz")),
    ):
        assert found(text) == [want]
    for text in ("password reset link", "the password: please enter it", "note: the thing", "key: value", "version 8.1.9.2 then 8.1.9.2"):
        assert found(text) == []


def odd_texts(rng, n):
    bits = ["password:", "Password", "key", "=", ":", "a=b", "http://x.y/z?a=b", "a:", "correcthorsebattery", "correcthorsebattery.", "(correcthorsebattery)", "é1", "x" * 40, "@", "tel", "5551234567", "'5551234567'", "123-45-6789", "word", "Wörter", "12", "", "“token”", "12:30", "10.0.0.1"]
    return ["".join(rng.choice(bits) + rng.choice([" ", "\n", "\u00a0", "\u2003", "\u3000", "\u1680", "\x85", "\x1c", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_active_tokens_found_at_once():
    texts = odd_texts(random.Random(31), 400) + [None, "", " "]
    data, off = tk.buffers(pa.array(texts))
    inside = pii_crf._inside(data)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    cut = [c for c in off[1:-1].tolist() if 0 < c < len(data) and inside[c] and inside[c - 1]]
    at = np.sort(np.concatenate([edge, cut, cut]).astype(np.int64))
    s, e = at[0::2], at[1::2]
    got = pii_crf._active(data, off, s, e)
    raw, k = data.tobytes(), 0
    for t in texts:
        toks = (t or "").split()
        assert [raw[a:b].decode() for a, b in zip(s[k : k + len(toks)], e[k : k + len(toks)])] == toks
        assert np.flatnonzero(got[k : k + len(toks)]).tolist() == pii_crf.active_tokens(toks), t
        k += len(toks)


def test_pii_equals_brute_force(spark):
    """The whole query on small documents, against sums over all labellings of the document."""
    import itertools

    w, m, rng = pii_crf.train(), len(pii_crf.LABELS), random.Random(17)
    texts = [t for t in odd_texts(rng, 300) if 0 < len(pii_crf.active_tokens(t.split())) <= 4][:90]
    want, sure = {}, {}
    for d, t in enumerate(texts):
        toks = t.split()
        on = pii_crf.active_tokens(toks)
        g = pii_crf.Graph()
        g.add([(i, toks[i], toks[max(0, i - 3) : i], toks[i + 1] if i + 1 < len(toks) else None) for i in on])
        feat, chain, skip = g.arrays()
        u = pii_crf._unary(feat, w)
        for x, i in enumerate(on):
            u[x] += (w["chain"][0] if i - 1 not in on else 0) + (w["chain"][:, 0] if i + 1 not in on else 0)
        p = np.zeros((len(on), m))
        for y in itertools.product(range(m), repeat=len(on)):
            z = math.exp(sum(u[i, y[i]] for i in range(len(on))) + sum(w["chain"][y[a], y[b]] for a, b in chain) + sum(w["skip"][y[a], y[b]] for a, b in skip))
            for i in range(len(on)):
                p[i, y[i]] += z
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        sure[d] = len(chain) + len(skip) < len(on) or np.sort(p, 1)[:, -1].min() > 0.7  # with loops, beliefs are approximate
        marked = [(i, pii_crf.LABELS[k]) for i, k in zip(on, best) if k]
        n, last = Counter(), None
        for i, k in marked:
            if last != (i - 1, k) or k not in ("PHONE", "CARD", "IBAN"):
                n[k] += 1
            last = (i, k)
        want[d] = n
    rows = pii_crf.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {d: Counter(r.label for r in rows if r.doc_id == d) for d in want}
    assert sum(sure.values()) > 60 and sum(map(len, want.values())) > 30
    for d in want:
        assert got[d] == want[d] or not sure[d], texts[d]
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in rows)


def test_documents_do_not_depend_on_batch_mates():
    rng = random.Random(5)
    texts = odd_texts(rng, 60) + [" ".join(f"{rng.choice(['tel', 'order', 'x'])} {rng.choice(['5551234567', '10.0.0.1', '4785380592391139'])}" for _ in range(50)) for _ in range(10)]
    together = pii_crf.entities(pa.array(texts), pii_crf.train())
    assert [(0, *r[1:]) for r in together] == [r for t in texts for r in pii_crf.entities(pa.array([t]), pii_crf.train())]


def test_evidence_reaches_fifty_repeats():
    """Beliefs along a chain of 50 repeats equal marginals by matrix products."""
    rng = np.random.default_rng(5)
    w = {k: rng.normal(0, 1, s) for k, s in pii_crf._sizes().items()}
    w["skip"] = 5 * np.eye(len(pii_crf.LABELS))
    feat = np.tile([0, pii_crf.PLAIN, pii_crf.PLAIN, 0], (50, 1))
    feat[0, 3] = 2
    w["cue"][2] = [0, 0, 40] + [0] * (len(pii_crf.LABELS) - 3)
    skip = np.stack([np.arange(49), np.arange(1, 50)], 1)
    got = pii_crf.propagate(feat, np.zeros((0, 2), np.int64), skip, w)
    u = np.exp(pii_crf._unary(feat, w) + w["chain"][0] + w["chain"][:, 0])
    left, right = [np.ones(len(pii_crf.LABELS))], [np.ones(len(pii_crf.LABELS))]
    for i in range(49):
        left.append((left[-1] * u[i]) @ np.exp(w["skip"]))
        left[-1] /= left[-1].sum()
        right.append(np.exp(w["skip"]) @ (right[-1] * u[49 - i]))
        right[-1] /= right[-1].sum()
    want = u * np.array(left) * np.array(right[::-1])
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


# -- 4


def test_matrix():
    counts = np.array([5, 0, 17, 3, 40, 1])
    m = np.array([sharding.matrix_row(counts, 7, p, 1) for p in range(6)])
    assert m.sum(1).tolist() == counts.tolist() and m.sum(0).tolist() == sharding.capacities(66, 7).tolist() and (m >= 0).all()
    rng = np.random.default_rng(0)
    big = [sharding._draw(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(300)]
    sd = math.sqrt(10**6 * 0.4 * 0.6)
    assert abs(np.mean(big) - 400_000) < 5 * sd / math.sqrt(300) and 0.8 < np.std(big) / sd < 1.2
    assert int(sharding.split(rng, np.array([10**9, 2 * 10**9, 5]), 1000).sum()) == 1000
    many = np.mean([sharding.split(rng, np.array([10**9, 5, 2 * 10**9, 10**9]), 1000) for _ in range(400)], axis=0)
    assert np.abs(many - [250, 0, 500, 250]).max() < 5 * math.sqrt(1000 / 4 / 400)


def test_matrix_from_tree(monkeypatch):
    """Rows found in any order, by walks that share their way, are those of one matrix."""
    monkeypatch.setattr(sharding, "DEAL", 60)
    counts = np.array([40, 3, 0, 77, 12, 50, 1, 30, 9])
    m = np.array([sharding.matrix_row(counts, 11, p, 4) for p in range(9)])
    assert m.sum(1).tolist() == counts.tolist() and m.sum(0).tolist() == sharding.capacities(222, 11).tolist()
    walk = sharding.Matrix(counts, 11, 4)
    for p in (8, 0, 3, 4, 5, 1, 2, 7, 6, 3):
        assert np.bincount(walk.labels(p), minlength=11).tolist() == m[p].tolist()


def test_matrix_distribution(monkeypatch):
    """Entries are distributed like those of a random permutation, in the mean and the spread."""
    counts, runs = np.array([6, 9, 5]), 4000
    for deal in (1, 1 << 20):
        monkeypatch.setattr(sharding, "DEAL", deal)
        got = np.array([[sharding.matrix_row(counts, 4, p, s) for p in range(3)] for s in range(runs)])
        rng = np.random.default_rng(0)
        cards, owner = np.repeat(np.arange(4), 5), np.repeat(np.arange(3), counts)
        want = np.array([np.histogram2d(owner, rng.permutation(cards), (3, 4), ((0, 3), (0, 4)))[0] for _ in range(runs)])
        assert np.abs(got.mean(0) - want.mean(0)).max() < 0.15 and np.abs(got.var(0) - want.var(0)).max() < 0.2
        both = [np.mean(x[:, 0, 0] * x[:, 1, 0]) for x in (got, want)]
        assert abs(both[0] - both[1]) < 0.2


def test_shards(docs, empty, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    for src in (docs, spark.read.parquet(str(tmp_path / "d"))):
        out = sharding.uniform_shards(src, 10)
        assert out.columns == [*docs.columns, "shard_", "pos"]  # docs has a column of that name, which stays
        got = out.collect()
        sizes = Counter(r.shard_ for r in got)
        assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == -(-len(got) // 10)
        for s, n in sizes.items():
            assert sorted(r.pos for r in got if r.shard_ == s) == list(range(n))
        assert Counter((r.doc_id, r.text, r.shard) for r in got) == Counter((r.doc_id, r.text, r.shard) for r in docs.collect())
    assert sharding.uniform_shards(empty).count() == 0


def test_shards_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    """Splits of another size for each job, as after the loss of an executor."""
    monkeypatch.setattr(sharding, "BLOCK", 64, raising=False)
    spark.range(3000).selectExpr("id", "repeat(cast(id as string), 50) text").repartition(2).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "n"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = []
    try:
        for counting, dealing in (("64m", "4k"), ("4k", "64m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", counting)
            src = spark.read.parquet(str(tmp_path / "n"))
            df = sharding.uniform_shards(src, 100)
            spark.conf.set("spark.sql.files.maxPartitionBytes", dealing)
            out.append(sorted((r.shard, r.pos, r.id) for r in df.select("*").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert out[0] == out[1] and sorted(i for _, _, i in out[0]) == list(range(3000))
    assert Counter(s for s, _, _ in out[0]) == {s: 100 for s in range(30)}
    assert sharding._plain_scan(src.drop("x")) and not sharding._plain_scan(src.where("id > 5"))
    some = sharding.uniform_shards(spark.read.parquet(str(tmp_path / "n")).where("id % 3 = 0"), 100).collect()
    assert Counter(r.shard for r in some) == {s: 100 for s in range(10)} and {r.id for r in some} == set(range(0, 3000, 3))


def test_shuffle_is_uniform(spark, tmp_path):
    spark.range(40).selectExpr("id").repartition(3).write.parquet(str(tmp_path / "n"))
    d = spark.read.parquet(str(tmp_path / "n"))
    hits = Counter()
    runs = 60
    counts = np.array([14, 13, 13])
    for s in range(runs):
        for p in range(3):
            for j, n in enumerate(sharding.matrix_row(counts, 4, p, s)):
                hits[p, j] += int(n)
    for (p, j), n in hits.items():
        mean = runs * counts[p] / 4
        assert abs(n - mean) < 5 * math.sqrt(mean), (p, j, n, mean)
    a, b = ([r.id for r in sharding.uniform_shards(d, 10, s).orderBy("shard", "pos").collect()] for s in (1, 2))
    assert a != b and sorted(a) == sorted(b) == list(range(40))


# -- 5


def labeled(spark, n=700):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        t, bad, toxic = prose(rng, rng.randint(20, 120)), rng.random() < 0.15, rng.random() < 0.15
        if bad:
            t = " ".join(x.upper() + "!!" for x in t.split())
        if toxic:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
            t = " ".join(w)
        rows.append((i, t, "en", f"src{i % 5}"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_identity_of_pairs():
    rng = np.random.default_rng(1)
    dim = 1 << quality_fm.LOG_DIM
    w, v = np.zeros(dim), np.zeros((dim, quality_fm.RANK))
    x = [3, 77, 5000, 9]
    w[x], v[x] = rng.normal(size=4), rng.normal(size=(4, quality_fm.RANK))
    m = quality_fm.Model(0.3, w, v, np.isin(np.arange(dim), x))
    got = m.margin(np.zeros(4, np.int64), np.array(sorted(x)), 1)[0]
    assert abs(got - (0.3 + w[x].sum() + sum(v[a] @ v[b] for i, a in enumerate(x) for b in x[:i]))) < 1e-4


def test_quality(spark, docs, empty):
    d, l = labeled(spark)
    model = quality_fm.train(d.where("doc_id < 500"), l)
    held = d.where("doc_id >= 500").withColumn("p", quality_fm.scorer(d, model)).join(l, "doc_id").collect()
    right = [(r.p >= 0.5) == (r.quality == 1 and r.toxic == 0) for r in held]
    assert np.mean(right) > 0.93
    kept = quality_fm.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality_fm.keep(empty, model).count() == 0
    assert quality_fm.keep(docs, quality_fm.train(docs, l.limit(0))).count() == docs.count()
    assert quality_fm.keep(docs, quality_fm.train(d, l.where("quality = 1 and toxic = 0"))).count() == docs.count()
    assert len(quality_fm.training_rows(d, l.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")), 50)) <= 50


def test_fit_without_signal():
    """Labels of noise, rows without features and tiny samples end in a finite model."""
    rng = np.random.default_rng(0)
    row = lambda n: rng.choice(1 << quality_fm.LOG_DIM, n, replace=False).astype(np.int32)
    for rows in ([(row(20), int(rng.random() < 0.5)) for _ in range(60)], [(row(0), 0), (row(3), 1)], [(row(0), i % 2) for i in range(9)], [(row(5), 0)] * 4 + [(row(1), 1)], []):
        m = quality_fm.fit(rows)
        assert math.isfinite(m.w0) and np.isfinite(m.w).all() and np.isfinite(m.v).all()


def test_scores_equal_brute_force(spark):
    """The query's scores are the sums over all pairs, written out."""
    d, l = labeled(spark, 150)
    model = quality_fm.train(d, l)
    for r in d.withColumn("p", quality_fm.scorer(d, model)).limit(40).collect():
        _, x, _ = quality_fm.features(pa.array([r.text]), pa.array([r.lang]), pa.array([r.source]))
        x = [i for i in x.tolist() if model.active[i]]
        z = model.w0 + sum(float(model.w[i]) for i in x) + sum(float(model.v[a].astype(float) @ model.v[b].astype(float)) for i, a in enumerate(x) for b in x[:i])
        assert abs(r.p - 1 / (1 + math.exp(-z))) < 1e-6
    kept = {r.doc_id for r in quality_fm.keep(d, model).collect()}
    assert kept == {r.doc_id for r in d.withColumn("p", quality_fm.scorer(d, model)).collect() if r.p >= quality_fm.THRESHOLD}


# -- 6


def test_weights():
    share, limit = 0.97, 4.0
    for tokens in ([900, 50, 50], [10, 10, 10], [1, 10**6], [5], [0, 7, 9], [], [0]):
        a, w = mixing.temperature_weights(tokens, share, limit)
        total = sum(tokens)
        if not total:
            assert not any(w)
            continue
        live = [(x, t) for x, t in zip(w, tokens) if t]
        assert abs(sum(w) - 1) < 1e-9 and all(x == 0 for x, t in zip(w, tokens) if not t)
        repeats = max(x * total / t for x, t in live)
        assert repeats <= limit * (1 + 1e-6)
        entropy = -sum(x * math.log(x) for x, _ in live)
        assert entropy >= share * math.log(len(live)) - 1e-6 or abs(repeats - limit) < 1e-3


def test_mix_equals_sql(spark, docs, empty):
    import duckdb

    rng = random.Random(5)
    rows = [(i if i % 50 else None, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 40))), "hot" if i < 400 else rng.choice(["a", "b", None, "c"])) for i in range(600)]
    rows += [(9000, "tiny", "rare"), (9001, "", "empty"), (9002, None, "empty"), (1, rows[1][1], "hot")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(d)
    got = out.select("doc_id", "source", F.col("__tm_block").alias("block"), F.col("__tm_key").alias("place"), F.col("__tm_tokens").cast("bigint").alias("tokens")).toPandas()
    con = duckdb.connect()
    con.register("pd_docs", d.toPandas())
    con.execute("create view documents as select try_cast(doc_id as bigint) as doc_id, text, source from pd_docs")
    want = con.execute(mixing.SQL).df()
    assert canon(got[["source", "block", "place", "tokens"]]) == canon(want[["source", "block", "place", "tokens"]])
    for s, t, w, b, whole, rest in mixing.plan(d):
        n = got[got.source.isna() if s is None else got.source == s].tokens.sum()
        assert b <= n < b + 41 or b == n == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns[: len(docs.columns)] == docs.columns


# -- 7


def brute_paragraphs(rows):
    """Clusters by comparing all pairs of paragraphs."""
    w = tk.words(pa.array([r.text for r in rows], pa.string()))
    view, own, d, no, uid = paragraph_dedup._long_enough(w)
    sh, _, so = tk.windows(view.hash, own, paragraph_dedup.SHINGLE)
    sets = [set(sh[so[i] : so[i + 1]].tolist()) for i in range(len(uid))]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= paragraph_dedup.THRESHOLD * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    size = Counter(map(find, range(len(sets))))
    return Counter((rows[int(d[i])].doc_id, int(no[i])) for i in range(len(sets)) if size[find(i)] > 1)


def test_paragraphs(spark, docs, empty):
    rng = random.Random(6)
    passage = ". ".join(prose(rng, 14).capitalize() for _ in range(5)) + "."
    near = passage.split()
    near[30] = "changed"
    planted = [(200, f"{prose(rng, 40)} {passage} {prose(rng, 30)}"), (201, f"{prose(rng, 7)}\n{passage}\n{prose(rng, 30)}."), (202, f"{prose(rng, 60)}. {' '.join(near)} {prose(rng, 15)}"), (203, passage + "\n" + passage)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id bigint, text string")).withColumn("cluster", F.lit("clash"))
    got = paragraph_dedup.repeated_paragraphs(d).collect()
    want = brute_paragraphs(d.collect())
    have = Counter((r.doc_id, r.paragraph) for r in got)
    assert not have - want and sum((have & want).values()) >= 0.9 * sum(want.values())
    assert {200, 201, 202, 203} <= {r.doc_id for r in got}
    for c in {r.cluster for r in got}:
        rows = [r for r in got if r.cluster == c]
        assert len({(r.doc_id, r.paragraph) for r in rows if r.stays}) == 1 and all(r.copies == len(rows) for r in rows)
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0
    b, r = paragraph_dedup.tune_bands(0.8, 0.97)
    assert 1 - (1 - 0.8**r) ** b >= 0.97


def test_paragraph_other_paths(spark, docs, monkeypatch):
    """Ids joined rather than sent, and buckets in parts, give the same rows."""
    rng = random.Random(16)
    base = [prose(rng, 40).split() for _ in range(3)]
    rows = [(1000 + i, " ".join(w if rng.random() > 0.03 else "edited" for w in base[i % 3])) for i in range(60)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).cache()
    find = lambda **k: sorted((str(r.doc_id), r.paragraph, r.copies, r.stays) for r in paragraph_dedup.repeated_paragraphs(d, **k).collect())
    want = find()
    assert sum(r[2] > 5 for r in want) > 20 and find(bucket=4) == want
    monkeypatch.setattr(paragraph_dedup, "SENT_IDS", -1)
    assert find() == want


def test_jaccard_components_equal_brute_force():
    rng = np.random.default_rng(2)
    for n in (2, 30, 120):
        base = [rng.choice(400, 30, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(30) < 0.06, rng.integers(0, 400, 30), base[rng.integers(4)])).astype(np.uint64) for _ in range(n)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        got = list(range(n))
        for i in range(n):
            for j in range(i):
                c = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                    root[find(i)] = find(j)
        edges = paragraph_dedup.jaccard_components(sets, 0.8)
        for i, j in edges:
            assert find(i) == find(j)
            got[find(i, got)] = find(j, got)
        assert len({find(x) for x in range(n)}) == len({find(x, got) for x in range(n)}) == n - len(edges)


def test_passages_without_whole_paragraph(spark):
    """Each run of 50 words that stands in two documents holds a reported paragraph or stretch in both."""
    rng = random.Random(61)
    mid, lines, over = prose(rng, 50), "\n".join(prose(rng, 5) for _ in range(10)), "x " * 50
    edge = f"{prose(rng, 24)}. {prose(rng, 26)}"
    texts = []
    for passage in (mid, lines, over, edge):
        texts += [f"{prose(rng, 20 + 9 * k)} {passage} {prose(rng, 35 - 9 * k)}" for k in range(3)]
    texts += [prose(rng, 300), "x " * 20, None, ""]
    texts += ["。".join(["".join(f" {x}" for x in prose(rng, 14).split()), t, prose(rng, 12)]) for t in [prose(rng, 20)] * 2]
    words = [WORD.findall((t or "").lower()) for t in texts]
    seen = {}
    for i, ws in enumerate(words):
        for p in range(len(ws) - 49):
            seen.setdefault(tuple(ws[p : p + 50]), set()).add((i, p))
    runs = {x for at in seen.values() if len({i for i, _ in at}) > 1 for x in at}
    assert {i for i, _ in runs} == set(range(12))
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    begin = {(r.doc_id, -1 - r.paragraph) for r in got if r.paragraph < 0}
    for i, p in runs:
        assert any((i, q) in begin for q in range(p, p + 51 - paragraph_dedup.STRETCH)), (i, p)
    assert {r.doc_id for r in got} == {*range(12), 16, 17} and all(r.paragraph >= 0 for r in got if r.doc_id > 15)
    for r in got:
        if r.paragraph < 0:
            cut = lambda x: words[x.doc_id][-1 - x.paragraph :][: x.n_words]
            assert all(cut(r) == cut(x) for x in got if x.cluster == r.cluster)


# -- 8


def test_trie_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    near = base[rng.integers(0, 300, 500)].copy()
    for i in range(500):
        for b in rng.integers(0, 128, rng.integers(0, 26)):
            near[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    x = np.unique(np.concatenate([base, near]), axis=0)
    size = rng.integers(20, 60, len(x))
    w = x.view(np.uint32).reshape(-1, 4)
    for word, tb, budget in ((0, 4, 19), (3, 0, 19), (2, 32, 128), (1, 4, 0)):
        got = {tuple(sorted(p)) for p in simhash_trie.trie_join(np.ascontiguousarray(w[:, word]), x, size, tb, budget, 0.8).tolist()}
        want = set()
        for i in range(len(x)):
            ok = (np.bitwise_count(x[i] ^ x[:i]).sum(1) <= budget) & (np.bitwise_count(w[i, word] ^ w[:i, word]) <= tb) & (np.minimum(size[i], size[:i]) >= 0.8 * np.maximum(size[i], size[:i]))
            want |= {(int(j), i) for j in np.flatnonzero(ok)}
        assert got == want


def biased(rng, n):
    """Fingerprints whose bits lean to one side, as those of one language do, and some near copies."""
    x = np.packbits(rng.random((n, 128)) < rng.choice([0.28, 0.72], 128), axis=1).view(np.uint64)
    for i in range(n // 2, n // 2 + n // 20):
        x[i] = x[i - n // 2]
        for b in rng.choice(128, rng.integers(1, 24), replace=False):
            x[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return x


def test_cells_hold_few_pairs_and_each_near_pair_once():
    x = biased(np.random.default_rng(4), 8000)
    w = x.view(np.uint32).reshape(-1, 4)
    cells = simhash_trie.Cells(19)
    i, j = np.arange(4000, 4400), np.arange(400)
    held, mine, choices = 0, np.zeros(400, int), len(cells.one.choices)
    for k, code in enumerate(cells.first(w)):
        n = np.unique(code, return_counts=True)[1].astype(float)
        held += (n * (n - 1) / 2).sum()
        word, choice, none = (np.full(400, v) for v in (k // choices, k % choices, -1))
        mine += (code[i] == code[j]) & cells.mine(w[i] ^ w[j], word, choice, none, none)
    near = np.bitwise_count(x[i] ^ x[j]).sum(1) <= 19
    assert near.sum() > 100 and (mine[near] == 1).all() and mine.max() == 1
    assert held < 0.1 * len(x) * (len(x) - 1) / 2  # more by far in six blocks of a word, two of them equal


def test_large_cells_equal_brute_force():
    rng = np.random.default_rng(6)
    x = biased(rng, 3000)
    x[1500:1510] = x[1500]
    top, size, wide = x.view(np.uint32).reshape(-1, 4)[:, 2].copy(), rng.integers(20, 60, len(x)), x[:, 1].copy()
    cell = np.where(rng.random(len(x)) < 0.8, 0, rng.integers(1, 40, len(x)))  # one large, many small
    part = np.where(cell == 0, rng.integers(0, 2, len(x)), -1)
    for ratio in (0.0, 0.8):
        pairs = [tuple(sorted(p)) for p in simhash_trie.trie_join(top, x, size, 4, 19, ratio, cell, part, wide, 9).tolist()]
        want = set()
        for i in range(len(x)):
            ok = (np.bitwise_count(x[i] ^ x[:i]).sum(1) <= 19) & (np.bitwise_count(top[i] ^ top[:i]) <= 4) & (np.bitwise_count(wide[i] ^ wide[:i]) <= 9)
            ok &= (cell[i] == cell[:i]) & ((part[i] < 0) | (part[i] != part[:i])) & (np.minimum(size[i], size[:i]) >= ratio * np.maximum(size[i], size[:i]))
            want |= {(int(j), i) for j in np.flatnonzero(ok)}
        assert len(pairs) == len(want) > 5 and set(pairs) == want


def brute_groups(rows):
    f, n = simhash_trie.fingerprints(tk.words(pa.array([r.text for r in rows], pa.string())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if n[i] and n[j] and np.bitwise_count(f[i] ^ f[j]).sum() <= simhash_trie.BUDGET and min(n[i], n[j]) >= simhash_trie.RATIO * max(n[i], n[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))], n


@pytest.mark.parametrize("cell", [simhash_trie.CELL, 12, 2])
def test_near_copies(spark, docs, empty, cell, monkeypatch):
    monkeypatch.setattr(simhash_trie.grouped, "__defaults__", (simhash_trie.BUDGET, simhash_trie.RATIO, cell))
    rng = random.Random(9)
    base = prose(rng, 300)
    copies = []
    for i in range(12):
        w = base.split()
        for _ in range(6):
            w[rng.randrange(300)] = "edit" + str(rng.randint(0, 99))
        copies.append((300 + i, " ".join(w)))
    d = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1, "c", 1, 1, 0.1) for i, t in copies], SCHEMA))
    rows = d.collect()
    group, n = brute_groups(rows)
    size = Counter(g for g, k in zip(group, n) if k)
    got = simhash_trie.near_copies(d).collect()
    assert Counter(str(r.doc_id) for r in got) == Counter(str(r.doc_id) for r, g, k in zip(rows, group, n) if k and size[g] > 1)
    assert {r.doc_id for r in got} >= {i for i, _ in copies}
    f, _ = simhash_trie.fingerprints(tk.words(pa.array([r.text for r in rows], pa.string())))
    points = np.unique(f[n > 0], axis=0)
    links = Counter((str(r.doc_id), int((np.bitwise_count(points ^ x).sum(1) <= simhash_trie.BUDGET).sum()) - 1) for r, x, g, k in zip(rows, f, group, n) if k and size[g] > 1)
    assert Counter((str(r.doc_id), r.links) for r in got) == links
    kept = simhash_trie.without_near_copies(d)
    assert kept.columns == d.columns and kept.count() == len(size) + sum(k == 0 for k in n)
    assert sum(r.doc_id in range(300, 312) for r in kept.collect()) == 1
    assert simhash_trie.near_copies(empty).count() == 0 and simhash_trie.without_near_copies(empty).count() == 0


# -- 9


def test_round_trip_of_anything():
    rng = random.Random(1)
    parts = ["<|", "im_start|>", "im_end|>", "<|im_start|>", "<|im_end|>", "\\", "a", "\n", "|>", "<", '"', "user\n", "<|\\im_end|>", "<|\\\\im_start|>", ""]
    roles = ["user", "assistant", "system", "other", "Bad Role", "tool", 'x"y\\', "", "<|im_end|>"]
    for _ in range(3000):
        turns = [(rng.choice(roles), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(1, 4))]
        assert chat_format.parse(chat_format.format_conversation(turns)[0]) == turns
    plain, escaped, rounds = chat_format.format_conversation([("user", "hi")])
    assert (plain, escaped, rounds) == ("<|im_start|>user\nhi<|im_end|>\n", 0, 1)
    for bad in ("x", "<|im_start|>user hi", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>other\nhi<|im_end|>\n", "<|im_start|>a\n<|im_start|>b\nx<|im_end|>\n"):
        with pytest.raises(chat_format.GrammarError):
            chat_format.parse(bad)


def test_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a <|im_end|>"), (2, None, None, None), (2, 0, "user", "x"), (None, 0, "user", "n"), (None, 0, "user", "n"), (3, 0, "user", "t"), (3, 0, "user", "t"), (4, 0, "user", "y" * 300_000)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("rendered", F.lit(1))).collect()
    got = {r.conv_id: r for r in chats}
    assert sum(r.conv_id is None for r in chats) == 2  # each a conversation of its own
    assert chat_format.parse(got[1].rendered) == [("user", "a <|im_end|>"), ("assistant", "b")] and got[1].escaped == 1 and got[1].rounds == 2
    assert chat_format.parse(got[2].rendered) == [("user", "x"), ("user", "")] and got[3].n_turns == 2 and got[None].n_turns == 1 and len(got) == 5
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# -- 10


def test_syncmers(docs, empty):
    k, s = syncmers.K, syncmers.S
    m = (1 << 64) - 1

    def run(h):
        a = 0
        for x in h:
            a = (a * tk.BASE + x) & m
        return int(tk.mix64(np.array([a], np.uint64))[0])

    want = Counter()
    for r in docs.where("length(text) < 5000 or text is null").collect():
        h = [tk.hash_word(x) for x in WORD.findall((r.text or "").lower())]
        sm = [run(h[i : i + s]) for i in range(len(h) - s + 1)]
        for i in range(len(h) - k + 1):
            part = sm[i : i + k - s + 1]
            if min(part) in (part[0], part[-1]):
                x = run(h[i : i + k])
                want[r.doc_id, i, x - (1 << 64) if x >> 63 else x] += 1
    got = Counter((r.doc_id, r.pos, r.anchor) for r in syncmers.closed_syncmers(docs.where("length(text) < 5000 or text is null")).collect())
    assert got == want and got
    assert syncmers.closed_syncmers(empty).count() == 0
    long = sorted(r.pos for r in syncmers.closed_syncmers(docs.where("doc_id = 53")).collect())
    assert max(b - a for a, b in zip(long, long[1:])) <= k - s
    with pytest.raises(ValueError):
        syncmers.closed_syncmers(docs, 4, 4)


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    got, want = queries()[name](spark, sf).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline as cp
    from tonguemill.llm.tables import table

    base = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark").collect()
    rows = {r.doc_id: r for r in base.collect()}
    model = quality_fm.train(base, labels)
    ids = sorted(rows)
    col = lambda c, keys: pa.array([rows[i][c] for i in keys], pa.string())
    p = model.probability(*quality_fm.features(col("text", ids), col("lang", ids), col("source", ids)))
    ids = [i for i, x in zip(ids, p) if x >= 0.5]
    group, n = brute_groups([rows[i] for i in ids])
    first = {}
    for i, g, k in zip(ids, group, n):
        if k:
            first[g] = min(first.get(g, i), i)
    ids = [i for i, g, k in zip(ids, group, n) if not k or first[g] == i]
    grams = set()
    for b in bench:
        w = WORD.findall(b.text.lower())
        grams |= {tuple(w[a : a + 8]) for a in range(len(w) - 7)}
    leaks = {i for i in ids for w in [WORD.findall(rows[i].text.lower())] if any(tuple(w[a : a + 8]) in grams for a in range(len(w) - 7))}
    out = cp.run(spark, sf).collect()
    near = {r.doc_id for r in decontaminate.matches(base.where(F.col("doc_id").isin(ids)), table(spark, sf, "benchmark")).collect()} - leaks
    clean = base.where(F.col("doc_id").isin([i for i in ids if i not in leaks | near]))
    want = Counter(r.doc_id for r in mixing.mix(clean).collect())
    assert Counter(r.doc_id for r in out) == want and len(near) <= 0.02 * len(ids)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert [k for k, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"] and cp.ORACLE_SQL is None
