import random

import numpy as np
import pyarrow as pa
import pytest

from tonguemill.functions import features as fx
from tonguemill.functions import hashing as hs
from tonguemill.functions import scripts, sentences

M = (1 << 64) - 1
TEXTS = ["ab", "abc", "https://t.co/x", "a b", "", "  ", "#", "# #", "Привет мир", "#Да нет", "#2020", "test@mail.ru x", "ΣΑΣ K İ", "a\x1cb c", "北京是", "x" * 50, "миллион2020 U.S.A. т.е. a@b @ @x", "a b　c"]


def naive(text, cfg=fx.FeatureConfig()):
    """The definition, one character at a time."""
    out, prev = [], None
    for w in fx._WHITE.split(text):
        w = w[1:] if w.startswith("#") else w
        if not w:
            continue
        kind = fx.classify_word(w)
        s = [fx.SENTINEL[kind]] if kind != "word" else [ord(c) for ch in w for c in ch.lower()]
        r = 0
        for i, c in enumerate([2, *s, 3]):
            r = (r << 21 | c) & M
            for n in range(cfg.n_min, min(cfg.n_max, i + 1) + 1):
                out.append((r & (1 << 21 * n) - 1 if n <= 3 else r) ^ n * 0x9E3779B97F4A7C15 & M)
        h = 0xCBF29CE484222325
        for c in s:
            h = (h ^ c) * 0x100000001B3 & M
        out.append(h ^ 6 * 0x9E3779B97F4A7C15 & M)
        if prev is not None:
            x = prev ^ (h << 32 | h >> 32) & M
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x ^= x >> 33
                x = x * m & M
            out.append(x ^ x >> 33 ^ 7 * 0x9E3779B97F4A7C15 & M)
        prev = h
    return out


@pytest.mark.parametrize("cfg", [fx.FeatureConfig(), fx.FeatureConfig(1, 3), fx.FeatureConfig(2, 4)])
def test_batch_equals_definition(cfg):
    keys, off = fx.text_keys(pa.array([*TEXTS, None]), cfg)
    for i, t in enumerate([*TEXTS, ""]):
        assert [int(k) for k in keys[off[i] : off[i + 1]]] == naive(t, cfg)


def test_key_counts():
    three = fx.FeatureConfig(1, 3)
    assert [len(fx.token_keys(t)) for t in ("ab", "abc", "www.x.y", "", "   ", "#", "# #")] == [11, 16, 7, 0, 0, 0, 0]
    assert len(fx.token_keys("ab", three)) == 10 and len(fx.token_keys("ab cd", three)) == 21
    assert len(fx.token_keys("a b", fx.FeatureConfig(2, 2))) == 7


@pytest.mark.parametrize("a,b", [("Привет", "привет"), ("https://a.com/x", "t.co"), ("#Да", "да"), ("да # нет", "да нет"), ("#2020", "2020"), ("Привет @nick пока", "Привет @x пока")])
def test_invariances(a, b):
    assert fx.token_keys(a) == fx.token_keys(b)


def test_classes():
    known = {"url": "https://t.co/3Kr7yzeYLC HTTP://EXAMPLE.COM/PATH www.grozny-inform.ru t.co example.com", "email": "test@mail.ru a.b+c%tag@sub.domain.org", "mention": "@daria_karapet", "num": "2020 3.5.2 100px COVID19", "word": "a@b @ т.е. т.д. миллион2020 U.S.A. Привет тест@пример.ру Ёлка"}
    for kind, words in known.items():
        for w in words.split():
            assert fx.classify_word(w) == kind, w


@pytest.mark.parametrize("which", hs.HASHES)
@pytest.mark.parametrize("log2_d", [12, 17])
def test_hashes_equal_plain_arithmetic(which, log2_d):
    m = 0xFFFFFFFF

    def fm(h):
        h ^= h >> 16
        h = h * 0x85EBCA6B & m
        h ^= h >> 13
        h = h * 0xC2B2AE35 & m
        return h ^ h >> 16

    def mm(k, seed):
        k = k * 0x5BD1E995 & m
        k = (k ^ k >> 24) * 0x5BD1E995 & m
        h = (seed * 0x5BD1E995 & m) ^ k
        h = (h ^ h >> 13) * 0x5BD1E995 & m
        return h ^ h >> 15

    rng = random.Random(3)
    keys = [0, 1, M, *(rng.getrandbits(64) for _ in range(500))]
    for seed in (hs.SEED, 12345):
        turned = (seed << 16 | seed >> 16) & m
        one = {"fmix32": lambda k: fm((k & m) ^ (seed * 0x85EBCA6B & m) ^ ((k >> 32) * 0xC2B2AE35 & m)), "murmur2": lambda k: mm((k & m) ^ seed, seed) ^ mm((k >> 32) ^ turned, turned), "multiply_shift": lambda k: ((k * 0x9E3779B97F4A7C15 & M) >> 32) ^ seed}[which]
        b, neg = hs.buckets(np.array(keys, np.uint64), log2_d, which, seed)
        want = [one(k) for k in keys]
        assert b.tolist() == [h >> 32 - log2_d for h in want] and neg.tolist() == [bool(h & 1) for h in want]


def test_spread():
    assert hs.fmix32(0)[0] == 0
    with np.errstate(over="ignore"):
        b, _ = hs.buckets(np.arange(200_000, dtype=np.uint64) * np.uint64(11400714819323198485), 17)
    assert np.bincount(b).max() < 12


def test_first_k_ids():
    ids, off = fx.signed_ids(pa.array(["Привет, как дела?", "", "ab"]), 12)
    for k in (0, 1, 7, 11, 500):
        cut, o = fx.signed_ids(pa.array(["Привет, как дела?", "", "ab"]), 12, k=k)
        for i in range(3):
            assert cut[o[i] : o[i + 1]].tolist() == ids[off[i] : off[i + 1]][:k].tolist()
    b, neg, _ = fx.bucket_tokens(pa.array(["ab"]), 12)
    assert hs.signed_index(b, neg, 12).tolist() == [x + 4097 if n else x for x, n in zip(b, neg)]


def test_routes():
    for text, want in {"Привет, как дела?": "cyrillic", "Hello world": "latin", "¿Dónde está el baño?": "latin", "Привіт hello мир": "cyrillic", "こんにちは世界": "jpn", "北京是中国的首都": "cmn", "नमस्ते दुनिया": "hin", "مرحبا بالعالم": "ara", "12345 !!!": "unknown", "東京駅へ行くのが好きですか": "jpn", "ab вг": "cyrillic", "ab 北京": "cmn", "a مرحبا": "latin", "": "unknown"}.items():
        assert scripts.route(text) == want, text


def test_sentences():
    for text, n in {"Л. Н. Толстой родился в 1828 г. и жил долго": 1, "Цена 3.5 рубля. Дорого!": 2, "— Нет, — сказал он. — Да.": 2, "Что?.. О!": 2, "(Приказ № 5.) Всё.": 2, "": 0, "  ": 0}.items():
        assert len(sentences.split_line(text)) == n, text
    assert sentences.glue_short(sentences.split_line("«Да!» — сказал он."), 20) == ["«Да!» — сказал он."]
    assert len(sentences.glue_short(["— Нет.", "— Да.", "— Отвяжись."], 20)) == 3
    assert sentences.line_sentences("# head\n\nOne. Two.\n") == ["One.", "Two."]
