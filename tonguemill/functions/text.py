"""Text and script functions as native Column expressions: they stay in the JVM, in
whole-stage code, and their filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of each script that the router knows, as the inside of a character class.
SCRIPTS = {
    "Latin": r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "Cyrillic": r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "Devanagari": r"\x{0900}-\x{097F}",
    "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "Kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}",
    "Han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
}
#: Unicode White_Space, spelled out: dialects of \s differ.
SPACE = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What Python's str.split takes for white space besides.
PY_SPACE = SPACE + r"\x{001C}-\x{001F}"
_DOMAIN = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _count(text: Column, inside: str) -> Column:
    """Characters of a class: what is left when all others are taken away."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def script_count(text: Column | str, script: str) -> Column:
    return _count(_c(text), SCRIPTS[script])


def char_script(ch: Column | str) -> Column:
    """The script of a single character, or null."""
    out = F.lit(None).cast("string")
    for name, inside in SCRIPTS.items():
        out = F.when(_c(ch).rlike(f"^[{inside}]$"), F.lit(name)).otherwise(out)
    return out


def route(text: Column | str) -> Column:
    """struct(route, direct_lang): where a text is to be scored.

    Any kana means Japanese; else the most frequent of Latin, Cyrillic and Han
    (ties: Han, then Cyrillic); else Devanagari, then Arabic; else unknown.
    """
    t = _c(text)
    has = lambda *s: t.rlike(f"[{''.join(SCRIPTS[x] for x in s)}]")
    r = lambda kind, lang=None: F.struct(F.lit(kind).alias("route"), F.lit(lang).cast("string").alias("direct_lang"))
    # the counts are bound once, and needed only where there are letters of two scripts
    n = F.struct(*[script_count(t, s).alias(s) for s in ("Latin", "Cyrillic", "Han")])
    most = F.transform(F.array(n), lambda c: F.when((c["Han"] > 0) & (c["Han"] >= c["Latin"]) & (c["Han"] >= c["Cyrillic"]), r("direct", "cmn")).when((c["Cyrillic"] > 0) & (c["Cyrillic"] >= c["Latin"]), r("cyrillic")).otherwise(r("latin")))[0]
    return (
        F.when(t.isNull(), r("unknown"))
        .when(~has("Cyrillic", "Kana", "Han", "Devanagari", "Arabic"), F.when(has("Latin"), r("latin")).otherwise(r("unknown")))
        .when(has("Kana"), r("direct", "jpn"))
        .when(has("Cyrillic", "Han"), F.when(~has("Latin", "Cyrillic"), r("direct", "cmn")).when(~has("Latin", "Han"), r("cyrillic")).otherwise(most))
        .when(has("Latin"), r("latin"))
        .when(has("Devanagari"), r("direct", "hin"))
        .otherwise(r("direct", "ara"))
    )


def classify_word(word: Column | str) -> Column:
    """word | url | email | mention | num, the first rule that fits."""
    w = _c(word)
    return (
        # most words hold none of these, and one test settles them
        F.when(w.rlike(r"^[^\x{00}-\x{7F}]|^[^0-9@.:]*$"), "word")
        .when(w.rlike(r"(?s)^@.+"), "mention")
        .when(w.rlike(r"^(?i:https?://|www\.)"), "url")
        .when(w.rlike(rf"^[A-Za-z0-9._%+-]+@{_DOMAIN}$") & ~w.rlike(r"[\n\r]$"), "email")
        .when(w.rlike(r"(?s)^[\x{00}-\x{7F}]*$") & w.rlike("[0-9]"), "num")
        .when(w.rlike(rf"^{_DOMAIN}$"), "url")
        .otherwise("word")
    )


def strip_hash(word: Column | str) -> Column:
    """Without one leading ``#``."""
    return F.regexp_replace(_c(word), "^#", "")


def words(text: Column | str) -> Column:
    """Runs without Unicode white space; never null."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def retained_words(text: Column | str) -> Column:
    """The words that features are made of: one leading ``#`` taken off, empty ones dropped."""
    return F.filter(F.transform(words(text), strip_hash), lambda w: w != "")


def word_tokens(text: Column | str) -> Column:
    """Words with a letter."""
    return F.filter(words(text), lambda w: w.rlike(r"\p{IsAlphabetic}"))


def fragments(text: Column | str, n: int) -> Column:
    """All runs of ``n`` consecutive word tokens, joined by a space."""
    w = word_tokens(text)
    if n == 1:
        return w
    # shifted copies side by side; a lambda over places would make the words anew for each
    long_enough = F.greatest(F.size(w) - (n - 1), F.lit(0))
    out = F.slice(w, 1, long_enough)
    for i in range(2, n + 1):
        out = F.zip_with(out, F.slice(w, i, long_enough), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def flatten(text: Column | str) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), f"[{PY_SPACE}]+", " "))


def cyrillic_ratio(text: Column | str) -> Column:
    """Share of U+0400-04FF among letters; 0 without letters."""
    only = F.regexp_replace(_c(text), r"[^\p{L}]+", "")
    n = F.length(only)
    return F.when(n > 0, (n - F.length(F.regexp_replace(only, r"[\x{0400}-\x{04FF}]+", ""))) / n).otherwise(F.lit(0.0))


def is_cyrillic(text: Column | str) -> Column:
    """More Cyrillic (U+0400-052F) than ASCII letters, and some."""
    cyr = _count(_c(text), r"\x{0400}-\x{052F}")
    return (cyr > 0) & (cyr > _count(_c(text), "A-Za-z"))


def script_counts(text: Column | str) -> Column:
    """struct(latin: ASCII letters, cyrillic: U+0400-04FF)."""
    return F.struct(_count(_c(text), "A-Za-z").alias("latin"), _count(_c(text), r"\x{0400}-\x{04FF}").alias("cyrillic"))


def length_bucket(text: Column | str) -> Column:
    """0: up to 20 characters; 1: up to 100; 2: longer."""
    n = F.length(_c(text))
    return F.when(n <= 20, 0).when(n <= 100, 1).otherwise(2)


def judge_text(text: Column | str) -> Column:
    """Without a leading RT, mentions and addresses, in that order; flattened."""
    w = r"[\p{L}\p{N}_]"
    t = F.regexp_replace(_c(text), rf"^RT(?!{w})[:{PY_SPACE}]*", " ")
    t = F.regexp_replace(t, rf"@{w}+", " ")
    return flatten(F.regexp_replace(t, rf"https?://[^{PY_SPACE}]+|(?<!{w})www\.[^{PY_SPACE}]+", " "))


def sentences(text: Column | str, least: int = 20, most: int = 200) -> Column:
    """Pieces after sentence marks and line ends, flattened, of allowed length."""
    parts = F.transform(F.split(_c(text), rf"(?<=[.!?…])[{PY_SPACE}]+|\n+"), flatten)
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def is_boilerplate(line: Column | str) -> Column:
    """Navigation lines of wiki pages."""
    return F.lower(_c(line)).rlike(r"^(?:[|←→]|навигация|поиск|редактировать|источник)")


def certified(lang: Column | str, text: Column | str) -> Column:
    """Spelling proves the language: a letter that only rus, ukr or bel has, and none of another's."""
    own = {"rus": "[ыъёэ]", "ukr": "[іїєґ]", "bel": "[ў]"}
    l, t = _c(lang), _c(text)
    out = F.lit(False)
    for code, mark in own.items():
        foreign = "|".join(m for c, m in own.items() if c != code)
        out = F.when(l == code, t.rlike(mark) & ~t.rlike(foreign)).otherwise(out)
    return out


def crc32_split(lang: Column | str, text: Column | str) -> Column:
    """train | val | test (8 : 1 : 1) by content."""
    h = F.crc32(F.encode(F.concat(_c(lang), F.lit("\0"), _c(text)), "UTF-8")) % 10
    return F.when(h < 8, "train").when(h == 8, "val").otherwise("test")


def token_count(text: Column | str) -> Column:
    """Feature keys of a text at n = 1..5, without making them: from the lengths of
    its words (a sentinel counts as one character)."""
    w = retained_words(text)
    one = lambda x: F.when(classify_word(x) == "word", F.length(F.lower(x))).otherwise(1)
    keys = lambda n: F.when(n == 1, 6).when(n == 2, 10).otherwise(5 * n) + 1
    total = F.aggregate(F.transform(w, lambda x: keys(one(x))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total + F.greatest(F.size(w) - 1, F.lit(0))


def serbian_latin(word: Column | str) -> Column:
    """Serbian Cyrillic in Latin letters (lower case)."""
    w = F.translate(_c(word), "абвгдђежзијклмнопрстћуфхцчшёыэ", "abvgdđežzijklmnoprstćufhcčšeye")
    for a, b in zip("љњџюя", ("lj", "nj", "dž", "ju", "ja")):
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def lemma_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters (and letter-like numbers)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
