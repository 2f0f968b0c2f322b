"""Verdicts of judges on labeled rows. Judges are columns: any model can be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts
from ..functions import text as tx
from ..functions.langs import CODES, LABEL_ALIASES, twin_protected

CYRILLIC, LATIN = CODES[:21], CODES[21:26]


def latin_candidate(lang: Column, text: Column) -> Column:
    """A row of a Cyrillic language with clearly more ASCII letters, at least 4."""
    n = scripts.letters(F.when(lang.isin(CYRILLIC), text), latin="A-Za-z", cyrillic=r"\x{0400}-\x{04FF}")
    return lang.isin(CYRILLIC) & (n["latin"] >= F.greatest(F.lit(4), n["cyrillic"] + 1))


def drop_rule(lang: Column, pred: Column, conf: Column, latin_verdict: Column, min_conf: float = 0.995, in_scope: Column | None = None) -> Column:
    """Whether a row goes. A confident other verdict decides alone: it drops the row
    unless both languages are close. Without one, a verdict of Latin script does."""
    scope = F.lit(True) if in_scope is None else in_scope
    sure = F.coalesce(pred.isNotNull() & (pred != lang) & (conf >= min_conf) & scope, F.lit(False))
    return F.when(sure, ~twin_protected(lang, pred)).otherwise(F.coalesce(latin_verdict, F.lit(False)))


def marked(rows: DataFrame, min_conf: float = 0.995, only_langs: list[str] | None = None) -> DataFrame:
    """Rows (lang, text, pred, conf, latin_top, latin_p) with ``dropped``, in one pass."""
    scope = F.col("lang").isin(only_langs) if only_langs else F.lit(True)
    latin = scope & latin_candidate(F.col("lang"), F.col("text")) & F.col("latin_top").isin("en", "es", "fr", "pt", "de") & (F.col("latin_p") >= 0.9)
    return rows.withColumn("dropped", drop_rule(F.col("lang"), F.col("pred"), F.col("conf"), latin, min_conf, scope))


def clean(rows: DataFrame, min_conf: float = 0.995, only_langs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of rows (lang, text, pred, conf, latin_top, latin_p)."""
    both = marked(rows, min_conf, only_langs)
    return both.where(~F.col("dropped")).drop("dropped"), both.where("dropped").drop("dropped")


def hard_negatives(rows: DataFrame, min_conf: float = 0.98, per_source: int = 4000) -> DataFrame:
    """Confident errors on rows (source, lang, text, pred, conf): what a model gets wrong though
    it is sure, but between close languages; up to ``per_source``, the surest first."""
    from pyspark.sql import Window

    wrong = rows.where(F.col("pred").isNotNull() & (F.col("conf") >= min_conf) & (F.col("pred") != F.col("lang")) & ~twin_protected(F.col("lang"), F.col("pred")))
    w = Window.partitionBy("source").orderBy(F.desc("conf"), "text")
    return wrong.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_source).drop("__r")


def to_ours(label: Column, which: str) -> Column:
    """Our code for a label of another identifier, or null."""
    pairs = [x for code, labels in LABEL_ALIASES[which].items() for l in labels for x in (F.lit(l), F.lit(code))]
    return F.create_map(*pairs)[label]


def short_verify(rows: DataFrame, judges: list[str], min_agree: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows on whose language enough of the judge columns agree."""
    n = sum((F.coalesce(F.col(j) == F.col("lang"), F.lit(False)).cast("int") for j in judges), F.lit(0))
    marked = rows.withColumn("__n", n)
    return marked.where(F.col("__n") >= min_agree).drop("__n"), marked.where(F.col("__n") < min_agree).drop("__n")


def vote(pred: Column, lang: Column) -> Column:
    """affirm | twin | contradict | abstain."""
    return F.when(pred.isNull(), "abstain").when(pred == lang, "affirm").when(twin_protected(lang, pred), "twin").otherwise("contradict")


def referee_accepts(votes: list[Column], text: Column) -> Column:
    """Two affirm; or one does, none contradicts, and there are two words or more."""
    count = lambda what: sum(((v == what).cast("int") for v in votes), F.lit(0))
    return (count("affirm") >= 2) | ((count("affirm") == 1) & (count("contradict") == 0) & (F.size(tx.words(text)) >= 2))


def referee(rows: DataFrame, train: DataFrame, judges: list[str], per_lang: int = 500, seed: int = 42) -> DataFrame:
    """Short rows for evaluation: not in training, proven by spelling or by votes, up to
    ``per_lang`` of each language."""
    from .mix import balanced_sample, exclude

    fresh = exclude(rows, train, ["text"])
    ok = tx.certified("lang", "text") | referee_accepts([vote(F.col(j), F.col("lang")) for j in judges], F.col("text"))
    return balanced_sample(fresh.where(ok), per_lang, seed)
