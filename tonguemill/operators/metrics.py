"""Evaluation over one table of predictions (gold, pred, text). ``pred`` may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fragments import in_pieces
from ..functions.langs import CODES



def accuracy(pred: DataFrame, *by: str) -> DataFrame:
    """(by..., ok, n, accuracy)."""
    right = F.col("gold").eqNullSafe(F.col("pred")).cast("bigint")
    return pred.groupBy(*by).agg(F.sum(right).alias("ok"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.col("ok") / F.col("n"))


def confusion(pred: DataFrame) -> DataFrame:
    """(gold, pred, n); undetermined predictions are null."""
    return pred.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def top_confusions(pred: DataFrame, k: int = 12) -> DataFrame:
    """The most frequent pairs that differ; ties by name."""
    return confusion(pred).where("pred is not null and gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(k)


def prf(pred: DataFrame) -> DataFrame:
    """(lang, tp, gold_total, pred_total, n_und, precision, recall, f1), by f1.

    Rows without a prediction don't count as missed; ``n_und`` has them. A ratio of
    nothing is null, and so is an f1 made of it; f1 is 0 if both are 0.
    """
    gold = pred.where("gold is not null").groupBy(F.col("gold").alias("lang")).agg(F.sum(F.col("pred").isNotNull().cast("bigint")).alias("gold_total"), F.sum(F.col("gold").eqNullSafe(F.col("pred")).cast("bigint")).alias("tp"), F.sum(F.col("pred").isNull().cast("bigint")).alias("n_und"))
    made = pred.where("pred is not null").groupBy(F.col("pred").alias("lang")).agg(F.count(F.lit(1)).alias("pred_total"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    x = gold.join(made, "lang", "full").select("lang", z("tp"), z("gold_total"), z("pred_total"), z("n_und"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    x = x.withColumns({"precision": ratio("tp", "pred_total"), "recall": ratio("tp", "gold_total")})
    total = F.col("precision") + F.col("recall")
    return x.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def by_length(pred: DataFrame, text: str = "text") -> DataFrame:
    """Accuracy by length bucket."""
    return accuracy(pred.withColumn("bucket", tx.length_bucket(text)), "bucket")


def fragment_rows(rows: DataFrame, n: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """(gold, n, text): all runs of ``n`` word tokens."""
    return rows.select(F.col(lang).alias("gold"), F.lit(n).alias("n"), F.explode(tx.fragments(text, n)).alias("text"))


def ladder(rows: DataFrame, predict, lang: str = "lang", text: str = "text") -> DataFrame:
    """Accuracy by granularity: words, pairs, triples (n = 1, 2, 3) and whole texts (0).

    ``predict`` maps a DataFrame with ``text`` to one with ``pred`` as well. Of some texts (2 MB), each
    distinct fragment is judged once; over all texts nearly all are different, and telling
    them apart would cost a shuffle of all.
    """
    rows = rows.select(F.col(lang).alias("gold"), F.col(text).alias("text"))
    whole = rows.select("gold", F.lit(0).alias("n"), "text", F.lit(1).cast("bigint").alias("c"))
    p = predict(whole.unionByName(rows.mapInArrow(in_pieces(), "gold string, n int, text string, c bigint")))
    return p.groupBy("n", "gold").agg(F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("c")).otherwise(0)).alias("ok"), F.sum("c").alias("n_rows")).withColumn("accuracy", F.col("ok") / F.col("n_rows"))


def worst(ladder_rows: DataFrame, k: int = 15) -> DataFrame:
    """The languages that do worst on single words."""
    return ladder_rows.where("n = 1").orderBy("accuracy", "gold").limit(k)


def coverage(pred: DataFrame, supported: list[str] = CODES) -> DataFrame:
    """Accuracy over all rows and over those whose language the tool knows."""
    s = F.col("gold").isin(list(supported)).cast("bigint")
    right = F.col("gold").eqNullSafe(F.col("pred")).cast("bigint")
    return pred.agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("n_supported"), F.sum(right).alias("ok"), F.sum(right * s).alias("ok_supported")).withColumns({"accuracy_all": F.col("ok") / F.col("n"), "accuracy_supported": F.col("ok_supported") / F.col("n_supported")})


def histogram(detected: DataFrame, lang: str = "lang_detected", uncertain: str = "is_uncertain") -> DataFrame:
    """(lang, n, n_uncertain); undetermined is ``und``."""
    return detected.groupBy(F.coalesce(F.col(lang), F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(uncertain).cast("bigint")).alias("n_uncertain"))


def error_dump(pred: DataFrame, per_gold: int, pos: str = "_pos") -> DataFrame:
    """Up to ``per_gold`` errors of each language in order of encounter, then by confidence."""
    w = Window.partitionBy("gold").orderBy(pos)
    wrong = pred.where(~F.col("gold").eqNullSafe(F.col("pred")))
    return wrong.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_gold).select("gold", F.coalesce("pred", F.lit("und")).alias("pred"), F.format_string("%.3f", F.col("confidence").cast("double")).alias("conf"), F.when(F.col("is_uncertain"), "uncertain").otherwise("").alias("flag"), tx.flatten("text").alias("text")).orderBy("gold", F.desc("conf"), "text")


def theta(conf: DataFrame, column: str = "confidence", share: float = 0.05) -> Column:
    """The confidence below which a share of the rows lies (linear interpolation)."""
    return conf.agg(F.expr(f"percentile({column}, {share})").alias("theta"))
