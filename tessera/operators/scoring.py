"""Scores against gold labels, with gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(gold: DataFrame, predicted: DataFrame, key: list[str], tolerance: float = 0.005) -> DataFrame:
    """One row per gold field: tp, wrong_value, wrong_period, wrong_currency or missing, by its nearest prediction.

    gold: key, value, period, currency; predicted: the same names. Of several
    predictions of a key the first by period, currency and difference decides.
    """
    p = predicted.select(*key, F.col("value").alias("p_value"), F.col("period").alias("p_period"), F.col("currency").alias("p_currency"))
    j = gold.join(p, key, "left")
    rank = F.struct((F.col("p_period") != F.col("period")).cast("int"), (F.col("p_currency") != F.col("currency")).cast("int"), F.abs(F.col("p_value") - F.col("value")), "p_value", "p_period", "p_currency")
    best = j.groupBy(*key, "value", "period", "currency").agg(F.min(F.when(F.col("p_value").isNotNull(), rank)).alias("b"))
    off = F.abs(F.col("b.p_value") - F.col("value")) > F.abs("value") * tolerance
    label = F.when(F.col("b").isNull(), "missing").when(F.col("b.p_period") != F.col("period"), "wrong_period").when(F.col("b.p_currency") != F.col("currency"), "wrong_currency").when(off, "wrong_value").otherwise("tp")
    return best.select(*key, "value", label.alias("outcome"))


def scorecard(results: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and rates per group; recall counts every gold field."""
    n = lambda *o: F.sum(F.col("outcome").isin(*o).cast("int"))
    g = results.groupBy(*by).agg(F.count("*").alias("total_gold"), n("tp").alias("tp"), n("wrong_value", "wrong_period", "wrong_currency").alias("fp"), n("wrong_period").alias("n_period"), n("wrong_currency").alias("n_currency"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("total_gold"))
    g = g.withColumns({"precision": p, "recall": r, "f1": safe(2 * p * r, p + r), "wrong_period_rate": safe(F.col("n_period"), F.col("total_gold")), "wrong_currency_rate": safe(F.col("n_currency"), F.col("total_gold"))})
    return g.drop("n_period", "n_currency")


def gates(cards: DataFrame, precision: float = 0.97, recall: float = 0.90, period: float = 0.01, currency: float = 0.01) -> DataFrame:
    ok = (F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.col("wrong_period_rate") <= period) & (F.col("wrong_currency_rate") <= currency)
    return cards.withColumn("passed", ok)
