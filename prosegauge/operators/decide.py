"""Verdicts, bands and evaluation over tables of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.plans import decide as P
from prosegauge.plans.run import run


def stand_in_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Deterministic class probabilities, for checks without a model: integer arithmetic on the id, pulled towards the true class."""
    y = F.col("y")
    weight = [(F.pmod(F.col("doc_id") * m, F.lit(101)) + 1 + F.when(y == k, 60).otherwise(0)).cast("double") for k, m in enumerate((37, 53, 71))]
    base = docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.length("text").alias("n_chars"), ((F.col("quality") + F.col("doc_id")) % 3).cast("int").alias("y"))
    total = weight[0] + weight[1] + weight[2]
    out = base.select("doc_id", "lang", "source", "y", *((w / total).alias(f"p{k}") for k, w in enumerate(weight)), F.floor(F.col("n_chars") / 60).cast("long").alias("n_sentences"), F.floor(F.col("n_chars") / 6).cast("long").alias("n_words"))
    return out


def over_predictions(plan: str):
    return lambda pred: run(pred.sparkSession, plan, pred=pred)


def stand_in_scores(sents: DataFrame) -> DataFrame:
    """Deterministic sentence scores from ids."""
    score = F.pmod(F.col("doc_id") * 131 + F.col("sent_id") * 17, F.lit(1000)) / F.lit(1000.0)
    return sents.select("doc_id", "sent_id", "para_id", F.size("words").cast("long").alias("n_words"), score.alias("score"))


def over_scores(plan: str):
    return lambda scored: run(scored.sparkSession, plan, scored=scored)


VERDICT, CONFUSION, SUMMARY, RELIABILITY, AUC, CURVES = (over_predictions(p) for p in (P.VERDICT, P.CONFUSION, P.SUMMARY, P.RELIABILITY, P.AUC, P.CURVES))
