"""Losses of scored tables as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bce(y: Column, x: Column, pos_weight: float = 1.0) -> Column:
    """Mean binary cross-entropy from logits over rows whose target is there."""
    soft = F.log1p(F.exp(-F.abs(x)))
    return F.avg(F.when(y.isNotNull(), y * pos_weight * (F.greatest(-x, F.lit(0.0)) + soft) + (1 - y) * (F.greatest(x, F.lit(0.0)) + soft)))


def mse(y: Column, s: Column) -> Column:
    return F.avg((y - s) ** 2)


def cross_entropy(label: Column, logits: Column) -> Column:
    """Mean over rows: log-sum-exp of the logits less the label's (0-based)."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b))
    return F.avg(lse - F.get(logits, label))


def _squared(margin: Column) -> Column:
    return F.sum(margin * margin)


#: Losses over pairs of a positive's score ``p``, a negative's score ``n`` and a weight ``w``.
PAIR_LOSSES = {
    "auc": lambda p, n, w: _squared(1 - (p - n)),
    "hinge_auc": lambda p, n, w: _squared(F.greatest(1 - (p - n), F.lit(0.0))),
    "weighted_auc": lambda p, n, w: F.sum(w * (1 - (p - n)) ** 2),
    "adaptive_auc": lambda p, n, w: _squared(w - (p - n)),
    "weighted_hinge_auc": lambda p, n, w: F.sum(w * F.greatest(w - (p - n), F.lit(0.0)) ** 2),
    "adaptive_hinge_auc": lambda p, n, w: _squared(F.greatest(w - (p - n), F.lit(0.0))),
    "log_rank": lambda p, n, w: -F.avg(F.log(1 / (1 + F.exp(-(p - n))) + 1e-15)),
}
WEIGHTED = {"weighted_auc", "adaptive_auc", "weighted_hinge_auc", "adaptive_hinge_auc"}


def pair_loss(positives: DataFrame, negatives: DataFrame, key: str, name: str = "auc", weight: str | None = None) -> DataFrame:
    """``loss`` over each positive and its negatives; an unknown name falls back to ``auc``; weighted ones need a weight."""
    name = name.lower() if name.lower() in PAIR_LOSSES else "auc"
    if name in WEIGHTED and weight is None:
        raise ValueError(f"{name} needs a weight")
    met = positives.withColumn("_w", F.col(weight) if weight else F.lit(1.0)).select(key, "_w", F.col("score").alias("_p")).join(negatives.select(key, F.col("score").alias("_n")), key)
    return met.agg(PAIR_LOSSES[name](F.col("_p"), F.col("_n"), F.col("_w")).alias("loss"))


def ce_loss(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    sig = lambda x: 1 / (1 + F.exp(-x))
    a, b = positives.agg((-F.avg(F.log(sig(F.col("score")) + 1e-15))).alias("a")), negatives.agg((-F.avg(F.log(1 - sig(F.col("score")) + 1e-15))).alias("b"))
    return a.join(F.broadcast(b)).select((F.col("a") + F.col("b")).alias("loss"))


def info_nce(positives: DataFrame, negatives: DataFrame, key: str) -> DataFrame:
    sums = negatives.groupBy(key).agg(F.sum(F.exp("score")).alias("_n"))
    met = positives.join(sums, key)
    return met.agg((-F.avg(F.log(F.exp("score") / (F.exp("score") + F.col("_n")) + 1e-15))).alias("loss"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    return df.agg(((F.count("*") - F.sum(label)) / F.nullif(F.sum(label), F.lit(0))).alias("weight"))
