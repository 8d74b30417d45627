"""Predictions and losses of scored rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.operators.networks import TrainedNetwork
from postweave.operators.train import SoftmaxHead


def predict_class(df: DataFrame, logits: str = "logits", out: str = "prediction") -> DataFrame:
    """Add the position of the largest logit, the first one on a tie."""
    return df.withColumn(out, PF.argmax(F.col(logits)))


def cross_entropy(
    df: DataFrame, logits: str = "logits", label: str = "label", out: str = "loss"
) -> DataFrame:
    return df.withColumn(out, PF.cross_entropy(F.col(logits), F.col(label)))


def mean_cross_entropy(df: DataFrame, loss: str = "loss", weight: str | None = None) -> DataFrame:
    """Mean loss, or the weighted mean ``sum(w * loss) / sum(w)``."""
    if weight is None:
        return df.agg(F.avg(loss).alias("loss"))
    known = F.col(loss).isNotNull()
    return df.agg(
        (F.sum(F.col(weight) * F.col(loss)) / F.sum(F.when(known, F.col(weight)))).alias("loss")
    )


def score_split(
    model, df: DataFrame, keep: list[str] | None = None, col: str = "features"
) -> DataFrame:
    """``label, prediction`` (and ``keep``) of a fitted model on held-out rows."""
    if isinstance(model, (SoftmaxHead, TrainedNetwork)):
        scored = model.transform(df, col)
    else:
        ready = df
        if col in df.columns and "_vector" not in df.columns:
            ready = df.withColumn("_vector", array_to_vector(F.col(col)))
        scored = model.transform(ready)
    return scored.select(*(keep or []), "label", F.col("prediction").cast("int"))
