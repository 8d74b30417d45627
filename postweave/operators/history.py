"""Epoch histories: checkpoint rule, early stopping, model selection, curves.

A history has one row per model and epoch; a model has few epochs, so its window is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["train_acc", "valid_acc", "train_loss", "valid_loss"]


def union_histories(histories: dict[str, DataFrame]) -> DataFrame:
    """Histories of several models in one table, each under its name."""
    named = [df.withColumn("model", F.lit(name)) for name, df in histories.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def best_so_far(history: DataFrame) -> DataFrame:
    """Add the lowest valid loss up to the epoch and whether this epoch improved it.

    Improved means strictly below every earlier value; the first epoch improves on
    infinity. A missing or NaN loss does not improve.
    """
    earlier = (
        Window.partitionBy("model").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.min("valid_loss").over(earlier), F.lit(float("inf")))
    improved = F.coalesce(F.col("valid_loss") < before, F.lit(False))
    up_to_now = (
        Window.partitionBy("model").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    )
    return history.withColumns(
        {"best_loss": F.min("valid_loss").over(up_to_now), "improved": improved}
    )


def patience_counter(history: DataFrame) -> DataFrame:
    """Add the number of epochs since the last improvement.

    Epochs form islands, each starting at an improvement; before the first one
    every epoch counts.
    """
    in_order = Window.partitionBy("model").orderBy("epoch")
    island = F.sum(F.col("improved").cast("int")).over(
        in_order.rowsBetween(Window.unboundedPreceding, 0)
    )
    rank = F.row_number().over(Window.partitionBy("model", "_island").orderBy("epoch"))
    counter = F.when(F.col("_island") == 0, rank).otherwise(rank - 1)
    return (
        best_so_far(history)
        .withColumn("_island", island)
        .withColumn("counter", counter.cast("bigint"))
        .drop("_island")
    )


def _marked(history: DataFrame, patience: int | None, threshold: float | None) -> DataFrame:
    """Counted history with the stop cause of each epoch; the threshold is tested first."""
    over = F.lit(False) if threshold is None else F.col("train_acc") > threshold
    tired = F.lit(False) if patience is None else F.col("counter") >= patience
    cause = F.when(over, F.lit("threshold")).when(tired, F.lit("patience"))
    return patience_counter(history).withColumn("cause", cause)


def early_stop(
    history: DataFrame, patience: int | None = 3, threshold: float | None = 0.99
) -> DataFrame:
    """``model, stop_epoch, reason, best_epoch, best_loss``.

    ``best_epoch`` is the last saved one up to the stop. An epoch that stops by
    threshold is not saved, even if its loss improved; it is NULL if none was.
    """
    by_model = Window.partitionBy("model")
    stop = F.coalesce(
        F.min(F.when(F.col("cause").isNotNull(), F.col("epoch"))).over(by_model),
        F.max("epoch").over(by_model),
    )
    run = (
        _marked(history, patience, threshold)
        .withColumn("stop_epoch", stop)
        .filter(F.col("epoch") <= F.col("stop_epoch"))
    )
    saved = F.col("improved") & ~F.coalesce(F.col("cause") == "threshold", F.lit(False))
    return run.groupBy("model").agg(
        F.max("epoch").alias("stop_epoch"),
        F.coalesce(F.max("cause"), F.lit("epoch_limit")).alias("reason"),
        F.max(F.when(saved, F.col("epoch"))).alias("best_epoch"),
        F.min(F.when(saved, F.col("valid_loss"))).alias("best_loss"),
    )


def cut_history(history: DataFrame, stops: DataFrame) -> DataFrame:
    """The epochs that ran: those up to each model's stop."""
    last = stops.select("model", "stop_epoch")
    return (
        history.join(last, "model").filter(F.col("epoch") <= F.col("stop_epoch")).drop("stop_epoch")
    )


def best_checkpoint_epoch(
    history: DataFrame, patience: int | None = 3, threshold: float | None = 0.99
) -> DataFrame:
    """``model, best_epoch``: lowest valid loss before the stop, first on ties."""
    return early_stop(history, patience, threshold).select("model", "best_epoch")


def select_model(history: DataFrame, models: Sequence[str]) -> DataFrame:
    """The model with the highest valid accuracy, the first listed on ties."""
    position = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    return (
        history.groupBy("model")
        .agg(F.max("valid_acc").alias("best_valid_acc"))
        .filter(position > 0)
        .orderBy(F.desc("best_valid_acc"), position)
        .limit(1)
    )


def winner_history(history: DataFrame, models: Sequence[str]) -> DataFrame:
    """All epochs of the selected model; its name is looked up first."""
    best = select_model(history, models).first()
    return history.limit(0) if best is None else history.filter(F.col("model") == best["model"])


def trim_history(history: DataFrame, drop_last: int = 0) -> DataFrame:
    """Each model's history without its last ``drop_last`` epochs."""
    newest_first = Window.partitionBy("model").orderBy(F.desc("epoch"))
    return (
        history.withColumn("_age", F.row_number().over(newest_first))
        .filter(F.col("_age") > drop_last)
        .drop("_age")
    )


def learning_curves(history: DataFrame) -> DataFrame:
    """``model, epoch, series, value`` rows behind accuracy and loss charts."""
    return history.unpivot(["model", "epoch"], SERIES, "series", "value")
