"""Saving and loading fitted classifiers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import SparkSession

from postweave.operators.networks import TrainedNetwork, params_of
from postweave.operators.train import SoftmaxHead


def save_checkpoint(spark: SparkSession, model: Model | SoftmaxHead | TrainedNetwork, path: str) -> None:
    """Store a fitted classifier, replacing an earlier one at the same path."""
    if isinstance(model, (SoftmaxHead, TrainedNetwork)):
        model.to_table(spark).write.mode("overwrite").parquet(path)
        return
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    wrapped.write().overwrite().save(path)


def load_checkpoint(spark: SparkSession, path: str, kind="pipeline"):
    """Load what ``save_checkpoint`` stored: ``kind`` is ``pipeline``, ``head``, or a network, which then
    has the stored parameters."""
    if not isinstance(kind, str):
        return TrainedNetwork(kind, params_of(spark.read.parquet(path)))
    if kind == "head":
        return SoftmaxHead.from_table(spark.read.parquet(path))
    if kind != "pipeline":
        raise ValueError("kind must be 'pipeline', 'head' or a network")
    return PipelineModel.load(path)
