"""Training classifiers on feature columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.operators.text import fit_tfidf
from postweave.schema import HISTORY

# --- fixed values: Adam defaults ----------------------------------------------
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
# ------------------------------------------------------------------------------


def _with_vector(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(col)))


def _softmax_regression(
    features: str, label: str, weight: str | None, max_iter: int, reg: float
) -> LogisticRegression:
    model = LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg
    )
    return model.setWeightCol(weight) if weight else model


def fit_linear_probe(
    train: DataFrame,
    col: str = "features",
    label: str = "label",
    weight: str | None = None,
    max_iter: int = 100,
    reg: float = 0.0,
) -> Transformer:
    """Softmax regression on frozen features; the input needs the vector column.

    Score with ``score_split``, which adds that column.
    """
    model = _softmax_regression("_vector", label, weight, max_iter, reg)
    return model.fit(_with_vector(train, col))


def fit_text_classifier(
    train: DataFrame,
    col: str = "tweet",
    label: str = "label",
    vocab_size: int = 20_000,
    max_iter: int = 100,
    reg: float = 0.01,
) -> PipelineModel:
    """Text-only classifier: tokens, counts, inverse document frequency, softmax regression.

    The texts are read twice: for terms and weights, and for the training vectors,
    which the regression then holds.
    """
    tfidf = fit_tfidf(train, vocab_size, col)
    model = _softmax_regression("_tfidf", label, None, max_iter, reg).fit(tfidf.transform(train))
    return PipelineModel(stages=[*tfidf.stages, model])


def fit_fused_classifier(
    train: DataFrame,
    image_col: str = "features",
    text_col: str = "text_features",
    label: str = "label",
    weight: str | None = None,
    max_iter: int = 100,
    reg: float = 0.01,
) -> Transformer:
    """Image features, then text features, concatenated into one linear layer."""
    model = _softmax_regression("_vector", label, weight, max_iter, reg)
    return model.fit(fused_inputs(train, image_col, text_col))


def fused_inputs(df: DataFrame, image_col: str = "features", text_col: str = "text_features"):
    """Add the vector column that the fused classifier reads."""
    return df.withColumn("_vector", array_to_vector(F.concat(image_col, text_col)))


@dataclass
class SoftmaxHead:
    """A linear layer with softmax: ``weights`` is classes x inputs."""

    weights: np.ndarray
    bias: np.ndarray
    history: list[tuple] = field(default_factory=list)
    best_epoch: int | None = None
    stop_reason: str = "epoch_limit"

    def transform(self, df: DataFrame, col: str = "features") -> DataFrame:
        """Add ``logits`` and ``prediction``."""
        scored = df.withColumn("logits", PF.project(F.col(col), self.weights, self.bias))
        return scored.withColumn("prediction", PF.argmax(F.col("logits")))

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``class, weights, bias``, one row per class."""
        rows = [
            (k, w.tolist(), float(b)) for k, (w, b) in enumerate(zip(self.weights, self.bias))
        ]
        return spark.createDataFrame(rows, "class int, weights array<double>, bias double")

    @classmethod
    def from_table(cls, table: DataFrame) -> SoftmaxHead:
        rows = table.orderBy("class").collect()  # one per class
        return cls(np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows]))


def _sums_per_task(weights: np.ndarray, bias: np.ndarray):
    """Arrow task body over ``x, y, is_train, weight``: a task's sums.

    One row per input, the bias as the last; two more rows carry loss, correct rows and
    weight of the train and of the other rows.
    """
    classes, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = np.zeros((width + 1, classes))
        totals = {s: np.zeros(3) for s in ("train", "valid")}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("float64")
            x = x.reshape(batch.num_rows, width)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            weight = batch.column(3).to_numpy(zero_copy_only=False)
            logits = x @ weights.T + bias
            top = logits.max(axis=1, keepdims=True)
            power = np.exp(logits - top)
            mass = power.sum(axis=1, keepdims=True)
            rows = np.arange(len(y))
            loss = ((top + np.log(mass)).ravel() - logits[rows, y]) * weight
            hit = (logits.argmax(axis=1) == y) * weight
            error = power / mass
            error[rows, y] -= 1.0
            error *= weight[:, None]
            gradient[:width] += x[train].T @ error[train]
            gradient[width] += error[train].sum(axis=0)
            for name, part in (("train", train), ("valid", ~train)):
                totals[name] += [loss[part].sum(), hit[part].sum(), weight[part].sum()]
        if sum(t[2] for t in totals.values()) == 0:
            return
        table = np.vstack([gradient, np.zeros((2, classes))])
        side = np.zeros((width + 3, 3))
        side[width + 1], side[width + 2] = totals["train"], totals["valid"]
        arrays = [pa.array(np.arange(width + 3, dtype="int64"))]
        arrays += [pa.array(table[:, k]) for k in range(classes)]
        arrays += [pa.array(side[:, k]) for k in range(3)]
        names = ["pos", *[f"g{k}" for k in range(classes)], "loss", "correct", "n"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _training_rows(data: DataFrame, classes: int, col: str, label: str, is_train, weight) -> DataFrame:
    """``x, y, is_train, weight`` of the rows with a vector and a label of the classes."""
    known = F.col(label).between(0, classes - 1) & F.col(col).isNotNull()
    return data.filter(known).select(
        F.col(col).alias("x"),
        F.col(label).cast("int").alias("y"),
        is_train.alias("is_train"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"),
    )


def _summed(data: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """The sums of all tasks: ``inputs + 3`` rows."""
    sums = [f"g{k}" for k in range(len(weights))] + ["loss", "correct", "n"]
    schema = "pos bigint, " + ", ".join(f"{s} double" for s in sums)
    partial = data.mapInArrow(_sums_per_task(weights, bias), schema)
    return partial.groupBy("pos").agg(*[F.sum(s).alias(s) for s in sums])


def softmax_gradient(
    df: DataFrame,
    weights,
    bias=None,
    col: str = "features",
    label: str = "label",
    weight: str | None = None,
) -> DataFrame:
    """``pos`` and per class ``g0..``: the data pass of one full-batch step.

    Entries are means of ``(p - y) * x``, weighted if ``weight`` is given; position -1 is
    the bias, and its row also has the mean loss. A task sends one row per position. Rows
    without a vector or a label of the classes are left out.
    """
    matrix = np.asarray(weights, dtype="float64")
    classes, width = matrix.shape
    shift = np.zeros(classes) if bias is None else np.asarray(bias, dtype="float64")
    sums = _summed(_training_rows(df, classes, col, label, F.lit(True), weight), matrix, shift)
    everywhere = Window.partitionBy(F.lit(0))  # ``inputs + 3`` rows
    totals = F.col("pos") == width + 1
    with_totals = sums.withColumns(
        {
            "_n": F.max(F.when(totals, F.col("n"))).over(everywhere),
            "_loss": F.max(F.when(totals, F.col("loss"))).over(everywhere),
        }
    )
    is_bias = F.col("pos") == width
    return with_totals.filter(F.col("pos") <= width).select(
        F.when(is_bias, F.lit(-1)).otherwise(F.col("pos").cast("int")).alias("pos"),
        *[(F.col(f"g{k}") / F.col("_n")).alias(f"g{k}") for k in range(classes)],
        F.when(is_bias, F.col("_loss") / F.col("_n")).alias("loss"),
    )


def _data_pass(data: DataFrame, weights: np.ndarray, bias: np.ndarray):
    """One job over train and valid rows; only ``inputs + 3`` sum rows reach the driver."""
    classes, width = weights.shape
    sums = [f"g{k}" for k in range(classes)] + ["loss", "correct", "n"]
    rows = _summed(data, weights, bias).collect()
    if not rows:
        raise ValueError("no rows with a vector and a label of the classes")
    table = np.array([[r[s] for s in sums] for r in sorted(rows, key=lambda r: r["pos"])])
    gradient = table[: width + 1, :classes]
    return gradient, table[width + 1, classes:], table[width + 2, classes:]


def train_epochs(
    data: DataFrame,
    classes: int,
    width: int,
    col: str = "features",
    label: str = "label",
    split_col: str = "split",
    model: str = "model",
    epochs: int = 30,
    lr: float = 1e-3,
    patience: int | None = 3,
    threshold: float | None = 0.99,
) -> SoftmaxHead:
    """Full-batch Adam on a softmax layer, with validation, checkpoint and stop rules.

    Each epoch: gradient step on the train rows, then loss and accuracy of both
    splits. Train values are those before the step, valid values those after it. An
    accuracy above ``threshold`` on train stops without saving; a valid loss strictly
    below all earlier ones saves; otherwise ``patience`` epochs without one stop.
    The returned layer holds the saved weights (the last ones if none was saved).

    One pass gives the valid values of an epoch and the gradient of the next, so
    there is one job per epoch. Rows of other splits, such as test, and rows without a vector or a label of the classes are left
    out; without any train row there is nothing to fit, and that is an error.
    """
    is_train = F.col(split_col) == F.lit("train")
    seen = data.filter(F.col(split_col).isin("train", "valid"))
    rows = _training_rows(seen, classes, col, label, is_train, None)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _epoch_loop(rows, classes, width, model, epochs, lr, patience, threshold)
    finally:
        rows.unpersist()


def _epoch_loop(rows, classes, width, model, epochs, lr, patience, threshold) -> SoftmaxHead:
    params = np.zeros((width + 1, classes))
    moment, square = np.zeros_like(params), np.zeros_like(params)
    head = SoftmaxHead(params[:width].T, params[width])
    best_loss, waited = float("inf"), 0
    gradient, train, _ = _data_pass(rows, params[:width].T, params[width])
    if not train[2]:
        raise ValueError("no train rows with a vector and a label of the classes")
    for epoch in range(1, epochs + 1):
        step = gradient / train[2]
        moment = BETA_1 * moment + (1 - BETA_1) * step
        square = BETA_2 * square + (1 - BETA_2) * step**2
        scaled = (moment / (1 - BETA_1**epoch)) / (
            np.sqrt(square / (1 - BETA_2**epoch)) + EPSILON
        )
        params = params - lr * scaled
        before = train
        gradient, train, valid = _data_pass(rows, params[:width].T, params[width])
        n_valid = valid[2] or float("nan")
        values = [before[0] / before[2], before[1] / before[2], valid[0] / n_valid, valid[1] / n_valid]
        head.history.append((model, epoch, *[float(v) for v in values]))
        if head.best_epoch is None:
            head.weights, head.bias = params[:width].T, params[width]
        if threshold is not None and values[1] > threshold:
            head.stop_reason = "threshold"
            break
        if values[2] < best_loss:
            best_loss, waited = values[2], 0
            head.weights, head.bias, head.best_epoch = params[:width].T, params[width], epoch
            continue
        waited += 1
        if patience is not None and waited >= patience:
            head.stop_reason = "patience"
            break
    return head
