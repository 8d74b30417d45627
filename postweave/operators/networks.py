"""Networks on feature columns, trained by full-batch Adam with distributed gradients.

A network says what its parameters are and computes, in one data pass over the rows, the sums that an epoch
needs: the gradient over the train rows, and loss, correct rows and weight of the train and the other rows. Each
task reduces its Arrow batches to one vector of the size of the parameters; the vectors are summed in chunks
in a shuffle, and only the sum reaches the driver. ``fit_network`` is the epoch loop for all of them, with an
optional journal from which a run that was cut off goes on.

``Head``            dense and sparse inputs, perhaps a hidden layer with ReLU and dropout, softmax
``BatchAttention``  both modalities weighed over the samples of a batch by trained layers, softmax
``CrossAttention``  texts that attend to their images by trained layers, softmax (module ``attention``)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.functions.permute import mixed
from postweave.operators.train import BETA_1, BETA_2, EPSILON
from postweave.schema import HISTORY

Params = dict[str, np.ndarray]

#: Entries of a gradient that travel in one row.
CHUNK = 8192
#: Entries of an intermediate array in a task.
CELLS = 4_000_000
#: Loss, correct rows and weight, of the train and of the other rows.
TOTALS = 6


def flat_of(params: Params) -> np.ndarray:
    return np.concatenate([np.ravel(v) for v in params.values()])


def shaped_like(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for name, value in like.items():
        out[name] = flat[at : at + value.size].reshape(value.shape)
        at += value.size
    return out


def uniform_layer(inputs: int, outputs: int, seed: int) -> np.ndarray:
    """inputs x outputs weights, uniform within 1 / sqrt(inputs)."""
    bound = 1.0 / np.sqrt(max(inputs, 1))
    return np.random.default_rng(seed).uniform(-bound, bound, (inputs, outputs))


def chunk_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A vector in rows of ``chunk, part``."""
    for start in range(0, len(total), CHUNK):
        part = total[start : start + CHUNK]
        lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
        yield pa.RecordBatch.from_arrays([pa.array([start // CHUNK], pa.int32()), lists], names=["chunk", "part"])


def sum_chunks(parts: DataFrame) -> np.ndarray | None:
    """The sum of all tasks' vectors; the driver gets as many entries as one of them has."""
    sums = parts.select("chunk", array_to_vector("part").alias("part")).groupBy("chunk").agg(
        Summarizer.sum(F.col("part")).alias("part")
    )
    rows = sorted(sums.select("chunk", vector_to_array("part").alias("part")).collect())
    return np.concatenate([r["part"] for r in rows]) if rows else None


def sum_over_tasks(rows: DataFrame, body: Callable) -> np.ndarray | None:
    """Sum of the vectors that ``body`` gives for the batches of each task (None without rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = body(batches)
        if total is not None:
            yield from chunk_rows(total)

    return sum_chunks(rows.mapInArrow(run, "chunk int, part array<double>"))


# --- inputs of a task ---------------------------------------------------------------


def dense_of(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), width)


class Rows:
    """Some rows of a batch: a dense block, and sparse entries in compressed rows.

    The sparse side is never filled in: products gather the weight rows of the terms, and
    gradients are added to the rows of the terms that occur."""

    def __init__(self, dense: np.ndarray | None, offsets=None, terms=None, values=None, width: int = 0) -> None:
        self.dense, self.width = dense, 0 if dense is None else dense.shape[1]
        self.offsets, self.terms, self.values = offsets, terms, values
        if offsets is not None:
            self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.count = len(dense) if dense is not None else len(offsets) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.count, weights.shape[1]))
        if self.dense is not None:
            out += self.dense @ weights[: self.width]
        if self.offsets is not None and len(self.terms):
            filled = np.flatnonzero(np.diff(self.offsets))
            parts = weights[self.width + self.terms] * self.values[:, None]
            out[filled] += np.add.reduceat(parts, self.offsets[:-1][filled], axis=0)
        return out

    def add_gradient(self, delta: np.ndarray, total: np.ndarray) -> None:
        """total += inputs' . delta"""
        if self.dense is not None:
            total[: self.width] += self.dense.T @ delta
        if self.offsets is not None and len(self.terms):
            order = np.argsort(self.terms, kind="stable")
            terms, first = np.unique(self.terms[order], return_index=True)
            parts = delta[self.row[order]] * self.values[order, None]
            total[self.width + terms] += np.add.reduceat(parts, first, axis=0)


def split_rows(dense: pa.Array | None, sparse: pa.Array | None, width: int, cells: int) -> Iterator[tuple[slice, Rows]]:
    """The rows of a batch in slices whose products with ``cells`` columns stay small."""
    count = len(dense) if dense is not None else len(sparse)
    block = None if dense is None else dense_of(dense, width)
    offsets = np.arange(count + 1) * 0
    if sparse is not None:
        terms, values = sparse.field("terms"), sparse.field("values")
        offsets = terms.offsets.to_numpy().astype("int64")
        flat_terms = terms.values.to_numpy(zero_copy_only=False)
        flat_values = values.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < count:
        most = max(1, CELLS // max(cells, 1))
        stop = min(count, start + most, max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1))
        if sparse is None:
            part = Rows(block[start:stop])
        else:
            a, b = offsets[start], offsets[stop]
            part = Rows(None if block is None else block[start:stop], offsets[start : stop + 1] - a,
                        flat_terms[a:b], flat_values[a:b])
        yield slice(start, stop), part
        start = stop


def softmax_errors(logits: np.ndarray, y: np.ndarray, train: np.ndarray, weight: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Weighted ``p - y`` of the train rows (0 for others); adds loss, hits and weight to the totals."""
    top = logits.max(axis=1, keepdims=True)
    power = np.exp(logits - top)
    mass = power.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = ((top + np.log(mass)).ravel() - logits[at, y]) * weight
    hit = (logits.argmax(axis=1) == y) * weight
    for place, part in ((0, train), (3, ~train)):
        totals[place : place + 3] += [loss[part].sum(), hit[part].sum(), weight[part].sum()]
    error = power / mass
    error[at, y] -= 1.0
    return error * (weight * train)[:, None]


# --- dropout ------------------------------------------------------------------------

def kept_units(ids: np.ndarray, units: int, epoch: int, seed: int, dropout: float) -> np.ndarray:
    """Which units of each row stay in an epoch; the same for any partitioning of the rows."""
    row = mixed(mixed(ids.astype("int64")) + mixed(np.int64(seed * 1000 + epoch)))
    return mixed(row[:, None] + np.arange(units) * 40503) >= dropout * 2.0**32


# --- a head -------------------------------------------------------------------------


@dataclass(frozen=True)
class Head:
    """Softmax over dense inputs, sparse inputs or both; with ``hidden`` units there is a layer
    with ReLU between, of which ``dropout`` is left out at random while it trains.

    Dense inputs are an array column of width ``dense``, sparse ones a struct of ``terms`` and ``values``
    with terms below ``sparse`` (see ``text.tfidf_terms``). In the weights the dense inputs come first."""

    classes: int
    dense: int = 0
    sparse: int = 0
    hidden: int | None = None
    dropout: float = 0.0
    dense_col: str = "features"
    sparse_col: str = "text_terms"
    id_col: str = "post_id"
    seed: int = 50

    def initial(self) -> Params:
        """Zeros for a single layer; two layers start uniform."""
        inputs = self.dense + self.sparse
        if self.hidden is None:
            return {"out": np.zeros((inputs, self.classes)), "out_bias": np.zeros(self.classes)}
        return {
            "inner": uniform_layer(inputs, self.hidden, self.seed),
            "inner_bias": uniform_layer(inputs, self.hidden, self.seed + 1)[0],
            "out": uniform_layer(self.hidden, self.classes, self.seed + 2),
            "out_bias": uniform_layer(self.hidden, self.classes, self.seed + 3)[0],
        }

    def columns(self) -> list[Column]:
        """The input columns that are there, as ``x`` and ``terms``."""
        return [*([F.col(self.dense_col).alias("x")] if self.dense else []),
                *([F.col(self.sparse_col).alias("terms")] if self.sparse else [])]

    def rows(self, data: DataFrame, label: str, is_train: Column, weight: Column) -> DataFrame:
        """The rows with inputs and a label of the classes, slim."""
        known = F.col(label).between(0, self.classes - 1)
        for used, name in ((self.dense, self.dense_col), (self.sparse, self.sparse_col)):
            known = known & F.col(name).isNotNull() if used else known
        row_id = F.col(self.id_col).cast("long") if self.dropout else F.lit(0).cast("long")
        return data.filter(known).select(
            F.col(label).cast("int").alias("y"), is_train.alias("is_train"), weight.cast("double").alias("weight"),
            F.coalesce(row_id, F.lit(0)).alias("id"), *self.columns(),
        )

    def _inputs(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, Rows]]:
        names = batch.schema.names
        dense = batch.column(names.index("x")) if self.dense else None
        sparse = batch.column(names.index("terms")) if self.sparse else None
        return split_rows(dense, sparse, self.dense, max(self.hidden or 0, self.classes))

    def data_pass(self, rows: DataFrame, params: Params, epoch: int) -> tuple[Params, np.ndarray]:
        """Gradient sums and totals, in one job."""
        network = self

        def body(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            totals, seen = np.zeros(TOTALS), False
            for batch in batches:
                seen = seen or batch.num_rows > 0
                y, train, weight, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
                for part, inputs in network._inputs(batch) if batch.num_rows else ():
                    network._add(params, grad, totals, inputs, y[part], train[part].astype(bool), weight[part], ids[part], epoch)
            return np.concatenate([flat_of(grad), totals]) if seen else None

        total = sum_over_tasks(rows, body)
        if total is None:
            raise ValueError("no rows with inputs and a label of the classes")
        return shaped_like(total[:-TOTALS], params), total[-TOTALS:]

    def _add(self, params, grad, totals, inputs, y, train, weight, ids, epoch) -> None:
        if self.hidden is None:
            act = None
            logits = inputs.times(params["out"]) + params["out_bias"]
        else:
            before = inputs.times(params["inner"]) + params["inner_bias"]
            act = np.maximum(before, 0.0)
            if self.dropout:
                keep = kept_units(ids, self.hidden, epoch, self.seed, self.dropout)
                scale = np.where(train[:, None], keep / (1.0 - self.dropout), 1.0)
                act *= scale
            logits = act @ params["out"] + params["out_bias"]
        error = softmax_errors(logits, y, train, weight, totals)
        grad["out_bias"] += error.sum(axis=0)
        if act is None:
            inputs.add_gradient(error, grad["out"])
            return
        grad["out"] += act.T @ error
        delta = (error @ params["out"].T) * (before > 0)
        if self.dropout:
            delta *= scale
        grad["inner_bias"] += delta.sum(axis=0)
        inputs.add_gradient(delta, grad["inner"])

    def logits(self, params: Params) -> Column:
        """Logits of a row, computed in Arrow batches; NULL for a row without inputs."""
        network, names = self, [c for c, used in ((self.dense_col, self.dense), (self.sparse_col, self.sparse)) if used]

        @F.arrow_udf("array<double>")
        def score(*columns: pa.Array) -> pa.Array:
            there = columns[0].is_valid()
            for c in columns[1:]:
                there = pa.compute.and_(there, c.is_valid())
            known = there.to_numpy(zero_copy_only=False)
            taken = [c.filter(there) for c in columns]
            dense = taken[0] if network.dense else None
            sparse = taken[-1] if network.sparse else None
            found = np.zeros((int(known.sum()), network.classes))
            for part, inputs in split_rows(dense, sparse, network.dense, max(network.hidden or 0, network.classes)) if len(found) else ():
                if network.hidden is None:
                    found[part] = inputs.times(params["out"]) + params["out_bias"]
                else:
                    act = np.maximum(inputs.times(params["inner"]) + params["inner_bias"], 0.0)
                    found[part] = act @ params["out"] + params["out_bias"]
            ends = np.arange(0, found.size + 1, network.classes, dtype="int32")
            rows = pa.ListArray.from_arrays(ends, found.ravel())
            return rows.take(pa.array(np.maximum(np.cumsum(known) - 1, 0), mask=~known))

        return score(*[F.col(c) for c in names])

    def transform(self, df: DataFrame, params: Params) -> DataFrame:
        scored = df.withColumn("logits", self.logits(params))
        return scored.withColumn("prediction", PF.argmax(F.col("logits")))


# --- the epoch loop -------------------------------------------------------------------


@dataclass
class TrainedNetwork:
    """A network with the saved parameters and the history of its run."""

    network: object
    params: Params
    history: list[tuple] = field(default_factory=list)
    best_epoch: int | None = None
    stop_reason: str = "epoch_limit"

    def transform(self, df: DataFrame, col: str | None = None) -> DataFrame:
        """Add ``logits`` and ``prediction``; the network knows its input columns."""
        return self.network.transform(df, self.params)

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``name, shape, entries``, one row per layer; read back with ``params_of``."""
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in self.params.items()]
        return spark.createDataFrame(rows, "name string, shape array<int>, entries array<double>")


def params_of(table: DataFrame) -> Params:
    """The parameters that ``to_table`` stored."""
    return {r["name"]: np.array(r["entries"]).reshape(r["shape"]) for r in table.collect()}  # one row per layer


_STATE = ["params", "moment", "square", "gradient", "best"]
_JOURNAL = (", ".join(f"{s} array<double>" for s in _STATE) + ", totals array<double>, best_loss double, waited int, "
            "best_epoch int, stopped string, history array<struct<epoch: int, values: array<double>>>, epoch int")


class Journal:
    """What an epoch left behind, one committed folder per epoch under a shared path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def last(self) -> dict | None:
        """The state after the last epoch that was written whole."""
        try:
            found = self.spark.read.schema(_JOURNAL).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = found.filter(F.col("epoch") == found.agg(F.max("epoch")).first()[0]).first()  # one row per epoch
        return row.asDict(recursive=True) if row else None

    def write(self, epoch: int, state: dict) -> None:
        """The file appears under its name when the job commits, so a torn epoch is not seen."""
        row = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in state.items()} | {"epoch": epoch}
        one = self.spark.createDataFrame([row], _JOURNAL).coalesce(1)
        one.write.mode("append").partitionBy("epoch").parquet(self.path)


def fit_network(
    network,
    data: DataFrame,
    label: str = "label",
    split_col: str = "split",
    model: str = "model",
    epochs: int = 30,
    lr: float = 1e-3,
    patience: int | None = 3,
    threshold: float | None = 0.99,
    weight: str | None = None,
    weight_decay: float = 0.0,
    initial: Params | None = None,
    journal: str | None = None,
) -> TrainedNetwork:
    """Full-batch Adam with validation, checkpoint and stop rules, as ``train.train_epochs``.

    ``weight_decay`` shrinks the parameters apart from the gradient (AdamW). With ``journal``, a path that all executors
    share, every epoch is written there, and a call with the same arguments goes on after the
    last one: the result is that of an unbroken run. Rows without inputs or a label of the classes, and
    rows of other splits, are left out; without train rows there is an error.
    """
    is_train = F.col(split_col) == F.lit("train")
    seen = data.filter(F.col(split_col).isin("train", "valid"))
    rows = network.rows(seen, label, is_train, F.lit(1.0) if weight is None else F.col(weight))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    book = Journal(data.sparkSession, journal) if journal else None
    try:
        return _run_epochs(network, rows, model, epochs, lr, patience, threshold, weight_decay, initial, book)
    finally:
        rows.unpersist()


def _run_epochs(network, rows, model, epochs, lr, patience, threshold, decay, initial, book) -> TrainedNetwork:
    like = network.initial() if initial is None else initial
    s = book.last() if book else None
    if s is None:
        gradient, totals = network.data_pass(rows, like, 1)
        if not totals[2]:
            raise ValueError("no train rows with inputs and a label of the classes")
        start = flat_of(like).astype("float64")
        s = {"params": start, "moment": np.zeros_like(start), "square": np.zeros_like(start), "gradient": flat_of(gradient),
             "best": start, "totals": totals, "best_loss": float("inf"), "waited": 0, "best_epoch": None, "stopped": None,
             "history": [], "epoch": 0}
    s = {k: np.asarray(v) if k in (*_STATE, "totals") else v for k, v in s.items()}
    for epoch in range(s["epoch"] + 1, epochs + 1):
        if s["stopped"]:
            break
        before = s["totals"]
        step = s["gradient"] / before[2]
        s["moment"] = BETA_1 * s["moment"] + (1 - BETA_1) * step
        s["square"] = BETA_2 * s["square"] + (1 - BETA_2) * step**2
        scaled = (s["moment"] / (1 - BETA_1**epoch)) / (np.sqrt(s["square"] / (1 - BETA_2**epoch)) + EPSILON)
        s["params"] = s["params"] * (1 - lr * decay) - lr * scaled
        gradient, s["totals"] = network.data_pass(rows, shaped_like(s["params"], like), epoch + 1)
        s["gradient"] = flat_of(gradient)
        n_valid = s["totals"][5] or float("nan")
        values = [before[0] / before[2], before[1] / before[2], s["totals"][3] / n_valid, s["totals"][4] / n_valid]
        s["history"] = [*s["history"], {"epoch": epoch, "values": [float(v) for v in values]}]
        if s["best_epoch"] is None:
            s["best"] = s["params"]
        if threshold is not None and values[1] > threshold:
            s["stopped"] = "threshold"
        elif values[2] < s["best_loss"]:
            s["best_loss"], s["waited"], s["best"], s["best_epoch"] = float(values[2]), 0, s["params"], epoch
        else:
            s["waited"] += 1
            if patience is not None and s["waited"] >= patience:
                s["stopped"] = "patience"
        if book:
            book.write(epoch, {k: v for k, v in s.items() if k != "epoch"})
    past = [(model, h["epoch"], *h["values"]) for h in s["history"] if h["epoch"] <= epochs]
    return TrainedNetwork(network, shaped_like(s["best"], like), past, s["best_epoch"], s["stopped"] or "epoch_limit")


def fit_mlp_head(
    data: DataFrame,
    classes: int,
    width: int,
    col: str = "features",
    hidden: int = 512,
    dropout: float = 0.2,
    id_col: str = "post_id",
    seed: int = 50,
    **options,
) -> TrainedNetwork:
    """Feature to hidden layer, ReLU and dropout, to classes. Options of ``fit_network``."""
    network = Head(classes, dense=width, hidden=hidden, dropout=dropout, dense_col=col, id_col=id_col, seed=seed)
    return fit_network(network, data, **options)
