"""Registered queries of the trained networks, of the order of an epoch, and of runs that go on."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.permute import permutation
from postweave.operators import attention, evaluate, networks, ordering, text, train
from postweave.operators import history as epochs
from postweave.operators import score
from postweave.plans import tables as T
from postweave.plans.catalog import _ALIGNED, _EPOCHS, _FUSED_INPUTS, _RATE, _SEEN, _SERIES, _VECTOR_INPUTS, _r, _zeros, BATCH, VECTORS, query
from postweave.plans.network_sql import batch_attention_sql, cross_attention_sql, hidden_sql, order_sql, sides_sql
from postweave.plans.training_sql import head_sql, report_sql
from postweave.session import scratch_path

HIDDEN, DROPOUT, ATTENTION = 512, 0.2, 8
_ROUNDS = 3


def _past(model, spark) -> DataFrame:
    return model.history_table(spark).select("epoch", *[_r(c, c) for c in epochs.SERIES])


def _rows_by(inputs: int, outputs: int, turn: int) -> np.ndarray:
    """Fixed first weights: sines of turn * output + input, over the root of the inputs."""
    return np.sin(np.arange(inputs)[:, None] + turn * np.arange(outputs)[None, :]) / np.sqrt(inputs)


# --- hidden layer ---------------------------------------------------------------------


@query(
    f"""{VECTORS}, {hidden_sql(_VECTOR_INPUTS, 64, HIDDEN, 10, _ROUNDS, 0.01, DROPOUT, T.SEED,
                               'sin(pos + 31 * j) / sqrt(64.0)', f'sin(j + 17 * k) / sqrt({HIDDEN}.0)')}
    SELECT epoch, {_SERIES} FROM run"""
)
def fit_mlp_head(spark, folder):
    """A hidden layer of 512 units with ReLU and dropout."""
    first = {"inner": _rows_by(64, HIDDEN, 31), "inner_bias": np.zeros(HIDDEN), "out": _rows_by(HIDDEN, 10, 17), "out_bias": np.zeros(10)}
    fitted = networks.fit_mlp_head(
        T.split_vectors(spark, folder), 10, 64, hidden=HIDDEN, dropout=DROPOUT, id_col="vec_id", seed=T.SEED,
        epochs=_ROUNDS, lr=0.01, initial=first, patience=None, threshold=None)
    return _past(fitted, spark)


# --- sparse text ------------------------------------------------------------------------


def _pairs(spark, folder):
    """Cleaned posts with images and their sparse text, whose weights are fitted on the train split."""
    pairs = T.split_pairs(spark, folder)
    fitted = T.text_model(pairs.filter("split = 'train'"))
    keep = ["post_id", "label", "features", "split"]
    return text.tfidf_terms(pairs, fitted, keep=keep), text.tfidf_width(fitted)


@query(f"{_ALIGNED}, {head_sql(_FUSED_INPUTS, 6, _EPOCHS, _RATE)} SELECT epoch, {_SERIES} FROM run")
def train_sparse_epochs(spark, folder):
    """Dense image and sparse text entries into one layer."""
    rows, width = _pairs(spark, folder)
    return _past(networks.fit_network(networks.Head(6, dense=64, sparse=width), rows, epochs=_EPOCHS, lr=_RATE), spark)


@query(_zeros(6))
def fit_text_classifier(spark, folder):
    """At the fitted weights the gradient of the penalised loss is zero."""
    rows = T.split_posts(spark, folder).select("label", "tweet", "split").filter("split = 'train'")
    fitted = train.fit_text_classifier(rows)
    *stages, head = fitted.stages
    terms = text.tfidf_terms(rows, PipelineModel(stages=stages)).select("label", "text_terms")
    return _sparse_residual(terms, head.coefficientMatrix.toArray(), head.interceptVector.toArray(), 0.01)


def _sparse_residual(rows: DataFrame, matrix: np.ndarray, bias: np.ndarray, reg: float) -> DataFrame:
    """Per class the largest entry of the gradient of the penalised loss; only terms that occur are read.

    The penalty acts on standardised inputs, so it counts by the variance of each term."""
    spark, (classes, width) = rows.sparkSession, matrix.shape
    network = networks.Head(classes, sparse=width)
    slim = network.rows(rows, "label", F.lit(True), F.lit(1.0))
    gradient, totals = network.data_pass(slim, {"out": matrix.T.copy(), "out_bias": bias}, 1)
    n = totals[2]
    entries = slim.select(F.explode(F.arrays_zip(F.col("terms.terms").alias("t"), F.col("terms.values").alias("v"))).alias("e"))
    sums = entries.groupBy(F.col("e.t").alias("pos")).agg(
        F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    layer = spark.createDataFrame(
        [(p, (gradient["out"][p] / n).tolist(), matrix[:, p].tolist()) for p in range(width)], "pos int, g array<double>, w array<double>")
    offsets = spark.createDataFrame([(-1, (gradient["out_bias"] / n).tolist(), [0.0] * classes)], layer.schema)
    joined = layer.unionByName(offsets).join(sums.select("pos", variance.alias("variance")), "pos", "left")
    whole = F.zip_with("g", "w", lambda g, w: F.abs(g + w * reg * F.coalesce("variance", F.lit(0.0))))
    entries = joined.select(F.posexplode(whole).alias("class", "m")).groupBy("class").agg(F.max("m").alias("m"))
    # One digit: 100 steps of the fit leave gradients of about 0.01.
    return entries.select("class", (F.round("m", 1) + F.lit(0.0)).alias("residual"))


_TEXT_INPUTS = f"SELECT p.post_id AS id, p.label, {_SEEN}, pos, x FROM text_entries JOIN pairs p USING (post_id)"
_IMAGE_INPUTS = f"SELECT post_id AS id, label, {_SEEN}, pos, x FROM image_entries"


def _modalities_sql() -> str:
    sides = {"image": _IMAGE_INPUTS, "text": _TEXT_INPUTS}
    heads = ", ".join(head_sql(inputs, 6, _EPOCHS, _RATE, f"{name}_") for name, inputs in sides.items())
    tops = " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS model, max(valid_acc) AS top FROM {n}_run" for i, n in enumerate(sides))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS model, label, prediction FROM {n}_scored WHERE is_train IS NULL" for n in sides)
    means = ", ".join(f"round(sum(support * {m}) / sum(support), 6) AS weighted_{m}" for m in ["precision", "recall", "f1"])
    return f"""{_ALIGNED}, {heads}, winner AS (SELECT model FROM ({tops}) ORDER BY top DESC, place LIMIT 1),
    held AS (SELECT label, prediction FROM ({rows}) SEMI JOIN winner USING (model)), {report_sql('held')}
    SELECT (SELECT model FROM winner) AS model, round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, {means} FROM rates"""


@query(_modalities_sql())
def best_of_modalities(spark, folder):
    """An image head and a text head on the same posts; the better one by valid accuracy scores the test split."""
    rows, width = _pairs(spark, folder)
    heads = {"image": networks.Head(6, dense=64), "text": networks.Head(6, sparse=width)}
    fitted = {n: networks.fit_network(h, rows, model=n, epochs=_EPOCHS, lr=_RATE) for n, h in heads.items()}
    gathered = epochs.union_histories({n: f.history_table(spark) for n, f in fitted.items()})
    best = epochs.select_model(gathered, list(heads)).first()["model"]
    metrics = evaluate.summary_metrics(score.score_split(fitted[best], rows.filter("split = 'test'")))
    names = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]
    return metrics.select(F.lit(best).alias("model"), *[_r(m, m) for m in names])


# --- the order of an epoch ----------------------------------------------------------------


_PLACES = " UNION ALL ".join(
    f"SELECT vec_id, {e} AS epoch, {order_sql(T.SEED, e, 'row_idx')} AS place FROM sized" for e in range(1, _ROUNDS + 1))


@query(
    f"""{VECTORS}, sized AS (SELECT vec_id, row_idx, {sides_sql('(SELECT count(*) FROM vectors)')} FROM vectors)
    SELECT vec_id, CAST(epoch AS INT) AS epoch, place, place // {BATCH} AS batch_id FROM ({_PLACES})"""
)
def epoch_order(spark, folder):
    """Place and batch of every vector in three epochs, from one stored index."""
    placed = ordering.dense_index(T.vectors(spark, folder).select("vec_id"), "vec_id", rows_per_range=250)
    size = placed.count()
    parts = [placed.select("vec_id", F.lit(e).alias("epoch"), permutation(size, T.SEED, e).column(F.col("row_idx")).alias("place"))
             for e in range(1, _ROUNDS + 1)]
    every = parts[0].union(parts[1]).union(parts[2])
    return ordering.assign_batches(every, BATCH, "place")


# --- attention ----------------------------------------------------------------------------


_SIDES = f"""SELECT 0 AS side, post_id AS id, CAST(label AS INT) AS label, split = 'train' AS is_train, idx, pos, x
      FROM image_entries JOIN placed USING (post_id) WHERE split <> 'test'
    UNION ALL SELECT 1, post_id, CAST(label AS INT), split = 'train', idx, pos, x FROM text_entries JOIN pairs USING (post_id)
      JOIN placed USING (post_id) WHERE split <> 'test'"""


@query(
    f"""{_ALIGNED}, placed AS (SELECT post_id, row_number() OVER (PARTITION BY split ORDER BY post_id) - 1 AS idx FROM pairs),
    {batch_attention_sql(_SIDES, 64, (64, T.TEXT_DIMS), ATTENTION, 6, _ROUNDS, 0.02, T.SEED, BATCH)}
    SELECT epoch, {_SERIES} FROM run"""
)
def train_batch_attention(spark, folder):
    """Attention over the batches of an order that is new in every epoch, all layers trained."""
    pairs = T.split_pairs(spark, folder).filter("split <> 'test'")
    model = T.text_model(pairs.filter("split = 'train'"))
    rows = text.tfidf_features(pairs, model)
    slim = rows.select("post_id", "split")
    parts = [ordering.dense_index(slim.filter(F.col("split") == s), "post_id") for s in ("train", "valid")]
    size = slim.filter("split = 'train'").count()
    network = attention.BatchAttention(6, (64, T.TEXT_DIMS), size, ATTENTION, BATCH, seed=T.SEED)
    j = np.arange(ATTENTION)
    places = np.arange(64 + T.TEXT_DIMS)
    first = {
        "out": np.sin(17 * np.arange(6)[None, :] + places[:, None]) / (64 + T.TEXT_DIMS), "out_bias": np.zeros(6),
        "w0": _rows_by(64, ATTENTION, 31), "c0": np.zeros(ATTENTION), "q0": np.cos(j),
        "w1": np.sin(np.arange(T.TEXT_DIMS)[:, None] + 1 + 31 * j[None, :]) / np.sqrt(T.TEXT_DIMS), "c1": np.zeros(ATTENTION), "q1": np.cos(j + 1),
    }
    indexed = rows.join(parts[0].unionByName(parts[1]).select("post_id", "row_idx"), "post_id")
    fitted = networks.fit_network(network, indexed, epochs=_ROUNDS, lr=0.02, initial=first, patience=None, threshold=None)
    return _past(fitted, spark)


@query(
    f"""{_ALIGNED}, {cross_attention_sql(
        f"SELECT post_id AS id, CAST(p.label AS INT) AS label, split = 'train' AS is_train, pos, x FROM text_entries JOIN pairs p USING (post_id) WHERE split <> 'test'",
        "SELECT vec_id // 2 AS id, vec_id AS img, CAST(unnest(range(len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x "
        "FROM embeddings WHERE vec_id // 2 IN (SELECT post_id FROM pairs WHERE split <> 'test')",
        T.TEXT_DIMS, 64, ATTENTION, 6, _ROUNDS, 0.02)}
    SELECT epoch, {_SERIES} FROM run"""
)
def train_cross_attention(spark, folder):
    """Texts that attend to two images or none, all layers trained."""
    pairs = T.split_pairs(spark, folder).filter("split <> 'test'")
    rows = text.tfidf_features(pairs, T.text_model(pairs.filter("split = 'train'"))).drop("features")
    images = T.vectors(spark, folder).select(F.floor(F.col("vec_id") / 2).cast("bigint").alias("post_id"), "features")
    network = attention.CrossAttention(6, images, T.TEXT_DIMS, 64, ATTENTION)
    first = {
        "q": _rows_by(T.TEXT_DIMS, ATTENTION, 31), "q_bias": np.zeros(ATTENTION), "k": _rows_by(64, ATTENTION, 37), "k_bias": np.zeros(ATTENTION),
        "v": _rows_by(64, T.TEXT_DIMS, 41), "v_bias": np.zeros(T.TEXT_DIMS), "out": _rows_by(T.TEXT_DIMS + 64, 6, 17), "out_bias": np.zeros(6),
    }
    fitted = networks.fit_network(network, rows, epochs=_ROUNDS, lr=0.02, initial=first, patience=None, threshold=None)
    return _past(fitted, spark)


# --- runs that go on ------------------------------------------------------------------------


@query(f"{VECTORS}, {head_sql(_VECTOR_INPUTS, 10, _EPOCHS, _RATE)} SELECT epoch, {_SERIES} FROM run")
def resume_training(spark, folder):
    """A run that ends after two epochs and is called again: its history is that of one run."""
    rows, path = T.split_vectors(spark, folder), scratch_path(spark, "journal")
    network = networks.Head(10, dense=64)
    networks.fit_network(network, rows, epochs=2, lr=_RATE, journal=path)
    return _past(networks.fit_network(network, rows, epochs=_EPOCHS, lr=_RATE, journal=path), spark)
