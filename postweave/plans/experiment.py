"""Whole runs: from a manifest and image features to a scored, evaluated classifier.

    python -m postweave.plans.experiment --train train.csv --test test.csv \\
        --features features.parquet --fusion concat --out results
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators import attention, evaluate, fusion, history, networks, ordering, prepare, score, text
from postweave.operators import vectors as vec
from postweave.operators.train import SoftmaxHead, train_epochs
from postweave.schema import DISPLAY_NAMES, LABEL_CODES
from postweave.session import scratch_path, stored
from postweave.sources import LOAD_ORDER, read_manifest, save_checkpoint, write_tables

KINDS = ["concat", "basic_attention", "cross_attention"]

# --- fixed values: train rows, batch size, epoch limits, rates, patience ------------
TRAIN_ROWS = 4662
BATCH_SIZE = 12
EPOCH_LIMIT = {"concat": 30, "basic_attention": 30, "cross_attention": 20}
LEARNING_RATE = {"concat": 1e-4, "basic_attention": 1e-3, "cross_attention": 1e-4}
PATIENCE = 3
ACCURACY_LIMIT = 0.99
SEED = 50
# ------------------------------------------------------------------------------------


@dataclass
class Run:
    """A trained head with the rows it scores: ``split, label`` and the vector ``col``."""

    name: str
    head: SoftmaxHead | networks.TrainedNetwork
    rows: DataFrame
    col: str
    names: list[str] | None = None

    def scored(self, split: str) -> DataFrame:
        return score.score_split(self.head, self.rows.filter(F.col("split") == split), col=self.col)

    def report(self, split: str) -> DataFrame:
        return evaluate.classification_report(self.scored(split), self.names)

    def metrics(self, split: str) -> DataFrame:
        return evaluate.summary_metrics(self.scored(split))

    def tables(self, split: str) -> dict[str, DataFrame]:
        """Everything a run reports, as tables; predictions are written once and read back."""
        spark = self.rows.sparkSession
        past = self.head.history_table(spark)
        stored = write_tables({"scored": self.scored(split)}, scratch_path(spark, "run"))
        pairs = spark.read.parquet(stored["scored"])
        return {
            "history": past,
            "learning_curves": history.learning_curves(past),
            "predictions": pairs,
            "metrics": evaluate.summary_metrics(pairs),
            "report": evaluate.classification_report(pairs, self.names),
            "confusion_matrix": evaluate.confusion_matrix(pairs),
        }


def _layer(outputs: int, inputs: int) -> np.ndarray:
    """A fixed layer for the attention scores: the training here is of the last layer only."""
    rows, columns = np.arange(outputs)[:, None], np.arange(inputs)[None, :]
    return np.sin(31 * rows + columns) / np.sqrt(inputs)


def _in_batches(rows: DataFrame, id_col: str) -> DataFrame:
    """Batches of each split: train in shuffled order, the others in id order.

    Only ids are ordered; the rows with their vectors are joined to the batch numbers once."""
    slim, parts = rows.select(id_col, "split"), []
    for split in ["train", "valid", "test"]:
        part = slim.filter(F.col("split") == split)
        if split == "train":
            placed = ordering.seeded_shuffle(part, SEED, 1, id_col, "row_idx")
        else:
            placed = ordering.dense_index(part, id_col)
        numbered = ordering.assign_batches(placed, BATCH_SIZE)
        parts.append(numbered.select(id_col, F.concat_ws("-", F.lit(split), F.col("batch_id")).alias("batch_id")))
    return rows.join(reduce(lambda a, b: a.unionByName(b), parts), id_col)


def fuse(
    rows: DataFrame, kind: str, image_width: int, text_width: int, attention_width: int = 8
) -> DataFrame:
    """Add ``fused`` to rows with ``post_id, split, features, text_features``."""
    if kind == "concat":
        return fusion.fuse_concat(rows, "features", "text_features")
    if kind == "basic_attention":
        weighted = _in_batches(rows, "post_id")
        query = np.cos(np.arange(attention_width)).tolist()
        for col, width in [("features", image_width), ("text_features", text_width)]:
            layer = _layer(attention_width, width)
            weighted = fusion.batch_attention(
                weighted, layer, None, query, bounded=True, col=col, out=f"{col}_attended",
                weight=f"{col}_weight", batches=True,
            )
        return fusion.fuse_concat(weighted, "features_attended", "text_features_attended")
    if kind == "cross_attention":
        texts = rows.select("post_id", "text_features")
        images = rows.select("post_id", "features")
        attended = fusion.cross_attention(
            texts,
            images,
            "post_id",
            (_layer(attention_width, text_width), None),
            (_layer(attention_width, image_width), None),
            (_layer(text_width, image_width), None),
            batches=True,
        )
        return fusion.fuse_concat(rows.join(attended, "post_id"), "attended", "features")
    raise ValueError(f"kind must be one of {KINDS}")


def run_fusion(
    pairs: DataFrame,
    kind: str = "concat",
    epochs: int | None = None,
    lr: float | None = None,
    text_dims: int = 512,
) -> Run:
    """Train and score a fused classifier.

    ``pairs`` has ``post_id, label, tweet, features, split`` with splits train, valid
    and perhaps test. Text features are fitted on the train rows.
    """
    fitted = text.fit_tfidf(pairs.filter("split = 'train'"), text_dims)
    text_width = text.tfidf_width(fitted)
    first = pairs.select(F.size("features").alias("width")).first()
    if first is None:
        raise ValueError("no posts with image features")
    rows = text.tfidf_features(pairs, fitted, keep=[c for c in pairs.columns if c != "tweet"])
    fused = fuse(rows, kind, first["width"], text_width)
    if kind != "concat":
        # Training and scoring read the attended vectors, each of which depends on other rows.
        fused = stored(fused.select("post_id", "label", "split", "fused"), "fused", text.ROWS_PER_FILE)
    head = train_epochs(
        fused,
        len(LABEL_CODES),
        first["width"] + text_width,
        col="fused",
        model=kind,
        epochs=EPOCH_LIMIT[kind] if epochs is None else epochs,
        lr=LEARNING_RATE[kind] if lr is None else lr,
        patience=PATIENCE,
        threshold=ACCURACY_LIMIT,
    )
    return Run(kind, head, fused, "fused", DISPLAY_NAMES)


def _indexed(rows: DataFrame) -> DataFrame:
    """Add ``row_idx``, the position within the split by post id. Only ids are numbered; the vectors are joined to them."""
    slim = rows.select("post_id", "split")
    parts = [ordering.dense_index(slim.filter(F.col("split") == s), "post_id") for s in ["train", "valid", "test"]]
    placed = reduce(lambda a, b: a.unionByName(b), parts).select("post_id", "row_idx")
    return rows.join(placed, "post_id")


def run_trained(
    pairs: DataFrame,
    kind: str = "concat",
    epochs: int | None = None,
    lr: float | None = None,
    text_dims: int = 512,
    attention_width: int = 512,
    hidden: int | None = None,
    journal: str | None = None,
) -> Run:
    """Like ``run_fusion``, with every layer trained.

    ``concat`` reads the text as sparse terms, through ``hidden`` units if they are given. ``basic_attention`` has a new train
    order in every epoch. With ``journal`` a run that was cut off goes on from its last epoch.
    """
    fitted = text.fit_tfidf(pairs.filter("split = 'train'"), text_dims)
    text_width = text.tfidf_width(fitted)
    first = pairs.select(F.size("features").alias("width")).first()
    if first is None:
        raise ValueError("no posts with image features")
    classes, width = len(LABEL_CODES), first["width"]
    if kind == "concat":
        rows = text.tfidf_terms(pairs, fitted)
        dropout = 0.2 if hidden else 0.0
        network = networks.Head(classes, dense=width, sparse=text_width, hidden=hidden, dropout=dropout, seed=SEED)
    elif kind == "basic_attention":
        rows = _indexed(text.tfidf_features(pairs, fitted))
        size = pairs.filter("split = 'train'").count()
        network = attention.BatchAttention(classes, (width, text_width), size, attention_width, BATCH_SIZE, seed=SEED)
    elif kind == "cross_attention":
        rows = text.tfidf_features(pairs, fitted)
        network = attention.CrossAttention(
            classes, rows.select("post_id", "features"), text_width, width, attention_width, seed=SEED)
    else:
        raise ValueError(f"kind must be one of {KINDS}")
    trained = networks.fit_network(
        network,
        rows,
        model=kind,
        epochs=EPOCH_LIMIT[kind] if epochs is None else epochs,
        lr=LEARNING_RATE[kind] if lr is None else lr,
        patience=PATIENCE,
        threshold=ACCURACY_LIMIT,
        journal=journal,
    )
    return Run(kind, trained, rows, "fused", DISPLAY_NAMES)


def run_best_of(
    rows: DataFrame,
    models: dict[str, tuple[str, int]],
    classes: int = len(LABEL_CODES),
    epochs: int = 30,
    lr: float = 1e-3,
    patience: int = 10,
    threshold: float = ACCURACY_LIMIT,
) -> Run:
    """Train one head per named ``(vector column, width)`` and keep the best.

    The best has the highest valid accuracy, the first listed on ties.
    """
    heads = {
        name: train_epochs(
            rows, classes, width, col=col, model=name, epochs=epochs, lr=lr,
            patience=patience, threshold=threshold,
        )
        for name, (col, width) in models.items()
    }
    spark = rows.sparkSession
    gathered = history.union_histories({n: h.history_table(spark) for n, h in heads.items()})
    best = history.select_model(gathered, list(models)).first()["model"]
    return Run(best, heads[best], rows, models[best][0])


def prepare_manifest(manifest: DataFrame, clean: bool) -> DataFrame:
    """Code labels, normalize image names and, for training, drop incomplete rows."""
    coded = prepare.normalize_extension(prepare.encode_label(manifest))
    return prepare.drop_missing(coded, ["label", "image", "tweet"]) if clean else coded


def split_manifests(train: DataFrame, test: DataFrame, train_rows: int) -> DataFrame:
    """``post_id, label, image, tweet, split`` of both manifests, read ``with_order``.

    The first ``train_rows`` complete rows of the train manifest in load order are
    train, its other complete rows valid; the test manifest is not cleaned. ``post_id`` is
    the position in load order, test rows last, however the files were packed into tasks.
    """
    complete = prepare_manifest(train, clean=True)
    split = ordering.ordered_split(complete, train_rows, LOAD_ORDER)
    posts = split.unionByName(prepare_manifest(test, clean=False).withColumn("split", F.lit("test")))
    posts = posts.withColumn("_test", F.col("split") == "test")
    placed = ordering.dense_index(posts, ["_test", *LOAD_ORDER], "post_id")
    return placed.select("post_id", "label", "image", "tweet", "split")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--train", required=True, help="train manifest")
    parser.add_argument("--test", required=True, help="test manifest")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--features", required=True, help="Parquet table: image, features")
    parser.add_argument("--fusion", default="concat", choices=KINDS)
    parser.add_argument("--train-rows", type=int, default=TRAIN_ROWS)
    parser.add_argument("--text-dims", type=int, default=512)
    parser.add_argument("--epochs", type=int)
    parser.add_argument("--lr", type=float)
    parser.add_argument("--trained", action="store_true", help="train every layer, not the last one only")
    parser.add_argument("--hidden", type=int, help="hidden units of a trained concat run")
    parser.add_argument("--attention", type=int, default=512, help="width of trained attention")
    parser.add_argument("--journal", help="shared folder from which a trained run goes on")
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("postweave").getOrCreate()
    train, test = (
        read_manifest(spark, path, args.format, with_order=True) for path in (args.train, args.test)
    )
    posts = split_manifests(train, test, args.train_rows)
    features = spark.read.parquet(args.features).select(
        "image", F.col("features").cast("array<double>")
    )
    pairs = fusion.align_modalities(posts, features, "image")
    if args.trained:
        run = run_trained(pairs, args.fusion, args.epochs, args.lr, args.text_dims, args.attention, args.hidden, args.journal)
    else:
        run = run_fusion(pairs, args.fusion, args.epochs, args.lr, args.text_dims)
    write_tables(run.tables("test"), args.out)
    save_checkpoint(spark, run.head, f"{args.out.rstrip('/')}/model")


if __name__ == "__main__":
    main()
