"""Multiclass evaluation. Everything derives from one count per (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``label, prediction, n_rows`` of the pairs that occur; unlabelled rows do not count."""
    known = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n_rows"))


def _grid(counts: DataFrame) -> DataFrame:
    """All pairs of the classes that occur as label or prediction (classes squared rows)."""
    seen = counts.agg(
        F.array_sort(
            F.array_union(F.collect_set("label"), F.collect_set("prediction"))
        ).alias("classes")
    )
    return seen.select(F.explode("classes").alias("label"), "classes").select(
        "label", F.explode("classes").alias("prediction")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Long form: true class, predicted class, rows; zero cells kept."""
    counts = confusion_counts(df, label, prediction)
    return (
        _grid(counts)
        .join(counts, ["label", "prediction"], "left")
        .select("label", "prediction", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"))
    )


def confusion_matrix_wide(
    df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per true class, one column ``p<class>`` per listed class."""
    long_form = confusion_matrix(df, label, prediction)
    named = long_form.withColumn("_p", F.concat(F.lit("p"), F.col("prediction")))
    wide = named.groupBy("label").pivot("_p", [f"p{c}" for c in classes]).agg(F.sum("n_rows"))
    return wide.na.fill(0)


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for a zero denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, precision, recall, f1, support, hits`` of the classes that occur."""
    counts = confusion_counts(df, label, prediction)
    hit = F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n_rows").alias("support"),
            zero.alias("predicted"),
            F.when(hit, F.col("n_rows")).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            zero.alias("support"),
            F.col("n_rows").alias("predicted"),
            zero.alias("hits"),
        ),
    )
    sums = (
        counts.select(F.inline(roles))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ["support", "predicted", "hits"]])
    )
    rates = sums.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
        }
    )
    both = F.col("precision") + F.col("recall")
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), both)
    return rates.select("class", "precision", "recall", f1.alias("f1"), "support", "hits")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    counts = confusion_counts(df, label, prediction)
    correct = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n_rows")).otherwise(0))
    return counts.agg((correct / F.sum("n_rows")).alias("accuracy"))


def _weighted(df: DataFrame, measure: str, label: str, prediction: str) -> DataFrame:
    weighted = F.sum(F.col("support") * F.col(measure)) / F.sum("support")
    return per_class(df, label, prediction).agg(weighted.alias(f"weighted_{measure}"))


def weighted_precision(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    return _weighted(df, "precision", label, prediction)


def weighted_recall(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    return _weighted(df, "recall", label, prediction)


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    return _weighted(df, "f1", label, prediction)


def summary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Accuracy and the three weighted measures in one row, from one pass."""
    total = F.sum("support")
    means = [
        (F.sum(F.col("support") * F.col(m)) / total).alias(f"weighted_{m}")
        for m in ["precision", "recall", "f1"]
    ]
    return per_class(df, label, prediction).agg((F.sum("hits") / total).alias("accuracy"), *means)


def classification_report(
    df: DataFrame,
    names: Sequence[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """``row_no, name, precision, recall, f1, support``.

    One row per class, then accuracy, macro average and weighted average. With
    ``names`` every named class has a row, of zeros if it does not occur; averages
    cover the classes that occur, as the per-class rows without names do.
    """
    found = per_class(df, label, prediction)
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy_value = F.sum("hits") / total
    means = {m: (F.avg(m), F.sum(F.col("support") * F.col(m)) / total) for m in measures}
    rows = F.array(
        F.struct(
            F.lit(1_000_000).alias("row_no"),
            F.lit("accuracy").alias("name"),
            *[accuracy_value.alias(m) for m in measures],
            total.alias("support"),
        ),
        *[
            F.struct(
                F.lit(1_000_001 + i).alias("row_no"),
                F.lit(name).alias("name"),
                *[means[m][i].alias(m) for m in measures],
                total.alias("support"),
            )
            for i, name in enumerate(["macro avg", "weighted avg"])
        ],
    )
    summary = found.agg(rows.alias("_rows")).select(F.inline("_rows"))
    if names is None:
        classes = found.select(
            F.col("class").alias("row_no"),
            F.col("class").cast("string").alias("name"),
            *measures,
            "support",
        )
    else:
        spark = df.sparkSession
        listed = spark.createDataFrame(list(enumerate(names)), "row_no int, name string")
        zero = {m: F.coalesce(m, F.lit(0.0)).alias(m) for m in measures}
        joined = listed.join(found, F.col("row_no") == F.col("class"), "full")
        classes = joined.select(
            F.coalesce("row_no", "class").alias("row_no"),
            F.coalesce("name", F.col("class").cast("string")).alias("name"),
            *zero.values(),
            F.coalesce("support", F.lit(0).cast("bigint")).alias("support"),
        )
    return classes.unionByName(summary)
