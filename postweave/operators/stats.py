"""Split sizes, class frequencies, text lengths and epoch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows of each split, and of all under the name ``all``."""
    return (
        df.rollup(split_col)
        .agg(F.count("*").alias("n_rows"), F.grouping(split_col).alias("_total"))
        .select(
            F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(split_col)).alias(split_col),
            "n_rows",
        )
    )


def class_counts(df: DataFrame, split_col: str = "split", label: str = "label") -> DataFrame:
    """Class frequency in each split, most frequent first; missing labels do not count."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(split_col, label)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(split_col, F.desc("n_rows"), label)
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency scaled to sum 1; an absent class has no row."""
    every_class = Window.partitionBy(F.lit(0))  # one row per class
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("weight", (1.0 / F.col("n_rows")) / F.sum(1.0 / F.col("n_rows")).over(every_class))
    )


def text_length(df: DataFrame, col: str = "tweet", out: str = "tweet_length") -> DataFrame:
    """Length in code points."""
    return df.withColumn(out, F.length(col).cast("bigint"))


def describe_lengths(
    df: DataFrame, col: str = "tweet_length", approx: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum.

    Exact quartiles keep one counter per distinct value, few for text lengths; for
    values with many distinct ones use ``approx``.
    """
    shares = [0.25, 0.5, 0.75]
    if approx:
        quartiles = F.percentile_approx(col, shares, accuracy)
    else:
        quartiles = F.percentile(col, shares)
    return df.agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        quartiles.alias("_q"),
        F.max(col).cast("double").alias("max"),
    ).select(
        "count",
        "mean",
        "std",
        "min",
        *[F.get("_q", i).cast("double").alias(n) for i, n in enumerate(["q25", "q50", "q75"])],
        "max",
    )


def length_histogram(df: DataFrame, col: str = "tweet_length", bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum, empty bins kept.

    The last bin holds the maximum. If all values are equal the range is widened by
    one half on both sides. The table is read once, for the count of each distinct
    length; bounds and bins come from that.
    """
    by_length = (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("x"))
        .agg(F.count("*").alias("n"))
    )
    # The count keeps the optimizer from scanning the table again for the bounds alone.
    seen = F.when(F.col("n") > 0, F.col("x"))
    bounds = by_length.agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = bounds.filter(F.col("lo").isNotNull()).select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"),
    )
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    # Whole numbers times bins stay exact in a double, so edges are not blurred.
    bin_no = F.floor((F.col("x") - lo) * bins / (hi - lo))
    counted = by_length.groupBy(F.least(bin_no.cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("n").alias("n")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    grid = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return grid.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("from_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("to_edge"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_rows"),
    )


def running_epoch_metrics(
    scored: DataFrame,
    loss: str = "loss",
    label: str = "label",
    prediction: str = "prediction",
    mean_of: str = "batch",
) -> DataFrame:
    """Loss and accuracy per epoch from rows with ``epoch`` and ``batch_id``.

    The loss is the mean of the batch means, so a short last batch counts fully;
    ``mean_of='sample'`` weighs by rows instead.
    """
    if mean_of not in ("batch", "sample"):
        raise ValueError("mean_of must be 'batch' or 'sample'")
    batches = scored.groupBy("epoch", "batch_id").agg(
        F.avg(loss).alias("batch_loss"),
        F.sum(loss).alias("loss_sum"),
        F.count_if(F.col(label) == F.col(prediction)).alias("correct"),
        F.count("*").alias("n"),
    )
    mean_loss = F.avg("batch_loss") if mean_of == "batch" else F.sum("loss_sum") / F.sum("n")
    return batches.groupBy("epoch").agg(
        mean_loss.alias("loss"),
        (F.sum("correct") / F.sum("n")).alias("accuracy"),
        F.count("*").alias("n_batches"),
    )
