"""Feature vectors: standardising, augmenting, pooling, projecting, activating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave import functions as PF


def fit_standardizer(train: DataFrame, col: str = "features") -> DataFrame:
    """``pos, mean, std`` (population deviation) per vector position.

    Each task keeps one running summary; vectors are not taken apart.
    """
    summary = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col(col)))
    stats = train.filter(F.col(col).isNotNull()).select(summary.alias("s")).select(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.std").alias("d"),
        F.col("s.count").alias("n"),
    )
    # The summary has the sample deviation.
    back = F.sqrt((F.col("n") - 1) / F.col("n"))
    pairs = F.arrays_zip(F.col("m").alias("m"), F.col("d").alias("d"))
    return stats.select("n", F.posexplode(pairs).alias("pos", "p")).select(
        "pos", F.col("p.m").alias("mean"), (F.col("p.d") * back).alias("std")
    )


def standardize(
    df: DataFrame,
    mean: Sequence[float],
    std: Sequence[float],
    col: str = "features",
    out: str | None = None,
) -> DataFrame:
    """``(x - mean) / std`` by position; a position with zero deviation is only shifted."""
    safe = [s if s else 1.0 for s in std]
    shifted = F.zip_with(col, PF.array_literal(mean), lambda x, m: x - m)
    scaled = F.zip_with(shifted, PF.array_literal(safe), lambda x, s: x / s)
    return df.withColumn(out or col, scaled)


def standardize_by(df: DataFrame, fitted: DataFrame, col: str = "features", out: str | None = None):
    """``standardize`` with the constants of ``fit_standardizer`` (one row per position)."""
    rows = fitted.orderBy("pos").collect()
    return standardize(df, [r["mean"] for r in rows], [r["std"] for r in rows], col, out)


def augment_train(
    df: DataFrame,
    copies: int,
    jitter: float,
    seed: int,
    id_col: str = "post_id",
    col: str = "features",
    split_col: str = "split",
) -> DataFrame:
    """Train rows become ``copies`` randomly changed ones; other rows pass through.

    A copy scales the vector by a factor in ``[1 - jitter, 1 + jitter)`` and reverses
    it on a coin flip, both decided by seed, id and copy number alone.
    """
    is_train = F.col(split_col) == F.lit("train")
    numbers = F.when(is_train, F.sequence(F.lit(1), F.lit(copies))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("copy_no", F.explode(numbers))
    draw = [F.col(id_col), F.col("copy_no")]
    scale = F.lit(1.0 - jitter) + F.lit(2.0 * jitter) * PF.seeded_uniform(
        seed, F.lit("scale"), *draw
    )
    flip = PF.seeded_uniform(seed, F.lit("flip"), *draw) < 0.5
    turned = F.when(flip, F.reverse(col)).otherwise(F.col(col))
    changed = PF.bind(scale, lambda s: F.transform(turned, lambda x: x * s))
    return rows.withColumn(col, F.when(is_train, changed).otherwise(F.col(col)))


def mean_pool(df: DataFrame, key: str, col: str, mask: str | None = None) -> DataFrame:
    """Average of the vectors of each key, position by position.

    Without ``mask`` every row counts, padding too. With it only rows whose mask is
    not 0 do; a key without any gives a NULL vector. Sums are formed per task first.
    """
    known = df.filter(F.col(col).isNotNull())
    counts = F.lit(True) if mask is None else F.coalesce(F.col(mask) != 0, F.lit(False))
    vec = F.when(counts, F.col(col)).otherwise(F.transform(col, lambda _: F.lit(0.0)))
    return (
        known.select(key, array_to_vector(vec).alias("_v"), counts.cast("int").alias("_n"))
        .groupBy(key)
        .agg(Summarizer.sum(F.col("_v")).alias("_sum"), F.sum("_n").alias("_n"))
        .withColumn("_sum", vector_to_array("_sum"))
        .select(
            key,
            F.when(F.col("_n") > 0, F.transform("_sum", lambda s: s / F.col("_n"))).alias(col),
        )
    )


def first_pool(
    df: DataFrame, key: str, pos: str, col: str, position: int | None = None
) -> DataFrame:
    """The vector at the lowest sequence position of each key.

    Where sequences are known to start at ``position``, such as 0, giving it makes this
    a filter on the scan.
    """
    if position is not None:
        return df.filter(F.col(pos) == position).select(key, col)
    return df.groupBy(key).agg(F.min_by(col, pos).alias(col))


def linear_project(
    df: DataFrame,
    weights,
    bias=None,
    col: str = "features",
    out: str = "projected",
    batches: bool = False,
) -> DataFrame:
    """Add ``weights . x + bias``; ``batches`` for wide matrices, with the same result."""
    return df.withColumn(out, PF.project(F.col(col), weights, bias, batches))


def activate(df: DataFrame, fn: str, col: str = "features", out: str = "activated") -> DataFrame:
    """Add ``relu`` or ``gelu`` of every entry."""
    functions = {"relu": PF.relu, "gelu": PF.gelu}
    if fn not in functions:
        raise ValueError(f"fn must be one of {sorted(functions)}")
    return df.withColumn(out, functions[fn](F.col(col)))
