"""Aligning modalities and fusing their feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave import functions as PF


def align_modalities(posts: DataFrame, images: DataFrame, on: str = "post_id") -> DataFrame:
    """One row per post that has both text and image features."""
    return posts.join(images, on, "inner")


def fuse_concat(df: DataFrame, first: str, second: str, out: str = "fused") -> DataFrame:
    """Add the concatenated vector; the order fixes the weight layout downstream."""
    return df.withColumn(out, F.concat(first, second))


# Parts that the rows of a key are dealt to where constants of the key are joined back.
SALTS = 16

# Scores are summed by level of this width before they are scaled to the key's maximum:
# exp of the width is far from overflow, and nearly all keys have one or two levels.
LEVEL_WIDTH = 256


def _level(score: Column) -> Column:
    return F.floor(score / LEVEL_WIDTH) * LEVEL_WIDTH


def _scaled_to_top(parts: DataFrame, key: str) -> DataFrame:
    """Add the key's top level and the factor from a row's level to it."""
    of_key = Window.partitionBy(key)  # one row per level
    topped = parts.withColumn("_top", F.max("_level").over(of_key))
    return topped.withColumn("_scale", F.exp((F.col("_level") - F.col("_top")).cast("double")))


def softmax_stats(scored: DataFrame, key: str, score: str = "_score") -> DataFrame:
    """``key, _top, _mass``: softmax of a key's scores is ``exp(score - _top) / _mass``.

    A key with very many rows is reduced to one row per score level in each task; no
    task sees all its rows.
    """
    level = _level(F.col(score))
    parts = scored.groupBy(key, level.alias("_level")).agg(
        F.sum(F.exp(F.col(score) - level)).alias("_part")
    )
    return (
        _scaled_to_top(parts, key)
        .groupBy(key)
        .agg(
            F.max("_top").cast("double").alias("_top"),
            F.sum(F.col("_part") * F.col("_scale")).alias("_mass"),
        )
    )


def attention_score(
    vec: Column, weights, bias, query: Sequence[float], batches: bool = False
) -> Column:
    """``gelu(weights . x + bias) . query``."""
    return PF.dot(PF.gelu(PF.project(vec, weights, bias, batches)), PF.array_literal(query))


def batch_attention(
    df: DataFrame,
    weights,
    bias,
    query: Sequence[float],
    scope: str | None = "batch_id",
    bounded: bool = False,
    col: str = "features",
    out: str = "attended",
    weight: str = "weight",
    batches: bool = False,
) -> DataFrame:
    """Weigh each vector by the softmax of its score over the rows of its scope.

    ``scope`` is a batch or key column, or None for the whole table; rows without a
    scope value are a scope of their own. Only the two softmax constants of a key are
    joined back, in salted copies, so a key may hold any number of rows.
    ``bounded=True`` promises that no key has more rows than a task can sort, as with
    batches, and uses a window instead.
    """
    scored = df.withColumn("_score", attention_score(F.col(col), weights, bias, query, batches))
    power = F.exp(F.col("_score") - F.col("_top"))
    if scope is None:
        # Every row shares the constant, so it comes from one result row.
        whole = softmax_stats(scored.select(F.lit(0).alias("_all"), "_score"), "_all").first()
        top, mass = (whole["_top"], whole["_mass"]) if whole else (0.0, 1.0)
        weighted = scored.withColumn(weight, F.exp(F.col("_score") - F.lit(top)) / F.lit(mass))
    elif bounded:
        mates = Window.partitionBy(scope)
        weighted = (
            scored.withColumn("_top", F.max("_score").over(mates))
            .withColumn(weight, power / F.sum(power).over(mates))
            .drop("_top")
        )
    else:
        stats = softmax_stats(scored.select(scope, "_score"), scope)
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        copies = stats.select(F.col(scope).alias("_scope"), "_top", "_mass", salts.alias("_copy"))
        salted = scored.withColumn("_salt", F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int"))
        same = salted[scope].eqNullSafe(copies["_scope"]) & (salted["_salt"] == copies["_copy"])
        weighted = (
            salted.join(copies, same)
            .withColumn(weight, power / F.col("_mass"))
            .drop("_top", "_mass", "_scope", "_copy", "_salt")
        )
    scaled = PF.bind(F.col(weight), lambda w: F.transform(col, lambda x: x * w))
    return weighted.withColumn(out, scaled).drop("_score")


def _scored_pairs(
    texts: DataFrame,
    images: DataFrame,
    on: str,
    query,
    key,
    text_col: str,
    image_col: str,
    batches: bool,
) -> DataFrame:
    """Each image with the text of its own post and their score.

    The join is along the post key and texts are unique by it, so there is one pair
    per image row. A text without images has one pair without a score.
    """
    asked = texts.withColumn("_q", PF.project(F.col(text_col), *query, batches=batches))
    offered = images.filter(F.col(image_col).isNotNull()).withColumn(
        "_k", PF.project(F.col(image_col), *key, batches=batches)
    )
    return asked.join(offered, on, "left").withColumn("_score", PF.dot(F.col("_q"), F.col("_k")))


def cross_attention(
    texts: DataFrame,
    images: DataFrame,
    on: str,
    query: tuple,
    key: tuple,
    value: tuple,
    text_col: str = "text_features",
    image_col: str = "features",
    out: str = "attended",
    batches: bool = False,
) -> DataFrame:
    """``on, out``: text vector plus the attention-weighted sum of its images' values.

    ``query``, ``key`` and ``value`` are ``(weights, bias)`` pairs; the value width
    must equal the text width. With one image the weight is 1 and the result is
    value plus text; a text without images keeps its own vector. The sums are formed per task and score level, so a post with
    very many images does not gather in one task. The value layer is linear: the images themselves are summed, with a
    one for the bias, and the layer is applied to the sums.
    """
    layer = np.asarray(value[0], dtype="float64")
    shift = np.zeros(len(layer)) if value[1] is None else np.asarray(value[1], dtype="float64")
    vec = F.col(image_col)
    whole = (F.size(vec) == layer.shape[1]) & ~F.exists(vec, lambda x: x.isNull())
    extended = F.when(vec.isNotNull() & whole, F.concat(vec.cast("array<double>"), F.array(F.lit(1.0))))
    pairs = _scored_pairs(
        texts.select(on, text_col), images.withColumn("_v", extended), on, query, key, text_col, image_col, batches
    )
    # Without an image the value is zero and its weight 1.
    nothing = PF.array_literal(np.zeros(layer.shape[1] + 1))
    pairs = pairs.withColumns(
        {"_score": F.coalesce("_score", F.lit(0.0)), "_v": F.coalesce("_v", nothing)}
    )
    level = _level(F.col("_score"))
    power = F.exp(F.col("_score") - level)
    powered = PF.bind(power, lambda p: F.transform("_v", lambda v: v * p))
    parts = (
        pairs.select(
            on,
            level.alias("_level"),
            power.alias("_power"),
            array_to_vector(powered).alias("_pv"),
        )
        .groupBy(on, "_level")
        .agg(
            F.sum("_power").alias("_part"),
            Summarizer.sum(F.col("_pv")).alias("_vec"),
        )
    )
    scaled = F.transform(vector_to_array("_vec"), lambda v: v * F.col("_scale"))
    sums = (
        _scaled_to_top(parts, on)
        .withColumn("_vec", array_to_vector(scaled))
        .groupBy(on)
        .agg(
            F.sum(F.col("_part") * F.col("_scale")).alias("_mass"),
            Summarizer.sum(F.col("_vec")).alias("_vec"),
        )
        .select(F.col(on).alias("_on"), "_mass", vector_to_array("_vec").alias("_vec"))
    )
    # The sums went by id alone; the text's own vector joins them once.
    own = texts.select(on, text_col)
    mean = F.transform("_vec", lambda s: s / F.col("_mass"))
    joined = own.join(sums.select("_on", mean.alias("_mean")), own[on].eqNullSafe(F.col("_on")))
    values = PF.project(F.col("_mean"), np.hstack([layer, shift[:, None]]), batches=batches)
    attended = F.zip_with(values, text_col, lambda v, t: v + t)
    return joined.select(on, attended.alias(out))


def cross_attention_weights(
    texts: DataFrame,
    images: DataFrame,
    on: str,
    image_id: str,
    query: tuple,
    key: tuple,
    text_col: str = "text_features",
    image_col: str = "features",
    batches: bool = False,
) -> DataFrame:
    """``on, image_id, weight`` for every image of a post."""
    pairs = _scored_pairs(
        texts.select(on, text_col), images, on, query, key, text_col, image_col, batches
    ).filter(F.col("_score").isNotNull()).select(on, image_id, "_score")
    weight = F.exp(F.col("_score") - F.col("_top")) / F.col("_mass")
    return pairs.join(softmax_stats(pairs, on), on).select(on, image_id, weight.alias("weight"))


def attention_table(df: DataFrame, id_col: str, items: str, weights: str) -> DataFrame:
    """``id, pos, item, weight`` rows from an array of items and one of weights."""
    pairs = F.arrays_zip(F.col(items).alias("item"), F.col(weights).alias("weight"))
    return df.select(id_col, F.posexplode(pairs).alias("pos", "_pair")).select(
        id_col, "pos", F.col("_pair.item").alias("item"), F.col("_pair.weight").alias("weight")
    )


def attention_matrix(
    df: DataFrame, row: str, column: str, columns: Sequence, weight: str = "weight"
) -> DataFrame:
    """One row per ``row`` value and one column per listed ``column`` value."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.sum(weight))
