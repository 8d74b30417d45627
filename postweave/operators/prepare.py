"""Preparing a manifest: coding, paths, projection, null audit, cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.schema import DISPLAY_NAMES, LABEL_CODES


def encode_label(
    df: DataFrame,
    col: str = "label",
    mapping: Mapping[str, int] | DataFrame = LABEL_CODES,
    out: str | None = None,
) -> DataFrame:
    """Replace label names by codes; unknown names become NULL.

    A mapping too long for a constant may be a table ``name, code``, which is joined.
    """
    target = out or col
    if isinstance(mapping, DataFrame):
        codes = mapping.select(F.col("name").alias("_name"), F.col("code").alias("_code"))
        joined = df.join(codes, df[col] == F.col("_name"), "left").drop("_name")
        return joined.withColumn(target, F.col("_code")).drop("_code")
    return df.withColumn(target, PF.encode_label(F.col(col), mapping))


def decode_label(
    df: DataFrame, col: str = "label", mapping: Mapping[str, int] = LABEL_CODES, out: str = "dir"
) -> DataFrame:
    """Add the label name of a code; it names the class directory."""
    return df.withColumn(out, PF.decode_label(F.col(col), mapping))


def display_label(
    df: DataFrame,
    col: str = "label",
    names: Sequence[str] = DISPLAY_NAMES,
    out: str = "display",
) -> DataFrame:
    return df.withColumn(out, PF.display_label(F.col(col), names))


def normalize_extension(df: DataFrame, col: str = "image") -> DataFrame:
    return df.withColumn(col, PF.normalize_extension(F.col(col)))


def build_media_path(
    df: DataFrame,
    root: str,
    image: str = "image",
    folder: str | None = "dir",
    out: str = "path",
    on_absolute: str = "null",
) -> DataFrame:
    """Add the file path of each image; ``folder=None`` for the flat layout."""
    parent = None if folder is None else F.col(folder)
    return df.withColumn(out, PF.media_path(root, F.col(image), parent, on_absolute))


def project_posts(df: DataFrame, image_only: bool = False) -> DataFrame:
    return df.select("label", "image") if image_only else df.select("label", "image", "tweet")


def text_or_nan(df: DataFrame, col: str = "tweet", missing_text: str = "nan") -> DataFrame:
    return df.withColumn(col, PF.text_or_nan(F.col(col), missing_text))


def _any_missing(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one missing value."""
    return df.filter(_any_missing(columns or df.columns))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column and rows with any, in one pass."""
    names = list(columns or df.columns)
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in names],
        F.count_if(_any_missing(names)).alias("rows_with_missing"),
    )


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value; NaN is a value, not missing."""
    return df.filter(~_any_missing(columns or df.columns))


def existing_media(
    posts: DataFrame, media: DataFrame, on: str = "path", missing: bool = False
) -> DataFrame:
    """Posts whose media file is listed, or with ``missing`` those whose file is not."""
    return posts.join(media.select(on), on, "left_anti" if missing else "left_semi")
