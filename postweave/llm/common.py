"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives
    the loss of executors, and is computed once for all that read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, row_bytes: int, max_bytes: int) -> DataFrame:
    """Mark a stored table for broadcasting if its rows fit ``max_bytes``; else leave the
    join to shuffle. Either way the rows of the join are the same."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def broadcast_by_size(df: DataFrame, max_bytes: int) -> DataFrame:
    """Mark a stored table for broadcasting if its values, measured with their strings, fit ``max_bytes``;
    else leave the join to shuffle. Either way the rows of the join are the same."""
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
