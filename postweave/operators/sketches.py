"""Length statistics that can be merged: one stored row per input file and split.

A row holds count, sum, sum of squares, bounds and a quantile sketch (KLL) of a file's values. An update reads the files
that the store does not know; any choice of splits is described from the stored rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = ("file string, changed timestamp, split string, n bigint, total double, squares double, "
          "low bigint, high bigint, sketch binary")
#: Sketch parameter; ranks are off by at most RANK_ERROR with 99 % certainty.
K, RANK_ERROR = 400, 0.0135


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_files(spark: SparkSession, source: str, store: str) -> list[str]:
    """The files below ``source`` that the store has not seen, or not since they changed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source)
    listed = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))
    known = _stored(spark, store)
    if known is not None:
        listed = listed.join(known.select("file", "changed").distinct(), ["file", "changed"], "left_anti")
    return [r["file"] for r in listed.select("file").collect()]


def sketch_rows(rows: DataFrame, value: Column, split: Column, k: int = K) -> DataFrame:
    """The stored rows of a table that is read from files; aggregates combine in each task."""
    valued = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"),
        split.cast("string").alias("split"), value.cast("bigint").alias("x"))
    x = F.col("x").cast("double")
    return valued.groupBy("file", "changed", "split").agg(
        F.count("x").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"),
        F.min("x").alias("low"), F.max("x").alias("high"), F.kll_sketch_agg_bigint("x", F.lit(k)).alias("sketch"))


def update_sketches(spark: SparkSession, source: str, store: str, value: Column, split: Column) -> int:
    """Add the new files of a Parquet folder to the store; the number of files read. A file without rows is read again."""
    files = new_files(spark, source, store)
    if files:
        sketch_rows(spark.read.parquet(*files), value, split).write.mode("append").parquet(store)
    return len(files)


def describe_sketches(spark: SparkSession, store: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of some splits (default: all), as ``describe_lengths``.

    Of a file that changed the last version counts. The quartiles are values of the data whose
    rank is within the sketch's bound; the other figures are exact."""
    rows = _stored(spark, store)
    if rows is None:
        rows = spark.createDataFrame([], STORED)
    last = rows.groupBy("file").agg(F.max("changed").alias("_last"))
    rows = rows.join(last, "file").filter(F.col("changed") == F.col("_last")).filter("n > 0")
    if splits is not None:
        rows = rows.filter(F.col("split").isin(list(splits)))
    n, total = F.sum("n"), F.sum("total")
    merged = rows.agg(
        n.alias("count"), (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest((F.sum("squares") - total * total / n) / (n - 1), F.lit(0.0)))).alias("std"),
        F.min("low").cast("double").alias("min"), F.kll_merge_agg_bigint("sketch").alias("_s"), F.max("high").cast("double").alias("max"))
    cut = lambda share: F.when(F.col("count") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(share))).cast("double")
    return merged.select(
        F.coalesce("count", F.lit(0).cast("long")).alias("count"), "mean", "std", "min",
        *[cut(share).alias(name) for share, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]], "max")
