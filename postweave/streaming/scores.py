"""Scoring posts as files arrive, with running confusion counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postweave.operators.evaluate import confusion_counts


def score_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    score: Callable[[DataFrame], DataFrame],
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Streaming ``label, prediction`` rows of the Parquet files under ``path``.

    A table that may be one file or a folder of files is named by a path with a wildcard that only
    it matches, such as ``posts[.]parquet``, and ``glob="*"``: files of a folder have other names.
    ``score`` maps the arriving rows to that form, for instance a fitted model's
    ``score_split``; the same function scores a batch table.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return score(reader.parquet(path))


def stream_confusion(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep ``out`` at the confusion counts of all rows so far; handles what has arrived.

    The state has one counter per (label, prediction). Each trigger replaces the
    small table, so a trigger repeated after a failure leaves the same result; a
    restart goes on from ``checkpoint``.
    """

    def replace(counts: DataFrame, _: int) -> None:
        counts.coalesce(1).write.mode("overwrite").parquet(out)

    return (
        confusion_counts(scored)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
