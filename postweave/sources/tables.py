"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, path: str, tasks: int | None = None, by: str | None = None
) -> DataFrame:
    """Read a Parquet table; ``tasks`` deals its rows to so many tasks by the key ``by``.

    Dealing pays where a table lies in fewer scan tasks than there are cores and the
    work per row is costly, such as splitting texts. It is the caller's decision.
    """
    df = spark.read.parquet(path)
    return df if tasks is None else df.repartition(tasks, by)


def write_tables(
    tables: dict[str, DataFrame],
    path: str,
    fmt: str = "parquet",
    partition_by: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write each table under ``path/name``; gives the paths written.

    ``partition_by`` names directory columns per table, such as ``split``, so that
    later readers skip the other directories.
    """
    layout = partition_by or {}
    written = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite").format(fmt)
        if layout.get(name):
            writer = writer.partitionBy(*layout[name])
        writer.save(target)
        written[name] = target
    return written


def write_manifest_csv(df: DataFrame, path: str) -> None:
    """Write a manifest so that ``read_manifest`` gives the same rows back."""
    df.select("image", "tweet", "label").write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
