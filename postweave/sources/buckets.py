"""Tables stored in buckets of a key, so that joins along the key need no shuffle.

Posts, features and predictions of many runs are joined by the same id. Written once in the same
number of buckets, sorted by the id, they join bucket by bucket in every epoch and every run. The layout is in
the names of the files; a session that has not written the table opens it by its path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Store a table under ``path``, replacing an earlier one, and give it as it is read back.

    The rows are dealt to their buckets before, so a bucket is one file; take more buckets where one
    would not fit a task."""
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A table that another session wrote with ``write_bucketed``; the schema is that of its columns."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)
