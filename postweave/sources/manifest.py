"""Reading post manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.schema import MANIFEST, MISSING_WORDS

# Columns that give the load order: file, block of the file, place within it.
LOAD_ORDER = ["load_file", "load_block", "load_at"]


def read_manifest(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    multi_line: bool = True,
    missing_words: Sequence[str] = MISSING_WORDS,
    with_order: bool = False,
) -> DataFrame:
    """Load ``image, tweet, label`` rows with a declared schema.

    CSV columns are found by header name, so extra columns and any column order are
    fine. A quoted tweet may hold line breaks; since Spark then reads each file in
    one task, a large manifest should come as many files, as Parquet, or with
    ``multi_line=False`` where tweets have no breaks. CSV cells equal to one of
    ``missing_words`` are read as NULL.

    ``with_order`` adds the ``LOAD_ORDER`` columns, a key for operators that go by
    load order: files by name, rows as they stand in the file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    names = MANIFEST.fieldNames()
    if fmt == "parquet":
        at = F.col("_metadata.row_index")
        order = _order(F.lit(0).cast("bigint"), at) if with_order else []
        return spark.read.parquet(*paths).select(*names, *order)
    if fmt != "csv":
        raise ValueError(f"unknown manifest format {fmt!r}")
    reader = spark.read.options(
        header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False
    )
    # The header alone decides the columns; every cell is read as text.
    cells = reader.csv(paths)
    missing = [n for n in names if n not in cells.columns]
    if missing:
        raise ValueError(f"manifest lacks columns {missing}")
    words = list(missing_words)
    # Within a block the id grows with the row; only its order there is used.
    block, at = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return cells.select(
        *[F.when(~F.col(n).isin(words), F.col(n)).alias(n) if words else F.col(n) for n in names],
        *(_order(block, at) if with_order else []),
    )


def _order(block: Column, at: Column) -> list[Column]:
    values = [F.col("_metadata.file_path"), block, at]
    return [v.alias(n) for v, n in zip(values, LOAD_ORDER)]
