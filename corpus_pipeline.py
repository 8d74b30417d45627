"""A corpus pipeline out of the operators in postweave/llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Every stage
but the last returns the columns of ``documents``; the last adds the pieces of each text.

quality   documents that fail the rules or are depleted go; frequent lines leave the others
exact     of equal texts one document stays
near      of each component of near copies one document stays
mixing    one row for each time that a document is taken, its text what that pass takes
pieces    sampled SentencePiece ids, with a check that they decode to the text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postweave.llm import exact_dedup, minhash, mixing, pieces, quality
from postweave.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, keep=docs.columns)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage),
          ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: The mix permutes blocks and the pieces are sampled by hashes that SQL has no form for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
