"""How the given tables stand for manifests, features, predictions and histories.

Each binding has the same derivation in SQL (``*_SQL``), so that a query and its SQL
read the same rows. All rows of the tables take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.operators import fusion, ordering, prepare, text
from postweave.schema import LABEL_CODES
from postweave.session import stored
from postweave.sources import read_table

SEED = 50
TEXT_DIMS = 512
TRAIN_SHARE = (7, 10)

_NAME_CASES = " ".join(f"WHEN {c} THEN '{n}'" for n, c in LABEL_CODES.items())
_CODE_CASES = " ".join(f"WHEN '{n}' THEN {c}" for n, c in LABEL_CODES.items())

def _posts_sql(gaps: bool) -> str:
    tweet = "CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE d.text END" if gaps else "d.text"
    code = "coalesce(e.label, CAST(d.doc_id % 10 AS INT))" + ("" if gaps else f" % {len(LABEL_CODES)}")
    return f"""posts AS (
  SELECT d.doc_id AS post_id, {tweet} AS tweet,
         CASE {code} {_NAME_CASES}
              ELSE 'unlisted' END AS label,
         concat('img_', CAST(d.doc_id AS VARCHAR(20)),
                CASE WHEN d.doc_id % 3 = 0 THEN '.JPG' ELSE '.jpg' END) AS image
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


# Documents as posts. The label is that of the vector with the same id, if there is one.
# Posts with gaps, for what is about missing values, lack some tweets and known labels.
POSTS_SQL = _posts_sql(gaps=False)
GAPS_SQL = _posts_sql(gaps=True)

CLEAN_SQL = f"""coded AS (
  SELECT post_id, CAST(CASE label {_CODE_CASES} END AS INT) AS label,
         replace(image, '.JPG', '.jpg') AS image, tweet FROM posts),
clean AS (SELECT * FROM coded WHERE label IS NOT NULL AND image IS NOT NULL AND tweet IS NOT NULL),
cut AS (SELECT (count(*) * 7) // 10 AS n FROM clean),
split_posts AS (
  SELECT c.*, row_number() OVER (ORDER BY post_id) - 1 AS row_idx,
         CASE WHEN row_number() OVER (ORDER BY post_id) - 1 < (SELECT n FROM cut)
              THEN 'train' ELSE 'valid' END AS split
  FROM clean c)"""

# Cleaned posts that have image features, split by themselves: 70 % train, 15 % valid, the
# rest test.
PAIRS_SQL = """parts AS (SELECT (count(*) * 7) // 10 AS n_train, (count(*) * 17) // 20 AS n_seen
  FROM clean JOIN embeddings ON vec_id = post_id),
pairs AS (
  SELECT c.post_id, c.label, c.tweet, e.embedding,
         CASE WHEN row_number() OVER (ORDER BY post_id) - 1 < (SELECT n_train FROM parts) THEN 'train'
              WHEN row_number() OVER (ORDER BY post_id) - 1 < (SELECT n_seen FROM parts) THEN 'valid'
              ELSE 'test' END AS split
  FROM clean c JOIN embeddings e ON e.vec_id = c.post_id)"""

# Vectors with all ten labels; the logits of predictions are a fixed projection.
VECTORS_SQL = """vectors AS (
  SELECT vec_id, label,
         CASE WHEN row_number() OVER (ORDER BY vec_id) - 1
                   < (SELECT (count(*) * 7) // 10 FROM embeddings)
              THEN 'train' ELSE 'valid' END AS split,
         row_number() OVER (ORDER BY vec_id) - 1 AS row_idx,
         embedding FROM embeddings),
entries AS (
  SELECT vec_id, label, split, row_idx, CAST(unnest(range(len(embedding))) AS INT) AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors)"""

PREDICTIONS_SQL = (
    VECTORS_SQL
    + """,
logits AS (SELECT vec_id, label, row_idx, CAST(o.i AS INT) AS pos, sum(x * sin(31 * o.i + pos)) AS x
  FROM entries CROSS JOIN range(10) o(i) GROUP BY vec_id, label, row_idx, o.i),
predictions AS (
  SELECT vec_id, label, row_idx, CAST(arg_min(pos, struct_pack(a := -x, b := pos)) AS INT)
         AS prediction, ln(sum(exp(x))) - max(CASE WHEN pos = label THEN x END) AS loss
  FROM logits GROUP BY vec_id, label, row_idx)"""
)

# Event types as models, days as epochs.
HISTORY_SQL = """history AS (
  SELECT event_type AS model, CAST(day(ts) AS INT) AS epoch,
         round(avg(value), 6) AS train_loss,
         round(avg(CASE WHEN value < 20 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)
           AS train_acc,
         round(stddev_samp(value), 6) AS valid_loss,
         round(avg(CASE WHEN value < 15 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)
           AS valid_acc
  FROM events GROUP BY 1, 2)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """``post_id, tweet, image`` of every document: posts where labels are not needed.

    A session may name in ``spark.postweave.textTasks`` how many tasks work on the texts.
    """
    tasks = spark.conf.get("spark.postweave.textTasks", None)
    docs = read_table(spark, f"{folder}/documents.parquet", int(tasks) if tasks else None, "doc_id")
    doc = F.col("doc_id")
    suffix = F.when(doc % 3 == 0, F.lit(".JPG")).otherwise(F.lit(".jpg"))
    return docs.select(
        doc.alias("post_id"),
        F.when(doc % 37 != 0, F.col("text")).alias("tweet") if gaps else F.col("text").alias("tweet"),
        F.concat(F.lit("img_"), doc.cast("string"), suffix).alias("image"),
    )


def posts(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """``texts`` with label names."""
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("post_id"), "label")
    code = F.coalesce("label", (F.col("post_id") % 10).cast("int"))
    named = code if gaps else code % len(LABEL_CODES)
    return (
        texts(spark, folder, gaps)
        .join(labels, "post_id", "left")
        .withColumn("label", F.coalesce(PF.decode_label(named), F.lit("unlisted")))
    )


def coded_posts(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Posts with label codes and normalized image names, not cleaned."""
    coded = prepare.normalize_extension(prepare.encode_label(posts(spark, folder, gaps)))
    return coded.select("post_id", "label", "image", "tweet")


def clean_posts(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    return prepare.drop_missing(coded_posts(spark, folder, gaps))


def split_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned posts, the first 70 % by id as train."""
    return ordering.share_split(clean_posts(spark, folder), TRAIN_SHARE, "post_id")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, label, features`` of every vector."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features")
    )


def split_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.share_split(vectors(spark, folder), TRAIN_SHARE, "vec_id")


def post_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image features by the post they belong to, one each."""
    return vectors(spark, folder).select(F.col("vec_id").alias("post_id"), "features")


def split_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned posts with image features by id: 70 % train, 15 % valid, the rest test.

    The pairs are joined once and stored: the split reads their ids, and a fit and its
    scoring read them again."""
    pairs = fusion.align_modalities(clean_posts(spark, folder), post_images(spark, folder))
    pairs = stored(pairs, "pairs", text.ROWS_PER_FILE)
    slim = pairs.select("post_id")
    rows = slim.count()
    seen = ordering.key_at(slim, rows * 17 // 20, "post_id", rows)
    first = ordering.key_at(slim, rows * 7 // 10, "post_id", rows)
    if first is None or seen is None:
        return pairs.withColumn("split", F.lit("train"))
    return pairs.withColumn(
        "split",
        F.when(F.col("post_id") < first["post_id"], "train")
        .when(F.col("post_id") < seen["post_id"], "valid")
        .otherwise("test"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, label, logits`` of every vector; every entry counts."""
    logits = PF.project(F.col("features"), fixed_weights(10, 64))
    return vectors(spark, folder).select("vec_id", "label", logits.alias("logits"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    def share(below: float):
        return F.avg(F.when(F.col("value") < below, 1.0).otherwise(0.0))

    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("epoch"))
        .agg(
            F.round(F.avg("value"), 6).alias("train_loss"),
            F.round(share(20), 6).alias("train_acc"),
            F.round(F.stddev_samp("value"), 6).alias("valid_loss"),
            F.round(share(15), 6).alias("valid_acc"),
        )
    )


def text_model(train: DataFrame):
    return text.fit_tfidf(train, TEXT_DIMS)


def fixed_weights(outputs: int, inputs: int) -> np.ndarray:
    """The matrix ``sin(31 * row + column)``."""
    return np.sin(31 * np.arange(outputs)[:, None] + np.arange(inputs)[None, :])


def fixed_query(width: int) -> list[float]:
    """The vector ``cos(position)``."""
    return np.cos(np.arange(width)).tolist()
