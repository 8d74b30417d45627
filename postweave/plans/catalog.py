"""The registered queries, each with the SQL that gives the same rows where SQL can.

Floating results are rounded to six digits, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.functions import TOKEN_PATTERN
from postweave.operators import (
    evaluate,
    fusion,
    ordering,
    prepare,
    score,
    stats,
    text,
    train,
)
from postweave.operators import history as epochs
from postweave.operators import vectors as vec
from postweave.plans import experiment
from postweave.plans import tables as T
from postweave.plans.network_sql import erf_sql
from postweave.plans.training_sql import head_sql, report_sql
from postweave.schema import DISPLAY_NAMES
from postweave.session import scratch_path
from postweave.sources import (
    load_checkpoint,
    read_manifest,
    save_checkpoint,
    scan_media,
    write_manifest_csv,
    write_tables,
)
from postweave.streaming import score_stream, stream_confusion

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MEDIA_ROOT = "media"
BATCH = 12
VOCAB = 20_000
RANGE_ROWS = 250
PATIENCE, THRESHOLD = 5, 0.39
MODELS = ["view", "click", "signup", "purchase", "error"]


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _r(value: Column | str, name: str) -> Column:
    """Rounded to six digits, without a negative zero."""
    col = F.col(value) if isinstance(value, str) else value
    return (F.round(col, 6) + F.lit(0.0)).alias(name)


def _long(df: DataFrame, keys: list[str], col: str, pos: str = "pos") -> DataFrame:
    """One row per vector entry."""
    rows = df.select(*keys, F.posexplode(col).alias(pos, "_x"))
    # Most entries of sparse vectors are zero; rounding goes through decimals and is slow.
    return rows.select(*keys, pos, F.when(F.col("_x") == 0, 0.0).otherwise(_r("_x", "value")).alias("value"))


def _joined(items: str) -> Column:
    return F.array_join(F.col(items).cast("array<string>"), " ").alias(items)


POSTS = f"WITH {T.POSTS_SQL}"
CLEAN = f"{POSTS}, {T.CLEAN_SQL}"
GAPS = f"WITH {T.GAPS_SQL}, {T.CLEAN_SQL}"
VECTORS = f"WITH {T.VECTORS_SQL}"
PREDICTIONS = f"WITH {T.PREDICTIONS_SQL}"
HISTORY = f"WITH {T.HISTORY_SQL}"


# --- sources and sinks ----------------------------------------------------------


@query(f"{POSTS} SELECT image, tweet, label FROM posts")
def read_manifest_csv(spark, folder):
    path = scratch_path(spark, "manifest")
    write_manifest_csv(T.posts(spark, folder), path)
    return read_manifest(spark, path)


@query(f"{POSTS} SELECT image, tweet, label FROM posts")
def read_manifest_parquet(spark, folder):
    path = scratch_path(spark, "manifest")
    T.posts(spark, folder).write.parquet(path)
    return read_manifest(spark, path, "parquet")


@query("SELECT DISTINCT concat('label=', label) AS folder FROM embeddings")
def scan_media_files(spark, folder):
    """The vectors as a tree with one folder per label, and what the listing finds there."""
    root = scratch_path(spark, "tree")
    vectors = {"vectors": T.table(spark, folder, "embeddings")}
    written = write_tables(vectors, root, partition_by={"vectors": ["label"]})
    return scan_media(spark, written["vectors"], "*.parquet").select("folder").distinct()


@query("SELECT label, count(*) AS n_rows, count(*) AS n_same FROM embeddings GROUP BY label")
def checkpoint_classifier(spark, folder):
    """The loaded model predicts every row as the saved one does."""
    rows = T.split_vectors(spark, folder)
    fitted = train.fit_linear_probe(rows.filter("split = 'train'"), reg=0.01)
    path = scratch_path(spark, "model")
    save_checkpoint(spark, fitted, path)
    loaded = load_checkpoint(spark, path)
    first = score.score_split(fitted, rows, ["vec_id"])
    second = score.score_split(loaded, rows, ["vec_id"]).select(
        "vec_id", F.col("prediction").alias("again")
    )
    same = F.count_if(F.col("prediction") == F.col("again"))
    return first.join(second, "vec_id").groupBy("label").agg(
        F.count("*").alias("n_rows"), same.alias("n_same")
    )


@query(
    f"{PREDICTIONS} SELECT label, prediction, count(*) AS n_rows FROM predictions GROUP BY 1, 2"
)
def write_result_tables(spark, folder):
    counts = evaluate.confusion_counts(score.predict_class(T.predictions(spark, folder)))
    paths = write_tables({"confusion": counts}, scratch_path(spark, "tables"))
    return spark.read.parquet(paths["confusion"])


# --- projections ------------------------------------------------------------------


@query(f"{GAPS} SELECT post_id, label FROM coded")
def encode_label(spark, folder):
    return prepare.encode_label(T.posts(spark, folder, gaps=True)).select("post_id", "label")


@query(f"{CLEAN} SELECT c.post_id, p.label AS dir FROM clean c JOIN posts p USING (post_id)")
def decode_label(spark, folder):
    return prepare.decode_label(T.clean_posts(spark, folder)).select("post_id", "dir")


@query(
    f"""{GAPS} SELECT post_id, CASE label WHEN 0 THEN 'ND' WHEN 1 THEN 'DI' WHEN 2 THEN 'DN'
    WHEN 3 THEN 'Fires' WHEN 4 THEN 'Flood' WHEN 5 THEN 'HD' END AS display FROM coded"""
)
def display_label(spark, folder):
    return prepare.display_label(T.coded_posts(spark, folder, gaps=True)).select("post_id", "display")


@query(f"{POSTS} SELECT post_id, replace(image, '.JPG', '.jpg') AS image FROM posts")
def normalize_extension(spark, folder):
    return prepare.normalize_extension(T.texts(spark, folder)).select("post_id", "image")


@query(
    f"""{CLEAN} SELECT c.post_id, '{MEDIA_ROOT}/' || p.label || '/images/' || c.image AS path,
    '{MEDIA_ROOT}/' || c.image AS flat_path FROM clean c JOIN posts p USING (post_id)"""
)
def build_media_path(spark, folder):
    named = prepare.decode_label(T.clean_posts(spark, folder))
    nested = prepare.build_media_path(named, MEDIA_ROOT)
    both = prepare.build_media_path(nested, MEDIA_ROOT, folder=None, out="flat_path")
    return both.select("post_id", "path", "flat_path")


@query(f"{CLEAN} SELECT label, image, tweet FROM coded")
def project_posts(spark, folder):
    return prepare.project_posts(T.coded_posts(spark, folder))


@query(f"{GAPS} SELECT post_id, coalesce(tweet, 'nan') AS tweet FROM posts")
def text_or_nan(spark, folder):
    return prepare.text_or_nan(T.texts(spark, folder, gaps=True)).select("post_id", "tweet")


# --- filters and row access -------------------------------------------------------


@query(f"{GAPS} SELECT * FROM coded WHERE label IS NULL OR image IS NULL OR tweet IS NULL")
def null_rows(spark, folder):
    return prepare.null_rows(T.coded_posts(spark, folder, gaps=True))


@query(
    f"""{GAPS} SELECT count(*) AS n_rows, count(*) - count(label) AS missing_label,
    count(*) - count(image) AS missing_image, count(*) - count(tweet) AS missing_tweet,
    count(*) FILTER (label IS NULL OR image IS NULL OR tweet IS NULL) AS rows_with_missing
    FROM coded"""
)
def null_profile(spark, folder):
    return prepare.null_profile(T.coded_posts(spark, folder, gaps=True), ["label", "image", "tweet"])


@query(f"{GAPS} SELECT post_id, label, image, tweet FROM clean")
def drop_missing(spark, folder):
    return prepare.drop_missing(T.coded_posts(spark, folder, gaps=True))


@query(f"{CLEAN} SELECT post_id, row_idx FROM split_posts")
def dense_index(spark, folder):
    slim = T.clean_posts(spark, folder).select("post_id")
    return ordering.dense_index(slim, "post_id", rows_per_range=RANGE_ROWS)


@query(
    f"""{CLEAN} SELECT post_id, label, image, tweet FROM split_posts
    WHERE row_idx = (SELECT count(*) // 3 FROM clean)"""
)
def row_at(spark, folder):
    rows = T.clean_posts(spark, folder)
    place = rows.count() // 3
    return ordering.row_at(rows, place, "post_id", lookup_rows=RANGE_ROWS)


_MEDIA = f"{CLEAN}, media AS (SELECT 'img_' || vec_id || '.jpg' AS image FROM embeddings)"


def _listed_media(spark, folder):
    name = F.concat(F.lit("img_"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    images = T.table(spark, folder, "embeddings").select(name.alias("image"))
    return prepare.build_media_path(images, MEDIA_ROOT, folder=None)


@query(f"{_MEDIA} SELECT post_id, label FROM coded SEMI JOIN media USING (image)")
def existing_media(spark, folder):
    coded = T.coded_posts(spark, folder)
    pathed = prepare.build_media_path(coded, MEDIA_ROOT, folder=None)
    found = prepare.existing_media(pathed, _listed_media(spark, folder))
    return found.select("post_id", "label")


@query(f"{_MEDIA} SELECT post_id, label FROM coded ANTI JOIN media USING (image)")
def missing_media(spark, folder):
    coded = T.coded_posts(spark, folder)
    pathed = prepare.build_media_path(coded, MEDIA_ROOT, folder=None)
    lost = prepare.existing_media(pathed, _listed_media(spark, folder), missing=True)
    return lost.select("post_id", "label")


# --- splits, order, batches -------------------------------------------------------


@query(f"{CLEAN} SELECT post_id, split FROM split_posts")
def ordered_split(spark, folder):
    slim = T.clean_posts(spark, folder).select("post_id")
    return ordering.share_split(slim, T.TRAIN_SHARE, "post_id", lookup_rows=RANGE_ROWS)


def _shuffled_sql(epoch: int) -> str:
    mix = f"md5(concat_ws('|', '{T.SEED}', '{epoch}', CAST(post_id AS VARCHAR)))"
    return f"""SELECT {epoch} AS epoch, post_id,
    row_number() OVER (ORDER BY {mix}, post_id) - 1 AS shuffle_pos FROM clean"""


@query(f"{CLEAN} {_shuffled_sql(1)} UNION ALL {_shuffled_sql(2)}")
def seeded_shuffle(spark, folder):
    slim = T.clean_posts(spark, folder).select("post_id")
    first, second = (
        ordering.seeded_shuffle(slim, T.SEED, e, "post_id", rows_per_range=RANGE_ROWS).select(
            F.lit(e).alias("epoch"), "post_id", "shuffle_pos"
        )
        for e in (1, 2)
    )
    return first.unionByName(second)


@query(f"{CLEAN} SELECT post_id, row_idx // {BATCH} AS batch_id FROM split_posts")
def assign_batches(spark, folder):
    slim = T.clean_posts(spark, folder).select("post_id")
    indexed = ordering.dense_index(slim, "post_id")
    return ordering.assign_batches(indexed, BATCH).select("post_id", "batch_id")


@query(
    f"""{CLEAN} SELECT split, count(*) AS n_rows,
    CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches,
    CAST(floor(30000 / (count(*) / CAST({BATCH} AS DOUBLE))) AS BIGINT) AS n_epochs
    FROM split_posts GROUP BY split"""
)
def batch_plan(spark, folder):
    return ordering.batch_plan(T.split_posts(spark, folder), BATCH, 30_000)


# --- distributions ----------------------------------------------------------------


@query(
    f"""{CLEAN} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split,
    count(*) AS n_rows FROM split_posts GROUP BY ROLLUP (split)"""
)
def split_sizes(spark, folder):
    return stats.split_sizes(T.split_posts(spark, folder))


@query(f"{CLEAN} SELECT split, label, count(*) AS n_rows FROM split_posts GROUP BY 1, 2")
def class_counts(spark, folder):
    return stats.class_counts(T.split_posts(spark, folder))


@query(
    f"""{CLEAN}, n AS (SELECT label, count(*) AS n_rows FROM split_posts
    WHERE split = 'train' GROUP BY label)
    SELECT label, n_rows, round((1.0::DOUBLE / n_rows) / (SELECT sum(1.0::DOUBLE / n_rows) FROM n), 6)
    AS weight FROM n"""
)
def class_weights(spark, folder):
    rows = T.split_posts(spark, folder).filter("split = 'train'")
    return stats.class_weights(rows).select("label", "n_rows", _r("weight", "weight"))


@query(f"{POSTS} SELECT post_id, length(tweet) AS tweet_length FROM posts")
def text_length(spark, folder):
    return stats.text_length(T.texts(spark, folder)).select("post_id", "tweet_length")


_LENGTHS = f"""{CLEAN}, lengths AS (
  SELECT CAST(length(tweet) AS DOUBLE) AS x FROM split_posts WHERE split = 'train')"""


@query(
    f"""{_LENGTHS} SELECT count(*) AS count, round(avg(x), 6) AS mean,
    round(stddev_samp(x), 6) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25,
    quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM lengths"""
)
def describe_lengths(spark, folder):
    rows = stats.text_length(T.split_posts(spark, folder).filter("split = 'train'"))
    described = stats.describe_lengths(rows)
    return described.withColumns({"mean": _r("mean", "mean"), "std": _r("std", "std")})


@query(
    f"""{_LENGTHS}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM lengths),
    placed AS (SELECT least(CAST(floor((x - lo) * 50 / (hi - lo)) AS INT), 49) AS bin,
      count(*) AS n FROM lengths, b GROUP BY 1)
    SELECT CAST(g.i AS INT) AS bin, round(lo + g.i * ((hi - lo) / 50), 6) AS from_edge,
    round(lo + (g.i + 1) * ((hi - lo) / 50), 6) AS to_edge, coalesce(n, 0) AS n_rows
    FROM range(50) g(i) CROSS JOIN b LEFT JOIN placed ON placed.bin = g.i"""
)
def length_histogram(spark, folder):
    rows = stats.text_length(T.split_posts(spark, folder).filter("split = 'train'"))
    bins = stats.length_histogram(rows)
    return bins.withColumns(
        {"from_edge": _r("from_edge", "from_edge"), "to_edge": _r("to_edge", "to_edge")}
    )


def _epoch_rows_sql(epoch: int) -> str:
    mix = f"md5(concat_ws('|', '{T.SEED}', '{epoch}', CAST(vec_id AS VARCHAR)))"
    return f"""SELECT {epoch} AS epoch, label, prediction, loss,
    (row_number() OVER (ORDER BY {mix}, vec_id) - 1) // {BATCH} AS batch_id FROM predictions"""


@query(
    f"""{PREDICTIONS}, rows AS ({_epoch_rows_sql(1)} UNION ALL {_epoch_rows_sql(2)}
      UNION ALL {_epoch_rows_sql(3)}),
    batches AS (SELECT epoch, batch_id, avg(loss) AS l, count(*) FILTER (label = prediction) AS c,
      count(*) AS n FROM rows GROUP BY 1, 2)
    SELECT epoch, round(avg(l), 6) AS loss, round(sum(c)::DOUBLE / sum(n)::DOUBLE, 6) AS accuracy,
    count(*) AS n_batches FROM batches GROUP BY epoch"""
)
def running_epoch_metrics(spark, folder):
    scored = score.cross_entropy(score.predict_class(T.predictions(spark, folder)))
    slim = scored.select("vec_id", "label", "prediction", "loss")
    passes = [
        ordering.assign_batches(
            ordering.seeded_shuffle(slim, T.SEED, e, "vec_id"), BATCH, "shuffle_pos"
        ).withColumn("epoch", F.lit(e))
        for e in (1, 2, 3)
    ]
    rows = passes[0].unionByName(passes[1]).unionByName(passes[2])
    metrics = stats.running_epoch_metrics(rows)
    return metrics.select("epoch", _r("loss", "loss"), _r("accuracy", "accuracy"), "n_batches")


# --- text -------------------------------------------------------------------------

_TOKENS = f"regexp_extract_all(lower(coalesce(tweet, 'nan')), '{TOKEN_PATTERN}', 0)"


@query(
    f"""{POSTS} SELECT post_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT post_id, {_TOKENS} AS t FROM posts)"""
)
def tokenize(spark, folder):
    texts = prepare.text_or_nan(T.texts(spark, folder))
    split = text.tokenize(texts)
    return split.select("post_id", F.size("tokens").cast("bigint").alias("n_tokens"), _joined("tokens"))


def _vocab_sql(size: int, fit: str = "split_posts") -> str:
    """Vocabulary of the train split of ``fit``, specials included."""
    return f"""words AS (SELECT unnest({_TOKENS}) AS token FROM {fit} WHERE split = 'train'),
    ranked AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS r
      FROM words GROUP BY token),
    vocab AS (SELECT token, CAST(r + 3 AS INT) AS id, n FROM ranked WHERE r <= {size} - 4
      UNION ALL VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0), ('[SEP]', 3, 0))"""


def _train_vocab(spark, folder):
    """The train vocabulary as a stored table, as every later run reads it."""
    fitted = text.fit_vocab(T.split_posts(spark, folder).filter("split = 'train'"), VOCAB)
    path = write_tables({"vocab": fitted}, scratch_path(spark, "text"))["vocab"]
    return spark.read.parquet(path)


@query(f"{CLEAN}, {_vocab_sql(VOCAB)} SELECT token, id, n FROM vocab")
def fit_vocab(spark, folder):
    return _train_vocab(spark, folder)


_ENCODED = f"""{CLEAN}, {_vocab_sql(VOCAB)},
    kept AS (SELECT post_id, {_TOKENS}[1:298] AS t FROM posts),
    found AS (SELECT k.post_id, k.pos, coalesce(v.id, 1) AS id FROM
      (SELECT post_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM kept) k
      LEFT JOIN vocab v USING (token)),
    bodies AS (SELECT post_id, list(id ORDER BY pos) AS ids FROM found GROUP BY post_id),
    encoded AS (SELECT k.post_id, list_concat([2], coalesce(ids, []), [3]) AS used
      FROM kept k LEFT JOIN bodies USING (post_id)),
    padded AS (SELECT post_id, list_concat(used, list_transform(range(300 - len(used)),
        lambda i: 0)) AS input_ids,
      list_concat(list_transform(used, lambda i: 1), list_transform(range(300 - len(used)),
        lambda i: 0)) AS attention_mask FROM encoded)"""


@query(
    f"""{_ENCODED} SELECT post_id, array_to_string(input_ids, ' ') AS input_ids,
    array_to_string(attention_mask, ' ') AS attention_mask FROM padded"""
)
def encode_text(spark, folder):
    rows = text.encode_text(T.texts(spark, folder), _train_vocab(spark, folder))
    return rows.select("post_id", _joined("input_ids"), _joined("attention_mask"))


@query(SQL["encode_text"])
def encode_text_by_join(spark, folder):
    vocab = _train_vocab(spark, folder)
    rows = text.encode_text(T.texts(spark, folder), vocab, lookup="join")
    return rows.select("post_id", _joined("input_ids"), _joined("attention_mask"))


@query(
    f"""{_ENCODED}, ids AS (SELECT post_id, unnest(range(300)) AS pos, unnest(input_ids) AS id
      FROM padded)
    SELECT post_id, string_agg(coalesce(token, ''), ' ' ORDER BY pos) AS tokens
    FROM ids LEFT JOIN vocab USING (id) GROUP BY post_id"""
)
def decode_tokens(spark, folder):
    vocab = _train_vocab(spark, folder)
    encoded = text.encode_text(T.texts(spark, folder), vocab)
    return text.decode_tokens(encoded, vocab).select("post_id", _joined("tokens"))


@query(SQL["decode_tokens"])
def decode_tokens_by_join(spark, folder):
    vocab = _train_vocab(spark, folder)
    encoded = text.encode_text(T.texts(spark, folder), vocab)
    return text.decode_tokens(encoded, vocab, lookup="join").select("post_id", _joined("tokens"))


def _tfidf_sql(rows: str, fit: str = "split_posts") -> str:
    """TF-IDF entries of the posts in ``rows``; fitted on the train split of ``fit``."""
    return f"""{_vocab_sql(T.TEXT_DIMS + 4, fit)},
    terms AS (SELECT token, id - 4 AS pos FROM vocab WHERE id > 3),
    in_train AS (SELECT DISTINCT post_id, unnest({_TOKENS}) AS token FROM {fit}
      WHERE split = 'train'),
    idf AS (SELECT t.pos, t.token, ln(((SELECT count(*) FROM {fit} WHERE split = 'train') + 1.0)
      / (count(i.post_id) + 1.0)) AS idf FROM terms t LEFT JOIN in_train i USING (token)
      GROUP BY 1, 2),
    used AS (SELECT post_id, unnest({_TOKENS}) AS token FROM {rows}),
    tf AS (SELECT post_id, token, count(*) AS n FROM used GROUP BY 1, 2),
    text_entries AS (SELECT p.post_id, i.pos, coalesce(tf.n, 0) * i.idf AS x
      FROM {rows} p CROSS JOIN idf i LEFT JOIN tf ON tf.post_id = p.post_id AND tf.token = i.token)"""


def _with_text(spark, folder, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    fitted = T.text_model(T.split_posts(spark, folder).filter("split = 'train'"))
    return text.tfidf_features(rows, fitted, keep=keep)


@query(
    f"""{CLEAN}, {_tfidf_sql('posts')}
    SELECT post_id, CAST(pos AS INT) AS pos, round(x, 6) AS value FROM text_entries"""
)
def tfidf_features(spark, folder):
    rows = _with_text(spark, folder, T.texts(spark, folder))
    return _long(rows, ["post_id"], "text_features")


# --- vectors ----------------------------------------------------------------------


@query(
    f"""{VECTORS}, fitted AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM entries
      WHERE split = 'train' GROUP BY pos)
    SELECT vec_id, pos, round((x - m) / s, 6) + 0.0 AS value FROM entries JOIN fitted USING (pos)"""
)
def standardize(spark, folder):
    rows = T.split_vectors(spark, folder)
    fitted = vec.fit_standardizer(rows.filter("split = 'train'"))
    return _long(vec.standardize_by(rows, fitted), ["vec_id"], "features")


def _draw_sql(kind: str) -> str:
    key = f"md5(concat_ws('|', '{T.SEED}', '{kind}', vec_id::VARCHAR, copy_no::VARCHAR))"
    return f"(('0x' || substr({key}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(
    f"""{VECTORS}, copies AS (
      SELECT vec_id, split, unnest(CASE WHEN split = 'train' THEN [1, 2] ELSE [0] END) AS copy_no,
        embedding FROM vectors),
    drawn AS (SELECT *, 0.8::DOUBLE + 0.4::DOUBLE * {_draw_sql('scale')} AS s,
      {_draw_sql('flip')} < 0.5 AS flip FROM copies),
    turned AS (SELECT vec_id, split, copy_no, s,
      CASE WHEN split = 'train' AND flip THEN list_reverse(embedding) ELSE embedding END AS e
      FROM drawn)
    SELECT vec_id, copy_no, CAST(pos AS INT) AS pos,
      round(CASE WHEN split = 'train' THEN x * s ELSE x END, 6) + 0.0 AS value
    FROM (SELECT vec_id, split, copy_no, s, unnest(range(len(e))) AS pos,
      CAST(unnest(e) AS DOUBLE) AS x FROM turned)"""
)
def augment_train(spark, folder):
    rows = T.split_vectors(spark, folder)
    copies = vec.augment_train(rows, copies=2, jitter=0.2, seed=T.SEED, id_col="vec_id")
    return _long(copies, ["vec_id", "copy_no"], "features")


@query(
    f"""{VECTORS} SELECT label, pos, round(avg(x), 6) + 0.0 AS value FROM entries
    GROUP BY label, pos"""
)
def mean_pool(spark, folder):
    return _long(vec.mean_pool(T.vectors(spark, folder), "label", "features"), ["label"], "features")


@query(
    f"""{VECTORS} SELECT label, pos, round(avg(x) FILTER (split = 'valid'), 6) + 0.0 AS value
    FROM entries GROUP BY label, pos"""
)
def mean_pool_masked(spark, folder):
    rows = T.split_vectors(spark, folder).withColumn("mask", (F.col("split") == "valid").cast("int"))
    return _long(vec.mean_pool(rows, "label", "features", "mask"), ["label"], "features")


@query(
    f"""{VECTORS}, first AS (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY label)
    SELECT label, pos, round(x, 6) + 0.0 AS value FROM entries JOIN first USING (label, vec_id)"""
)
def first_pool(spark, folder):
    pooled = vec.first_pool(T.vectors(spark, folder), "label", "vec_id", "features")
    return _long(pooled, ["label"], "features")


_PROJECTED = f"""{VECTORS}, projected AS (SELECT vec_id, CAST(o.i AS INT) AS out,
    sum(x * sin(31 * o.i + pos)) + o.i AS y FROM entries CROSS JOIN range(6) o(i)
    GROUP BY vec_id, o.i)"""
_WIDE = f"""{VECTORS}, projected AS (SELECT vec_id, CAST(o.i AS INT) AS out,
    sum(x * sin(31 * o.i + pos)) AS y FROM entries CROSS JOIN range(80) o(i)
    GROUP BY vec_id, o.i)"""


@query(f"{_PROJECTED} SELECT vec_id, out, round(y, 6) + 0.0 AS value FROM projected")
def linear_project(spark, folder):
    rows = vec.linear_project(
        T.vectors(spark, folder), T.fixed_weights(6, 64), bias=range(6)
    )
    return _long(rows, ["vec_id"], "projected", "out")


@query(f"{_WIDE} SELECT vec_id, out, round(y, 6) + 0.0 AS value FROM projected")
def linear_project_wide(spark, folder):
    rows = vec.linear_project(T.vectors(spark, folder), T.fixed_weights(80, 64), batches=True)
    return _long(rows, ["vec_id"], "projected", "out")


def _gelu_sql(y: str) -> str:
    return f"({y} * 0.5 * (1 + {erf_sql(f'({y} / sqrt(2))')}))"


@query(
    f"""{_PROJECTED} SELECT vec_id, out, round(greatest(y, 0), 6) + 0.0 AS relu,
    round({_gelu_sql('y')}, 6) + 0.0 AS gelu FROM projected"""
)
def activate(spark, folder):
    rows = vec.linear_project(
        T.vectors(spark, folder), T.fixed_weights(6, 64), bias=range(6)
    )
    both = vec.activate(vec.activate(rows, "relu", "projected", "relu"), "gelu", "projected", "gelu")
    pairs = both.select("vec_id", F.posexplode(F.arrays_zip("relu", "gelu")).alias("out", "_p"))
    return pairs.select("vec_id", "out", _r("_p.relu", "relu"), _r("_p.gelu", "gelu"))


# --- fusion -----------------------------------------------------------------------


@query(
    f"""{CLEAN} SELECT post_id, c.label, tweet, len(embedding) AS width,
    round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first_entry
    FROM clean c JOIN embeddings e ON e.vec_id = c.post_id"""
)
def align_modalities(spark, folder):
    pairs = fusion.align_modalities(T.clean_posts(spark, folder), T.post_images(spark, folder))
    return pairs.select(
        "post_id",
        "label",
        "tweet",
        F.size("features").cast("bigint").alias("width"),
        _r(F.get("features", 0), "first_entry"),
    )


_ALIGNED = f"""{CLEAN}, {T.PAIRS_SQL}, {_tfidf_sql('pairs', 'pairs')},
    image_entries AS (SELECT post_id, label, split, CAST(unnest(range(len(embedding))) AS INT) AS pos,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM pairs),
    fused AS (SELECT post_id, label, split, pos, x FROM image_entries
      UNION ALL SELECT p.post_id, p.label, p.split, 64 + t.pos, t.x
      FROM pairs p JOIN text_entries t USING (post_id))"""


def _aligned(spark, folder, keep: list[str] | None = None) -> DataFrame:
    """Cleaned posts with both feature vectors; text features fitted on their train split."""
    pairs = T.split_pairs(spark, folder)
    return text.tfidf_features(pairs, T.text_model(pairs.filter("split = 'train'")), keep=keep)


@query(f"{_ALIGNED} SELECT post_id, CAST(pos AS INT) AS pos, round(x, 6) + 0.0 AS value FROM fused")
def fuse_concat(spark, folder):
    fused = fusion.fuse_concat(_aligned(spark, folder), "features", "text_features")
    return _long(fused, ["post_id"], "fused")


_SCORES = f"""{VECTORS}, hidden AS (SELECT vec_id, o.i AS out, sum(x * sin(31 * o.i + pos)) + 0.1 AS y
      FROM entries CROSS JOIN range(8) o(i) GROUP BY vec_id, o.i),
    scores AS (SELECT vec_id, label, row_idx // {BATCH} AS batch_id, s FROM vectors JOIN
      (SELECT vec_id, sum({_gelu_sql('y')} * cos(out)) AS s FROM hidden GROUP BY vec_id)
      USING (vec_id))"""


def _attention_sql(partition: str, kept: str) -> str:
    over = f"OVER ({partition})"
    return f"""{_SCORES}, powers AS (SELECT *, exp(s - max(s) {over}) AS p FROM scores),
    weights AS (SELECT *, p / sum(p) {over} AS weight FROM powers)
    SELECT w.vec_id, {kept} e.pos, round(w.weight, 6) AS weight,
    round(e.x * w.weight, 6) + 0.0 AS value FROM weights w JOIN entries e USING (vec_id)"""


def _attended(df: DataFrame, scope, bounded: bool, keep: list[str]) -> DataFrame:
    weights = (T.fixed_weights(8, 64), [0.1] * 8, T.fixed_query(8))
    rows = fusion.batch_attention(df, *weights, scope=scope, bounded=bounded)
    long_rows = rows.select("vec_id", *keep, "weight", F.posexplode("attended").alias("pos", "_x"))
    return long_rows.select("vec_id", *keep, "pos", _r("weight", "weight"), _r("_x", "value"))


def _batched_vectors(spark, folder) -> DataFrame:
    return ordering.assign_batches(
        ordering.dense_index(T.vectors(spark, folder), "vec_id"), BATCH
    )


@query(_attention_sql("PARTITION BY batch_id", "w.batch_id,"))
def batch_attention(spark, folder):
    return _attended(_batched_vectors(spark, folder), "batch_id", True, ["batch_id"])


@query(_attention_sql("", ""))
def batch_attention_all(spark, folder):
    return _attended(T.vectors(spark, folder), None, False, [])


@query(_attention_sql("PARTITION BY label", "w.label,"))
def batch_attention_by_key(spark, folder):
    return _attended(T.vectors(spark, folder), "label", False, ["label"])


# Two images per post: vectors 2k and 2k + 1 belong to document k.
_CROSS = f"""{CLEAN}, {_tfidf_sql('posts')},
    images AS (SELECT vec_id // 2 AS post_id, vec_id, CAST(unnest(range(len(embedding))) AS INT) AS pos,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    q AS (SELECT post_id, o.i AS out, sum(x * sin(31 * o.i + pos)) AS y
      FROM text_entries CROSS JOIN range(8) o(i) GROUP BY 1, 2),
    k AS (SELECT post_id, vec_id, o.i AS out, sum(x * sin(31 * o.i + pos)) AS y
      FROM images CROSS JOIN range(8) o(i) GROUP BY 1, 2, 3),
    v AS (SELECT post_id, vec_id, o.i AS pos, sum(x * sin(31 * o.i + pos)) AS y
      FROM images CROSS JOIN range({T.TEXT_DIMS}) o(i) GROUP BY 1, 2, 3),
    s AS (SELECT k.post_id, k.vec_id, sum(q.y * k.y) AS s FROM q JOIN k USING (post_id, out)
      GROUP BY 1, 2),
    p AS (SELECT *, exp(s - max(s) OVER (PARTITION BY post_id)) AS p FROM s),
    w AS (SELECT post_id, vec_id, p / sum(p) OVER (PARTITION BY post_id) AS weight FROM p)"""


def _cross_inputs(spark, folder):
    texts = _with_text(spark, folder, T.texts(spark, folder), ["post_id"])
    images = T.vectors(spark, folder).withColumn(
        "post_id", F.floor(F.col("vec_id") / 2).cast("bigint")
    )
    query_layer = (T.fixed_weights(8, T.TEXT_DIMS), None)
    key_layer = (T.fixed_weights(8, 64), None)
    return texts, images, query_layer, key_layer


@query(
    f"""{_CROSS} SELECT t.post_id, CAST(t.pos AS INT) AS pos,
    round(coalesce(sum(w.weight * v.y), 0) + max(t.x), 6) + 0.0 AS value
    FROM text_entries t LEFT JOIN v ON v.post_id = t.post_id AND v.pos = t.pos
    LEFT JOIN w ON w.post_id = v.post_id AND w.vec_id = v.vec_id GROUP BY t.post_id, t.pos"""
)
def cross_attention(spark, folder):
    texts, images, query_layer, key_layer = _cross_inputs(spark, folder)
    value_layer = (T.fixed_weights(T.TEXT_DIMS, 64), None)
    rows = fusion.cross_attention(
        texts, images, "post_id", query_layer, key_layer, value_layer, batches=True
    )
    return _long(rows, ["post_id"], "attended")


@query(f"{_CROSS} SELECT post_id, vec_id, round(weight, 6) AS weight FROM w")
def cross_attention_weights(spark, folder):
    texts, images, query_layer, key_layer = _cross_inputs(spark, folder)
    rows = fusion.cross_attention_weights(
        texts, images, "post_id", "vec_id", query_layer, key_layer, batches=True
    )
    return rows.select("post_id", "vec_id", _r("weight", "weight"))


@query(
    f"""{CLEAN}, t AS (SELECT post_id, {_TOKENS} AS t FROM posts),
    rows AS (SELECT post_id, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS item,
      1.0::DOUBLE / len(t) AS weight FROM t)
    SELECT post_id, pos, item, round(weight, 6) AS weight FROM rows"""
)
def attention_table(spark, folder):
    """Token weights of mean pooling: every token of a post counts the same."""
    split = text.tokenize(prepare.text_or_nan(T.texts(spark, folder)))
    even = F.transform("tokens", lambda _: F.lit(1.0) / F.size("tokens"))
    rows = fusion.attention_table(split.withColumn("w", even), "post_id", "tokens", "w")
    return rows.select("post_id", "pos", "item", _r("weight", "weight"))


@query(
    f"""{_CROSS} SELECT post_id,
    round(max(CASE WHEN vec_id % 2 = 0 THEN weight END), 6) AS image_0,
    round(max(CASE WHEN vec_id % 2 = 1 THEN weight END), 6) AS image_1 FROM w GROUP BY post_id"""
)
def attention_matrix(spark, folder):
    texts, images, query_layer, key_layer = _cross_inputs(spark, folder)
    weights = fusion.cross_attention_weights(
        texts, images, "post_id", "vec_id", query_layer, key_layer, batches=True
    )
    named = weights.withColumn(
        "image", F.concat(F.lit("image_"), (F.col("vec_id") % 2).cast("string"))
    )
    wide = fusion.attention_matrix(named, "post_id", "image", ["image_0", "image_1"])
    return wide.select("post_id", _r("image_0", "image_0"), _r("image_1", "image_1"))


# --- training ---------------------------------------------------------------------


def _residual(
    rows: DataFrame,
    weights,
    bias,
    reg: float,
    weight: str | None = None,
    col: str = "features",
) -> DataFrame:
    """Per class the largest entry of the gradient of the penalised loss, to a few digits.

    A convex fit is the right one where this gradient is zero. The penalty acts on
    standardised inputs, so it counts by the variance of each; the bias has none.
    """
    matrix = weights.toArray()
    classes, width = matrix.shape
    gradient = train.softmax_gradient(rows, matrix, bias.toArray(), col=col, weight=weight)
    weighted = rows.select(col, F.lit(1.0).alias("_w") if weight is None else F.col(weight).alias("_w"))
    entries = weighted.select("_w", F.posexplode(col).alias("pos", "x")).groupBy("pos").agg(
        F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("x")).alias("s"),
        F.sum(F.col("_w") * F.col("x") * F.col("x")).alias("q"), F.count("*").alias("rows"),
    )
    mean = F.col("s") / F.col("n")
    variance = (F.col("q") / F.col("n") - mean * mean) * (F.col("rows") / (F.col("rows") - 1))
    spread = entries.select("pos", variance.alias("variance"))
    layer = rows.sparkSession.createDataFrame(
        [(p, matrix[:, p].tolist()) for p in range(width)], "pos int, w array<double>"
    )
    joined = gradient.join(spread, "pos", "left").join(layer, "pos", "left")
    penalty = [F.coalesce(F.get("w", k) * F.col("variance") * reg, F.lit(0.0)) for k in range(classes)]
    largest = joined.agg(
        *[F.max(F.abs(F.col(f"g{k}") + penalty[k])).alias(f"m{k}") for k in range(classes)]
    )
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"m{k}").alias("m")) for k in range(classes)])
    return largest.select(F.inline(each)).select(
        "class", (F.round("m", 2) + F.lit(0.0)).alias("residual")
    )


def _zeros(classes: int) -> str:
    return f"SELECT CAST(k.i AS INT) AS class, 0.0::DOUBLE AS residual FROM range({classes}) k(i)"


@query(_zeros(10))
def fit_linear_probe(spark, folder):
    rows = T.split_vectors(spark, folder).filter("split = 'train'")
    fitted = train.fit_linear_probe(rows, reg=0.01)
    return _residual(rows, fitted.coefficientMatrix, fitted.interceptVector, 0.01)


@query(_zeros(10))
def fit_weighted_probe(spark, folder):
    rows = T.split_vectors(spark, folder).filter("split = 'train'")
    weights = stats.class_weights(rows).select("label", "weight")
    weighted = rows.join(weights, "label")
    fitted = train.fit_linear_probe(weighted, weight="weight", reg=0.01)
    return _residual(weighted, fitted.coefficientMatrix, fitted.interceptVector, 0.01, "weight")


@query(_zeros(6))
def fit_fused_classifier(spark, folder):
    rows = _aligned(spark, folder, ["label", "split", "features"]).filter("split = 'train'")
    fitted = train.fit_fused_classifier(rows)
    fused = fusion.fuse_concat(rows, "features", "text_features").select("label", "fused")
    return _residual(fused, fitted.coefficientMatrix, fitted.interceptVector, 0.01, col="fused")


_EPOCHS, _RATE = 4, 0.05
_VECTOR_INPUTS = (
    "SELECT vec_id AS id, label, split = 'train' AS is_train, pos, x FROM entries"
)


@query(
    f"""{VECTORS}, {head_sql(_VECTOR_INPUTS, 10, _EPOCHS, _RATE)}
    SELECT 'probe' AS model, epoch, round(train_loss, 6) AS train_loss,
    round(train_acc, 6) AS train_acc, round(valid_loss, 6) AS valid_loss,
    round(valid_acc, 6) AS valid_acc FROM run"""
)
def train_epochs(spark, folder):
    rows = T.split_vectors(spark, folder)
    head = train.train_epochs(rows, 10, 64, model="probe", epochs=_EPOCHS, lr=_RATE)
    rounded = {c: _r(c, c) for c in epochs.SERIES}
    return head.history_table(spark).withColumns(rounded)


_GRADIENT = f"""{VECTORS}, f AS (SELECT vec_id, label, pos, x FROM entries
      UNION ALL SELECT vec_id, label, -1, 1.0 FROM vectors),
    z AS (SELECT vec_id, label, o.i AS k, sum(x * CASE WHEN pos < 0 THEN 0.1 * o.i
      ELSE sin(31 * o.i + pos) END) AS z FROM f CROSS JOIN range(10) o(i) GROUP BY 1, 2, 3),
    p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z),
    losses AS (SELECT avg(-ln(p)) AS loss FROM p WHERE k = label),
    g AS (SELECT f.pos, p.k, avg((p.p - CASE WHEN p.k = p.label THEN 1 ELSE 0 END) * f.x) AS g
      FROM f JOIN p USING (vec_id) GROUP BY 1, 2)"""


@query(
    f"""{_GRADIENT} SELECT CAST(pos AS INT) AS pos,
    {", ".join(f"round(max(CASE WHEN k = {k} THEN g END), 6) + 0.0 AS g{k}" for k in range(10))},
    CASE WHEN pos = -1 THEN round((SELECT loss FROM losses), 6) END AS loss FROM g GROUP BY pos"""
)
def softmax_gradient(spark, folder):
    bias = [0.1 * k for k in range(10)]
    rows = train.softmax_gradient(T.vectors(spark, folder), T.fixed_weights(10, 64), bias)
    return rows.select("pos", *[_r(f"g{k}", f"g{k}") for k in range(10)], _r("loss", "loss"))


# --- scoring ----------------------------------------------------------------------


@query(f"{PREDICTIONS} SELECT vec_id, prediction FROM predictions")
def predict_class(spark, folder):
    return score.predict_class(T.predictions(spark, folder)).select("vec_id", "prediction")


@query(f"{PREDICTIONS} SELECT vec_id, label, round(loss, 6) AS loss FROM predictions")
def cross_entropy(spark, folder):
    rows = score.cross_entropy(T.predictions(spark, folder))
    return rows.select("vec_id", "label", _r("loss", "loss"))


@query(
    f"""{PREDICTIONS}, n AS (SELECT label, 1.0::DOUBLE / count(*) AS w FROM predictions GROUP BY 1)
    SELECT round(sum(w * loss) / sum(w), 6) AS loss FROM predictions JOIN n USING (label)"""
)
def weighted_cross_entropy(spark, folder):
    rows = score.cross_entropy(T.predictions(spark, folder))
    weights = stats.class_weights(rows).select("label", "weight")
    mean = score.mean_cross_entropy(rows.join(weights, "label"), weight="weight")
    return mean.select(_r("loss", "loss"))


@query(
    f"""{VECTORS}, {head_sql(_VECTOR_INPUTS, 10, _EPOCHS, _RATE)}
    SELECT id AS vec_id, label, prediction FROM scored WHERE NOT is_train"""
)
def score_split(spark, folder):
    rows = T.split_vectors(spark, folder)
    head = train.train_epochs(rows, 10, 64, epochs=_EPOCHS, lr=_RATE)
    return score.score_split(head, rows.filter("split = 'valid'"), ["vec_id"])


# --- evaluation -------------------------------------------------------------------


def _scored(spark, folder) -> DataFrame:
    return score.predict_class(T.predictions(spark, folder)).select("label", "prediction")


_PAIRS = f"""{PREDICTIONS}, classes AS (SELECT label AS c FROM predictions
      UNION SELECT prediction FROM predictions),
    n AS (SELECT label, prediction, count(*) AS n FROM predictions GROUP BY 1, 2)"""


@query(
    f"""{_PAIRS} SELECT a.c AS label, b.c AS prediction, coalesce(n.n, 0) AS n_rows
    FROM classes a CROSS JOIN classes b LEFT JOIN n ON n.label = a.c AND n.prediction = b.c"""
)
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_scored(spark, folder))


@query(
    f"""{_PAIRS} SELECT a.c AS label,
    {", ".join(f"CAST(coalesce(sum(n.n) FILTER (n.prediction = {k}), 0) AS BIGINT) AS p{k}"
               for k in range(10))}
    FROM classes a LEFT JOIN n ON n.label = a.c GROUP BY a.c"""
)
def confusion_matrix_wide(spark, folder):
    return evaluate.confusion_matrix_wide(_scored(spark, folder), range(10))


@query(f"{PREDICTIONS} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM predictions")
def accuracy(spark, folder):
    return evaluate.accuracy(_scored(spark, folder)).select(_r("accuracy", "accuracy"))


_RATES = f"{PREDICTIONS}, {report_sql('predictions')}"


def _weighted_sql(measure: str) -> str:
    return f"""{_RATES} SELECT round(sum(support * {measure}) / sum(support), 6)
    AS weighted_{measure} FROM rates"""


@query(_weighted_sql("precision"))
def weighted_precision(spark, folder):
    rows = evaluate.weighted_precision(_scored(spark, folder))
    return rows.select(_r("weighted_precision", "weighted_precision"))


@query(_weighted_sql("recall"))
def weighted_recall(spark, folder):
    rows = evaluate.weighted_recall(_scored(spark, folder))
    return rows.select(_r("weighted_recall", "weighted_recall"))


@query(_weighted_sql("f1"))
def weighted_f1(spark, folder):
    rows = evaluate.weighted_f1(_scored(spark, folder))
    return rows.select(_r("weighted_f1", "weighted_f1"))


def rounded_report(report: DataFrame) -> DataFrame:
    return report.select(
        "name", *[_r(m, m) for m in ["precision", "recall", "f1"]], "support"
    )


@query(f"{_RATES} SELECT * FROM report")
def classification_report(spark, folder):
    return rounded_report(evaluate.classification_report(_scored(spark, folder)))


# --- epoch history ----------------------------------------------------------------

_BEST_OF = """best AS (SELECT *, min(valid_loss) OVER (PARTITION BY model ORDER BY epoch)
      AS best_loss, coalesce(valid_loss < coalesce(min(valid_loss) OVER (PARTITION BY model
      ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE), false)
      AS improved FROM history)"""
_COUNTED_OF = f"""{_BEST_OF}, islands AS (SELECT *, sum(improved::INT) OVER (PARTITION BY model
      ORDER BY epoch) AS island FROM best),
    counted AS (SELECT * EXCLUDE (island), row_number() OVER (PARTITION BY model, island
      ORDER BY epoch) - CASE WHEN island = 0 THEN 0 ELSE 1 END AS counter FROM islands)"""


def _stops_sql(patience: int, threshold: float) -> str:
    return f"""{_COUNTED_OF}, causes AS (SELECT *, CASE WHEN train_acc > {threshold} THEN 'threshold'
      WHEN counter >= {patience} THEN 'patience' END AS cause FROM counted),
    stops AS (SELECT model, coalesce(min(epoch) FILTER (cause IS NOT NULL), max(epoch))
      AS stop_epoch FROM causes GROUP BY model),
    ran AS (SELECT c.*, stop_epoch FROM causes c JOIN stops USING (model) WHERE epoch <= stop_epoch),
    stopped AS (SELECT model, stop_epoch, coalesce(max(cause), 'epoch_limit') AS reason,
      max(epoch) FILTER (improved AND cause IS DISTINCT FROM 'threshold') AS best_epoch,
      min(valid_loss) FILTER (improved AND cause IS DISTINCT FROM 'threshold') AS best_loss
      FROM ran GROUP BY model, stop_epoch)"""


_BEST, _COUNTED = f"{HISTORY}, {_BEST_OF}", f"{HISTORY}, {_COUNTED_OF}"
_STOPS = f"{HISTORY}, {_stops_sql(PATIENCE, THRESHOLD)}"


@query(f"{_BEST} SELECT * FROM best")
def best_so_far(spark, folder):
    return epochs.best_so_far(T.history(spark, folder))


@query(f"{_COUNTED} SELECT * FROM counted")
def patience_counter(spark, folder):
    return epochs.patience_counter(T.history(spark, folder))


@query(f"{_STOPS} SELECT * FROM stopped")
def early_stop(spark, folder):
    return epochs.early_stop(T.history(spark, folder), PATIENCE, THRESHOLD)


@query(f"{_STOPS} SELECT h.* FROM history h JOIN stops s ON h.model = s.model AND epoch <= stop_epoch")
def cut_history(spark, folder):
    rows = T.history(spark, folder)
    return epochs.cut_history(rows, epochs.early_stop(rows, PATIENCE, THRESHOLD))


@query(f"{_STOPS} SELECT model, best_epoch FROM stopped")
def best_checkpoint_epoch(spark, folder):
    return epochs.best_checkpoint_epoch(T.history(spark, folder), PATIENCE, THRESHOLD)


_POSITIONS = ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS))
_WINNER = f"""{HISTORY}, listed(model, place) AS (VALUES {_POSITIONS}),
    winner AS (SELECT model, max(valid_acc) AS best_valid_acc FROM history JOIN listed USING (model)
      GROUP BY model, place ORDER BY 2 DESC, place LIMIT 1)"""


@query(f"{_WINNER} SELECT * FROM winner")
def select_model(spark, folder):
    return epochs.select_model(T.history(spark, folder), MODELS)


@query(f"{_WINNER} SELECT h.* FROM history h SEMI JOIN winner USING (model)")
def winner_history(spark, folder):
    return epochs.winner_history(T.history(spark, folder), MODELS)


# Limits within which the runs end by their rule.
_LONG = 16
_PATIENT, _LIMITED = (0.5, 3, 0.999), (0.05, 10, 0.25)
_SERIES = ", ".join(f"round({c}, 6) AS {c}" for c in epochs.SERIES)


@query(
    f"""{VECTORS}, {head_sql(_VECTOR_INPUTS, 10, _EPOCHS, _RATE, 'a_')},
    {head_sql(_VECTOR_INPUTS, 10, _EPOCHS, _RATE / 5, 'b_')}
    SELECT 'fast' AS model, epoch, {_SERIES} FROM a_run
    UNION ALL SELECT 'slow', epoch, {_SERIES} FROM b_run"""
)
def union_histories(spark, folder):
    """Two heads of different rates, their histories in one table."""
    rows = T.split_vectors(spark, folder)
    parts = {
        name: train.train_epochs(rows, 10, 64, epochs=_EPOCHS, lr=rate).history_table(spark).drop("model")
        for name, rate in [("fast", _RATE), ("slow", _RATE / 5)]
    }
    both = epochs.union_histories(parts)
    return both.select("model", "epoch", *[_r(c, c) for c in epochs.SERIES])


def _stopped_run(spark, folder, lr: float, patience: int, threshold: float) -> DataFrame:
    rows = T.split_vectors(spark, folder)
    head = train.train_epochs(
        rows, 10, 64, model="probe", epochs=_LONG, lr=lr, patience=patience, threshold=threshold
    )
    past = head.history_table(spark).withColumns({c: _r(c, c) for c in epochs.SERIES})
    return past.withColumns(
        {"reason": F.lit(head.stop_reason), "best_epoch": F.lit(head.best_epoch).cast("int")}
    )


def _stopped_sql(lr: float, patience: int, threshold: float) -> str:
    return f"""{VECTORS}, {head_sql(_VECTOR_INPUTS, 10, _LONG, lr)},
    history AS (SELECT 'probe' AS model, * FROM run), {_stops_sql(patience, threshold)}
    SELECT model, epoch, {_SERIES}, reason, CAST(best_epoch AS INT) AS best_epoch
    FROM ran JOIN (SELECT model, reason, best_epoch FROM stopped) USING (model)"""


@query(_stopped_sql(*_PATIENT))
def train_until_patience(spark, folder):
    return _stopped_run(spark, folder, *_PATIENT)


@query(_stopped_sql(*_LIMITED))
def train_until_threshold(spark, folder):
    return _stopped_run(spark, folder, *_LIMITED)


@query(
    f"""{HISTORY} SELECT * EXCLUDE (age) FROM (SELECT *, row_number() OVER (PARTITION BY model
    ORDER BY epoch DESC) AS age FROM history) WHERE age > 1"""
)
def trim_history(spark, folder):
    return epochs.trim_history(T.history(spark, folder), 1)


@query(
    f"""{HISTORY} SELECT model, epoch, 'train_acc' AS series, train_acc AS value FROM history
    UNION ALL SELECT model, epoch, 'valid_acc', valid_acc FROM history
    UNION ALL SELECT model, epoch, 'train_loss', train_loss FROM history
    UNION ALL SELECT model, epoch, 'valid_loss', valid_loss FROM history"""
)
def learning_curves(spark, folder):
    return epochs.learning_curves(T.history(spark, folder))


# --- streaming --------------------------------------------------------------------


@query(
    f"{PREDICTIONS} SELECT label, prediction, count(*) AS n_rows FROM predictions GROUP BY 1, 2"
)
def stream_scores(spark, folder):
    """Confusion counts kept by a stream over the vector files."""
    schema = T.table(spark, folder, "embeddings").schema
    logits = PF.project(F.col("embedding").cast("array<double>"), T.fixed_weights(10, 64))

    def scored(rows: DataFrame) -> DataFrame:
        return rows.select("label", PF.argmax(logits).alias("prediction"))

    out = scratch_path(spark, "stream")
    arriving = score_stream(spark, f"{folder}/embeddings[.]parquet", schema, scored, "*")
    stream_confusion(arriving, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


# --- whole runs -------------------------------------------------------------------


def _fusion_run(spark, folder, kind: str) -> DataFrame:
    run = experiment.run_fusion(
        T.split_pairs(spark, folder), kind, _EPOCHS, _RATE, T.TEXT_DIMS
    )
    return rounded_report(run.report("test"))


# Test rows are of neither kind, so no epoch sees them.
_SEEN = "CASE split WHEN 'train' THEN true WHEN 'valid' THEN false END AS is_train"
_FUSED_INPUTS = f"SELECT post_id AS id, label, {_SEEN}, pos, x FROM fused"


_BASIC = f"""{_ALIGNED}, batched AS (SELECT post_id, label, split, (row_number() OVER (
      PARTITION BY split ORDER BY CASE WHEN split = 'train'
      THEN md5(concat_ws('|', '{T.SEED}', '1', CAST(post_id AS VARCHAR))) END, post_id) - 1)
      // {BATCH} AS batch_id FROM pairs),
    sides AS (SELECT 'image' AS side, post_id, pos, x, 8.0::DOUBLE AS r FROM image_entries
      UNION ALL SELECT 'text', post_id, pos, x, {T.TEXT_DIMS**0.5!r}::DOUBLE FROM text_entries),
    hidden AS (SELECT side, post_id, o.i AS out, sum(x * sin(31 * o.i + pos) / r) AS y
      FROM sides CROSS JOIN range(8) o(i) GROUP BY 1, 2, 3),
    scores AS (SELECT side, post_id, sum({_gelu_sql('y')} * cos(out)) AS s FROM hidden
      GROUP BY 1, 2),
    powers AS (SELECT *, exp(s - max(s) OVER (PARTITION BY side, split, batch_id)) AS p
      FROM scores JOIN batched USING (post_id)),
    weights AS (SELECT *, p / sum(p) OVER (PARTITION BY side, split, batch_id) AS weight
      FROM powers),
    attended AS (SELECT post_id, label, split, CASE side WHEN 'image' THEN pos ELSE 64 + pos END
      AS pos, x * weight AS x FROM sides JOIN weights USING (side, post_id))"""
_BASIC_INPUTS = f"SELECT post_id AS id, label, {_SEEN}, pos, x FROM attended"

# With one image per post the attention weight is 1.
_CROSS_RUN = f"""{_ALIGNED}, value_entries AS (SELECT post_id, o.i AS pos,
      sum(x * sin(31 * o.i + pos) / 8) AS x FROM image_entries
      CROSS JOIN range({T.TEXT_DIMS}) o(i) GROUP BY 1, 2),
    attended AS (SELECT p.post_id, label, split, v.pos, v.x + t.x AS x FROM pairs p
      JOIN value_entries v USING (post_id) JOIN text_entries t ON t.post_id = v.post_id
        AND t.pos = v.pos
      UNION ALL SELECT post_id, label, split, {T.TEXT_DIMS} + pos, x FROM image_entries)"""


def _run_sql(rows: str, inputs: str) -> str:
    return f"""{rows}, {head_sql(inputs, 6, _EPOCHS, _RATE)},
    held AS (SELECT label, prediction FROM scored WHERE is_train IS NULL),
    {report_sql('held', DISPLAY_NAMES)} SELECT * FROM report"""


@query(_run_sql(_ALIGNED, _FUSED_INPUTS))
def concat_fusion_report(spark, folder):
    return _fusion_run(spark, folder, "concat")


@query(_run_sql(_BASIC, _BASIC_INPUTS))
def basic_attention_report(spark, folder):
    return _fusion_run(spark, folder, "basic_attention")


@query(_run_sql(_CROSS_RUN, _BASIC_INPUTS))
def cross_attention_report(spark, folder):
    return _fusion_run(spark, folder, "cross_attention")


_VARIANTS = {
    "plain": "x",
    "scaled": "(x - m) / s",
    "rectified": "greatest((x - m) / s, 0)",
}


def _best_of_sql() -> str:
    heads = ", ".join(
        head_sql(
            f"""SELECT vec_id AS id, label, split = 'train' AS is_train, pos, {value} AS x
            FROM entries JOIN fitted USING (pos)""",
            10, _EPOCHS, _RATE, f"{name}_",
        )
        for name, value in _VARIANTS.items()
    )
    tops = " UNION ALL ".join(
        f"SELECT {i} AS place, '{name}' AS model, max(valid_acc) AS top FROM {name}_run"
        for i, name in enumerate(_VARIANTS)
    )
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS model, label, prediction FROM {name}_scored WHERE NOT is_train"
        for name in _VARIANTS
    )
    means = ", ".join(
        f"round(sum(support * {m}) / sum(support), 6) AS weighted_{m}"
        for m in ["precision", "recall", "f1"]
    )
    return f"""{VECTORS}, fitted AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM entries
      WHERE split = 'train' GROUP BY pos), {heads},
    winner AS (SELECT model FROM ({tops}) ORDER BY top DESC, place LIMIT 1),
    valid AS (SELECT label, prediction FROM ({rows}) SEMI JOIN winner USING (model)),
    {report_sql('valid')}
    SELECT (SELECT model FROM winner) AS model,
    round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, {means} FROM rates"""


@query(_best_of_sql())
def unimodal_best_of(spark, folder):
    rows = T.split_vectors(spark, folder)
    fitted = vec.fit_standardizer(rows.filter("split = 'train'"))
    scaled = vec.standardize_by(rows, fitted, out="scaled")
    both = vec.activate(scaled, "relu", "scaled", "rectified")
    run = experiment.run_best_of(
        both,
        {"plain": ("features", 64), "scaled": ("scaled", 64), "rectified": ("rectified", 64)},
        classes=10, epochs=_EPOCHS, lr=_RATE,
    )
    metrics = run.metrics("valid").select(
        *[_r(m, m) for m in ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]]
    )
    return metrics.select(F.lit(run.name).alias("model"), "*")
