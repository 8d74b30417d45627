"""Corpus-fitted text features: tokens, vocabulary, fixed-length encoding, TF-IDF."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.schema import MAX_TOKENS
from postweave.session import stored

SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
PAD, UNK, CLS, SEP = range(len(SPECIALS))

# What may be sent to every task: the whole vocabulary of a lookup in batches, or the
# most frequent entries of a lookup by joins.
BROADCAST_ENTRIES = 100_000
BROADCAST_BYTES = 64 * 2**20
# Texts or their vectors in a stored file.
ROWS_PER_FILE = 4_000


def tokenize(df: DataFrame, col: str = "tweet", out: str = "tokens") -> DataFrame:
    """Add lower-cased words and single punctuation marks of the whole text."""
    return df.withColumn(out, PF.tokens(F.col(col)))


def token_counts(df: DataFrame, col: str = "tweet") -> DataFrame:
    """How often each token occurs; summed per task before the shuffle."""
    words = df.select(F.explode(PF.tokens(F.col(col))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def fit_vocab(df: DataFrame, size: int, min_count: int = 1, col: str = "tweet") -> DataFrame:
    """``token, id, n`` of the most frequent tokens of the training texts.

    Ids follow the specials by count, then by token; ``size`` includes the specials.
    """
    top = (
        token_counts(df, col)
        .filter(F.col("n") >= min_count)
        .orderBy(F.desc("n"), "token")
        .limit(size - len(SPECIALS))
    )
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")  # at most ``size`` rows
    ranked = top.select(
        "token", (F.row_number().over(rank) + len(SPECIALS) - 1).cast("int").alias("id"), "n"
    )
    spark = df.sparkSession
    specials = spark.createDataFrame(
        [(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, n bigint"
    )
    return specials.unionByName(ranked)


def _sent_vocab(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Tokens and ids of a vocabulary; refused beyond the broadcast bounds."""
    sized = vocab.agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("b")).first()
    if sized["n"] > BROADCAST_ENTRIES or (sized["b"] or 0) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to send to every task; use lookup='join'")
    rows = vocab.select("token", "id").collect()
    return pa.array([r["token"] for r in rows], "string"), pa.array([r["id"] for r in rows], "int32")


def _map_entries(kind: str, keys: pa.Array, values: pa.Array, default):
    """Arrow function that replaces every entry of an array column by its value."""

    @F.arrow_udf(f"array<{kind}>")
    def look_up(column: pa.Array) -> pa.Array:
        entries = column.flatten().cast(keys.type)
        found = values.take(pc.index_in(entries, value_set=keys)).fill_null(default)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
        return pa.ListArray.from_arrays(ends, found)

    return look_up


def _join_entries(
    df: DataFrame, vocab: DataFrame, id_col: str, col: str, on: str, value: str, default
) -> DataFrame:
    """``id, _mapped`` by joins, for a vocabulary of any size.

    Ids go by frequency, so the first entries hold the hot tokens; they are joined by
    broadcast, within both bounds. Only tokens beyond them, rare or very long, are
    shuffled. Rows with the same id and the same entries are counted, looked up once
    and repeated; rows with the same id and other entries stay apart.
    """
    given = df.groupBy(id_col, col).agg(F.count("*").alias("_copies"))
    rows = given.select(
        id_col, F.xxhash64(col).alias("_entries"), "_copies", F.posexplode_outer(col).alias("pos", on)
    )
    short = F.octet_length("token") <= BROADCAST_BYTES // BROADCAST_ENTRIES
    in_head = (F.col("id") < BROADCAST_ENTRIES) & short
    head = vocab.filter(in_head).select(on, F.col(value).alias("_head"))
    tail = vocab.filter(~in_head).select(
        F.col(on).cast("string").alias("_rare"), F.col(value).alias("_tail")
    )
    first = rows.join(F.broadcast(head), on, "left")
    # Found and empty entries leave the second key: they get keys of their own, which
    # match nothing, so that they do not meet in one task.
    own = F.concat(F.lit("\u0000"), F.col("_entries").cast("string"))
    rest = F.col("_head").isNull() & F.col("pos").isNotNull()
    keyed = first.withColumn("_rare", F.when(rest, F.col(on).cast("string")).otherwise(own))
    joined = keyed.join(tail, "_rare", "left")
    entry = F.when(
        F.col("pos").isNotNull(),
        F.struct("pos", F.coalesce("_head", "_tail", F.lit(default)).alias("value")),
    )
    grouped = joined.groupBy(id_col, "_entries", "_copies").agg(
        F.array_sort(F.collect_list(entry)).alias("_t")
    )
    each = grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(id_col, F.transform("_t", lambda e: e["value"]).alias("_mapped"))


LOOKUPS = ["batch", "join"]


def _looked_up(lookup: str) -> bool:
    if lookup not in LOOKUPS:
        raise ValueError(f"lookup must be one of {LOOKUPS}")
    return lookup == "batch"


def encode_text(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int = MAX_TOKENS,
    id_col: str = "post_id",
    col: str = "tweet",
    missing_text: str = "nan",
    lookup: str = "batch",
) -> DataFrame:
    """``id, input_ids, attention_mask`` with exactly ``max_len`` entries.

    ``[CLS] tokens [SEP]`` is cut to ``max_len`` with the specials kept, then padded;
    unknown tokens are ``[UNK]``. ``lookup`` is ``batch``, in Arrow batches without a
    shuffle, for a vocabulary that fits every task, or ``join``, for one of any size.
    Both give one row per row of ``df``, ids that repeat included.
    """
    text = PF.text_or_nan(F.col(col), missing_text)
    kept = F.slice(PF.tokens(text), 1, max_len - 2)
    words = df.select(id_col, kept.alias("_kept"))
    if _looked_up(lookup):
        ids = words.select(
            id_col, _map_entries("int", *_sent_vocab(vocab), UNK)("_kept").alias("_mapped")
        )
    else:
        ids = _join_entries(words, vocab, id_col, "_kept", "token", "id", UNK)
    used = F.size("_mapped") + 2
    return ids.select(
        id_col,
        F.concat(
            F.array(F.lit(CLS)),
            "_mapped",
            F.array(F.lit(SEP)),
            F.array_repeat(F.lit(PAD), F.lit(max_len) - used),
        ).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_len) - used)
        ).alias("attention_mask"),
    )


def decode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "post_id",
    col: str = "input_ids",
    lookup: str = "batch",
) -> DataFrame:
    """``id, tokens``: the token of each id, the empty string for an unknown id.

    ``lookup`` as in ``encode_text``.
    """
    if _looked_up(lookup):
        tokens, ids = _sent_vocab(vocab)
        return df.select(id_col, _map_entries("string", ids, tokens, "")(col).alias("tokens"))
    mapped = _join_entries(df.select(id_col, col), vocab, id_col, col, "id", "token", "")
    return mapped.withColumnRenamed("_mapped", "tokens")


def _term_stats(train: DataFrame, dims: int, col: str, min_count: int) -> tuple[list, int]:
    """The ``dims`` most frequent tokens with their document counts, and the documents.

    One pass over the texts: each gives its tokens, its distinct tokens, and one empty
    token, which no text contains, to count the texts themselves.
    """
    occurrence = F.transform("_t", lambda t: F.struct(t.alias("token"), F.lit(1).alias("n")))
    presence = F.transform(
        F.array_append(F.array_distinct("_t"), F.lit("")),
        lambda t: F.struct(t.alias("token"), F.lit(0).alias("n")),
    )
    entries = (
        train.filter(F.col(col).isNotNull())
        .select(PF.tokens(F.col(col)).alias("_t"))
        # No text is without an entry. Before an inner inline Spark filters by the size of the
        # array, for which it would take the tokens a second time.
        .select(F.inline_outer(F.concat(occurrence, presence)))
    )
    counted = entries.groupBy("token").agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("texts")
    )
    is_text = F.col("token") == ""
    rows = (
        counted.filter(is_text | (F.col("n") >= min_count))
        .orderBy(is_text.desc(), F.desc("n"), "token")
        .limit(dims + 1)
        .collect()
    )
    return rows[1:], rows[0]["texts"] if rows else 0


def fit_tfidf(
    train: DataFrame,
    dims: int,
    col: str = "tweet",
    min_count: int = 1,
    missing_text: str = "nan",
    out: str = "_tfidf",
) -> PipelineModel:
    """Fit term list and inverse document frequencies on the training texts.

    The ``dims`` most frequent tokens are the features, ties by token; a term's weight
    is ``log((texts + 1) / (texts with it + 1))``. Only the term list comes to the
    driver. The stages are tokens, counts and weights; they can be saved.
    """
    terms, texts = _term_stats(train, dims, col, min_count)
    if not terms:
        raise ValueError("no tokens in the training texts")
    blank = "nan" if missing_text == "nan" else ""
    words = SQLTransformer(
        statement=f"SELECT *, regexp_extract_all(lower(coalesce({col}, '{blank}')), "
        f"r'{PF.TOKEN_PATTERN}', 0) AS _words FROM __THIS__"
    )
    counts = CountVectorizerModel.from_vocabulary(
        [r["token"] for r in terms], inputCol="_words", outputCol="_counts", minTF=1.0
    )
    weights = Vectors.dense([math.log((texts + 1) / (r["texts"] + 1)) for r in terms])
    weigh = ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol=out)
    return PipelineModel(stages=[words, counts, weigh])


def tfidf_width(model: PipelineModel) -> int:
    return len(model.stages[1].vocabulary)


def _weighted(df: DataFrame, model: PipelineModel, keep: Sequence[str] | None) -> DataFrame:
    weighted = model.transform(df).drop("_words", "_counts")
    return weighted if keep is None else stored(weighted.select(*keep, "_tfidf"), "tfidf", ROWS_PER_FILE)


def tfidf_features(
    df: DataFrame, model: PipelineModel, out: str = "text_features", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the TF-IDF vector as array<double>.

    For rows that are read more than once ``keep`` names the columns that stay: the texts are then
    tokenized once and their sparse vectors stored; they are filled in as they are read.
    """
    return _weighted(df, model, keep).withColumn(out, vector_to_array("_tfidf")).drop("_tfidf")


def tfidf_terms(
    df: DataFrame, model: PipelineModel, out: str = "text_terms", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the TF-IDF vector as a struct of ``terms`` and ``values``: only the terms that occur, in any
    number of dimensions. ``keep`` as in ``tfidf_features``."""
    entries = F.unwrap_udt(F.col("_tfidf"))
    sparse = F.struct(entries["indices"].alias("terms"), entries["values"].alias("values"))
    return _weighted(df, model, keep).withColumn(out, sparse).drop("_tfidf")
