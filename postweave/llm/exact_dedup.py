"""Exact dedup: a Bloom filter of repeated hashes, then a shuffle of the rows it names.

Texts are equal when they are identical after removing space, tab, line feed, vertical
tab, form feed and carriage return. The first pass hashes every text and sets two bits in
one 64-bit word of a filter for hashes that may occur twice; the second pass looks every
row up in the broadcast filter. A row whose bits are not both set has no equal and passes
straight through; the others are grouped by their full SHA-256.

The filter has 16 bits a row up to ``max_words`` words of 64 bits; beyond that it fills up,
more rows take the shuffle, and the result stays the same. Its words number at most
``max_words`` (default 2**21, about 80 MB as a broadcast table), whatever the input.

Defined cases: a null text is an empty text, and all empty texts are equal to each other. A
null id ranks after all others. Rows with the winning id and length are the same document:
``exact_groups`` marks each of them kept, ``drop_copies`` returns one. Empty tables give
empty results. Input columns named like the working columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import SPACES, stored, text_of

MAX_WORDS = 1 << 21
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _rank(length: Column, id_col: Column) -> Column:
    """Larger is better: most code points, then the smallest id (bitwise not turns it)."""
    key = id_col.cast("long")
    return F.struct(length.alias("length"), key.isNotNull().alias("known"),
                    F.bitwise_not(key).alias("turned"))


def _address(digest: Column, words: int) -> tuple[Column, Column]:
    """(word, mask): the word of the filter, and the two bits a hash has in it."""
    h = F.xxhash64(digest)
    word = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1).cast("long"))
    one = F.lit(1).cast("long")
    bit = lambda shift: F.call_function(  # noqa: E731  the number of bits is a column
        "shiftleft", one, F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return word, bit(0).bitwiseOR(bit(6))


def repeated_filter(digests: DataFrame, words: int) -> DataFrame:
    """(_word, _bits): the bits that two or more rows set. ``digests`` has column _digest."""
    h = F.xxhash64("_digest")
    word = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1).cast("long"))
    low = F.lit(63).cast("long")
    bits = F.array_distinct(F.array(h.bitwiseAND(low), F.shiftrightunsigned(h, 6).bitwiseAND(low)))
    slots = digests.select(word.alias("_word"), F.explode(bits).alias("_bit"))
    twice = slots.groupBy("_word", "_bit").count().filter("count > 1")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit").cast("int"))
    return twice.groupBy("_word").agg(F.bit_or(mark).alias("_bits"))


def filter_words(rows: int, max_words: int = MAX_WORDS) -> int:
    """A power of two that gives 16 bits a row, within the bound."""
    words = 1
    while words * 4 < rows and words < max_words:
        words *= 2
    return words


def _tested(rows: DataFrame, filter_: DataFrame, words: int) -> DataFrame:
    """Rows with _possible: whether the filter allows a second row of the same hash."""
    word, mask = _address(F.col("_digest"), words)
    joined = (rows.withColumn("_word", word).withColumn("_mask", mask)
              .join(F.broadcast(filter_), "_word", "left"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return joined.withColumn("_possible", hit).drop("_word", "_mask", "_bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col)
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.char_length(text).alias("_length"),
                              _digest(text).alias("_digest")), "digests")
    words = filter_words(rows.count(), max_words)
    tested = _tested(rows, stored(repeated_filter(rows, words), "filter"), words)
    single = tested.filter("not _possible").select(
        "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"),
        F.lit(True).alias("_kept"), "_digest")

    # A hash may hold a third of the rows: combine in salted parts, join salted copies.
    maybe = tested.filter("_possible").withColumn(
        "_salt", F.pmod(F.xxhash64("_id", "_length"), F.lit(SALTS)).cast("int"))
    parts = maybe.groupBy("_digest", "_salt").agg(
        F.max(_rank(F.col("_length"), F.col("_id"))).alias("_best"), F.count("*").alias("_n"))
    groups = parts.groupBy("_digest").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_size"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = F.col("_best")
    keep = F.when(best["known"], F.bitwise_not(best["turned"]))
    grouped = maybe.join(copies, ["_digest", "_salt"]).select(
        "_id", keep.alias("_keep"), "_size",
        (_rank(F.col("_length"), F.col("_id")) == best).alias("_kept"), "_digest")
    return single.unionByName(grouped).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without the copies, with all their columns.

    Rows that the filter clears keep their place; of the others each task combines equal
    texts to one row before the shuffle, so that a hot text costs one row a task.
    """
    text = text_of(text_col)
    seen = stored(docs.select(_digest(text).alias("_digest")), "digests")
    words = filter_words(seen.count(), max_words)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
                       F.char_length(text).alias("_length"), _digest(text).alias("_digest"))
    tested = _tested(rows, stored(repeated_filter(seen, words), "filter"), words)
    clear = tested.filter("not _possible").select("_row.*")
    rank = _rank(F.col("_length"), F.col("_row")[id_col])
    kept = (tested.filter("_possible").groupBy("_digest")
            .agg(F.max_by("_row", rank).alias("_row")).select("_row.*"))
    return clear.unionByName(kept)
