"""Quality rules with cross-document line frequency.

Two verdicts meet. The base rules look at one document: too few words, or too many words in
three-word windows that the text repeats. The cross-document rule hashes normalised lines
(A-Z lower-cased, white space removed; digits stay as they are), counts the documents of a host
that contain each, and removes lines above the host's limit: more than ``max_share`` of its
documents and more than ``min_docs``. A frequent line stays in one document, its home. A document
that keeps less than ``min_left`` of its characters is depleted and rejected.

``score_quality`` follows the SQL of its query: the home is the smallest id of all documents with
the line, which may itself be rejected. ``filter_quality`` takes the smallest id of those that
pass the base rules and keeps every home, depleted or not, so that each frequent line of a document
that passes them stands in one document of its result.

A line above the limit takes more than a fixed share of a host's documents, so a host has at most
1 / max_share times as many of them as its documents have lines on average. They come to each
document as one list per host, by a broadcast of checked size or else by a join on the host.

Defined cases: a null text has no words and is rejected by the base rules; a null host is a host
of its own; empty lines never count. Rows with a null id are judged like the rest, and a frequent
line whose documents all lack an id stays. Repeated rows are separate documents. Empty
tables give empty results. ``score_quality`` returns its own columns only; ``filter_quality``
returns the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import SPACES, ascii_lower, broadcast_within, stored, text_of

SYMBOLS = "#*$%&|<>"
BROADCAST_BYTES = 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(ascii_lower(F.translate(line, SPACES, "")))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first included.

    Equal windows become neighbours when hashes are sorted with their places; the places of
    those, in order, cover so many words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - width)
    one = F.lit(1)

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.coalesce(
            F.least(F.lit(width), F.get(places, k + one) - p), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of_sorted(ranked: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ranked, k)["g"] == x["g"], F.lit(False))
        marked = F.transform(ranked, lambda x, k: F.when(same(x, k - one) | same(x, k + one), x["i"]))
        return let(F.array_sort(F.array_compact(marked)), covered)

    def of_windows(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ranked, of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(width)]))
        return let(windows, of_windows)

    return F.when(F.size(words) < width, 0).otherwise(let(hashes, of_hashes)).cast("long")


def base_fails(n: Column, repeated: Column) -> Column:
    """The base rules, from the words of a text and those in repeated windows."""
    return (n < 50) | (100 * repeated > 50 * n)


def frequent_lines(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text",
                   max_share: float = 0.01, min_docs: int = 20, passing_home: bool = False) -> DataFrame:
    """One row per host that has any: _host, _frequent: array of (line, home). With ``passing_home``
    only documents that pass the base rules can be a home."""
    lines = F.array_distinct(F.transform(lines_of(text_of(text_col)), line_hash))
    home = F.col(id_col).cast("long")
    if passing_home:
        failed = let(words_of(text_of(text_col)), lambda words: base_fails(F.size(words), repeated_words(words)))
        home = F.when(~failed, home)
    keyed = docs.select(F.xxhash64(F.col(host_col)).alias("_host"), home.alias("_id"), lines.alias("_lines"))
    sizes = keyed.groupBy("_host").agg(F.count("*").alias("_docs"))
    counted = (keyed.select("_host", "_id", F.explode("_lines").alias("_line"))
               .groupBy("_host", "_line").agg(F.count("*").alias("_n"), F.min("_id").alias("_home"))
               .filter(F.col("_n") > min_docs))
    over = counted.join(sizes, "_host").filter(F.col("_n") > F.col("_docs") * max_share)
    return over.groupBy("_host").agg(F.collect_list(
        F.struct(F.col("_line").alias("line"), F.col("_home").alias("home"))).alias("_frequent"))


def _with_lines(docs: DataFrame, host_col: str, id_col: str, text_col: str, max_share: float,
                min_docs: int, passing_home: bool = False) -> DataFrame:
    """Documents with _text, _removed: hashes of the lines to remove from each, and _is_home: whether
    the document is the home of any."""
    frequent = stored(frequent_lines(docs, host_col, id_col, text_col, max_share, min_docs, passing_home), "lines")
    longest = frequent.agg(F.max(F.size("_frequent"))).first()[0] or 0
    joined = docs.withColumn("_host", F.xxhash64(F.col(host_col))).join(
        broadcast_within(frequent, 40 + 32 * longest, BROADCAST_BYTES), "_host", "left")
    others = F.filter("_frequent", lambda f: ~f["home"].eqNullSafe(F.col(id_col).cast("long")) & f["home"].isNotNull())
    removed = F.coalesce(F.transform(others, lambda f: f["line"]), F.array().cast("array<bigint>"))
    own = F.exists("_frequent", lambda f: f["home"].eqNullSafe(F.col(id_col).cast("long")) & f["home"].isNotNull())
    return joined.withColumn("_text", text_of(text_col)).withColumn("_removed", removed).withColumn(
        "_is_home", F.coalesce(own, F.lit(False))).drop("_host", "_frequent")


def _measures(rows: DataFrame, min_left: float) -> DataFrame:
    """Adds n_words ... base_failed and kept, computed from _text and _removed."""
    text = F.col("_text")
    rows = rows.withColumn("_words", words_of(text)).withColumn("_lines", lines_of(text))
    gone = F.filter("_lines", lambda line: F.array_contains("_removed", line_hash(line)))
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda a, line: a + F.char_length(
        F.translate(line, SPACES, "")))
    # Most documents share no frequent line; the lines are hashed once more only where one exists.
    lost = F.when(F.size("_removed") == 0, 0).otherwise(chars(gone))
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "lost_chars": lost.cast("long")})
        .withColumn("base_failed", base_fails(n, repeated))
        .withColumn("kept", ~F.col("base_failed") & (
            F.col("word_chars") - F.col("lost_chars") >= min_left * F.col("word_chars"))))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]


def score_quality(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                  max_share: float = 0.01, min_docs: int = 20, min_left: float = 0.5) -> DataFrame:
    """One row per document: id and COLUMNS."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_from"), F.col(text_col).alias("_raw"))
    rows = _with_lines(slim, "_from", "_id", "_raw", max_share, min_docs)
    return _measures(rows, min_left).select(F.col("_id").alias(id_col), *COLUMNS)


def filter_quality(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                   chars_col: str | None = "n_chars", max_share: float = 0.01, min_docs: int = 20,
                   min_left: float = 0.5) -> DataFrame:
    """The documents that are kept, without their frequent lines, and with all their columns.
    Homes of frequent lines are chosen among documents that pass the base rules, and are kept;
    ``chars_col``, if the table has it, is counted anew for texts that lost lines."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_from"), F.col(text_col).alias("_raw"), row)
    rows = _measures(_with_lines(slim, "_from", "_id", "_raw", max_share, min_docs, passing_home=True), min_left)
    rows = rows.filter(F.col("kept") | (~F.col("base_failed") & F.col("_is_home")))
    cleaned = F.when(F.col("lost_chars") == 0, F.col("_raw")).otherwise(F.array_join(
        F.filter(F.split("_text", "\n"), lambda line: (F.btrim(line, F.lit(SPACES)) == "")
                 | ~F.array_contains("_removed", line_hash(line))), "\n"))
    rows = rows.withColumn("_clean", cleaned)
    changed = F.col("lost_chars") > 0

    def column(name: str) -> Column:
        old = F.col("_row")[name]
        if name == text_col:
            return F.col("_clean").alias(name)
        if name == chars_col:
            kind = dict(docs.dtypes)[name]
            return F.when(changed, F.char_length("_clean").cast(kind)).otherwise(old).alias(name)
        return old.alias(name)

    return rows.select(*[column(c) for c in docs.columns])
