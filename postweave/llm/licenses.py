"""Licence scans over a positional rare-token index.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. The notices
(``notices.NOTICES``, or a list of the caller) are the index: postings of (word, notice, position).

One pass over the texts stores, per file, the places of the words that any notice has. From these
the number of files with each word is counted. A notice is probed by its words of highest
IDF, the rarer half of them and at most ``PROBES``; no word is dropped for being common, so a
notice is found however many files carry it. Each place of a probed word in a file votes
for the relative positions (place minus posting) at which that word stands in a notice. The share
of a notice's probed positions that agree on one relative position must reach ``min_share``;
positions that the file lacks count against it. A notice of 16 words or more may have words
inserted or left out: its votes are counted in overlapping windows of one relative position, and
one more for every 16 words. Last, the notice's key phrases must stand word for word at relative positions of
the window. A file is searched for all notices, however many it holds.

Base phrases are found as such, wherever their words stand consecutively.

``score`` is the best share among the notices found, at least 0.5 where a base phrase stands, else 0.

Votes are grouped by file, notice and window, so no licence and no word, however common, gathers in
one task. The driver holds one count per word of the notices. Defined cases: a null text has no words; a
long text is one row of words, but its votes are rows of their own; a notice that stands many times is
one label; of equal rare words the first in code-point order is probed; repeated rows and null
ids are files like any other; empty tables give empty results, and other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import ascii_lower, broadcast_by_size, stored, text_of
from postweave.llm.notices import NOTICES, Notice

# Phrases and labels of the query's contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

PROBES = 16
MOST_BITS = 63
MIN_SHARE = 0.5
SLACK_WORDS = 16
BROADCAST_BYTES = 64 << 20


def plain(text: Column) -> Column:
    """The words of a text in lower case, one space around each."""
    words = F.regexp_replace(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    trimmed = F.trim(words)
    return F.when(trimmed == "", " ").otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def words_of(plain_text: Column) -> Column:
    trimmed = F.trim(plain_text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def vocabulary(notices: Sequence[Notice] = NOTICES) -> list[str]:
    return sorted({w for n in notices for w in n.words})


def _phrase_places(words: Column, plain_text: Column, phrase: str) -> Column:
    """Positions at which the words of a phrase stand one after the other."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [
        F.get(words, i + F.lit(k)) == part for k, part in enumerate(parts)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(F.contains(plain_text, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def places_of(docs: DataFrame, id_col: str, text_col: str, notices: Sequence[Notice]) -> DataFrame:
    """One stored row per file: _row (a number of its own), _id, n_words, _base (label and places of each
    base phrase) and _hits, the places of the notices' words."""
    rows = docs.select(F.col(id_col).alias("_id"), plain(text_of(text_col)).alias("_plain"))
    rows = rows.select("_id", "_plain", words_of(F.col("_plain")).alias("_words"))
    words, text = F.col("_words"), F.col("_plain")
    per_phrase = F.array(*[F.struct(_phrase_places(words, text, phrase).alias("at"), F.lit(label).alias("label"))
                           for phrase, label in BASE_PHRASES.items()])
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))),
                    lambda h: h["word"].isin(*vocabulary(notices)))
    return stored(rows.select(
        F.monotonically_increasing_id().alias("_row"), "_id", F.size(words).cast("long").alias("n_words"),
        F.filter(per_phrase, lambda p: F.size(p["at"]) > 0).alias("_base"), hits.alias("_hits")), "places")


def word_weights(files: DataFrame, notices: Sequence[Notice] = NOTICES) -> dict[str, float]:
    """Inverse document frequency of the notices' words over all files."""
    found = F.array_distinct(F.transform("_hits", lambda h: h["word"]))
    counts = files.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}
    total = df.get("", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary(notices)}


def probes_of(notice: Notice, weights: dict[str, float]) -> list[int]:
    """The positions at which a notice is probed: those of its words of highest IDF."""
    words = notice.words
    ranked = sorted(set(words), key=lambda w: (-weights[w], w))
    at: list[int] = []
    for word in ranked[:min(PROBES, max(2, -(-len(ranked) // 2)))]:
        more = [i for i, w in enumerate(words) if w == word]
        if len(at) + len(more) > MOST_BITS:
            break
        at += more
    return sorted(at)


def window_of(notice: Notice) -> int:
    """How many neighbouring relative positions count as one."""
    return 1 + len(notice.words) // SLACK_WORDS


def _postings(docs: DataFrame, notices: Sequence[Notice], phrases: list[list[list[int]]]) -> DataFrame:
    """(word, notice, phrase, position, bit, width) of the given sets of positions of each notice."""
    rows = [(n.words[p], i, k, p, 1 << bit, window_of(n)) for i, (n, sets) in enumerate(zip(notices, phrases))
            for k, at in enumerate(sets) for bit, p in enumerate(at)]
    return docs.sparkSession.createDataFrame(
        rows, "word string, notice int, phrase int, position int, bit long, width int")


def _relative(files: DataFrame, postings: DataFrame) -> DataFrame:
    """One row per place of a posted word and posting of it: _row, notice, phrase, offset, bit, width."""
    hits = files.select("_row", F.explode("_hits").alias("_hit")).select("_row", "_hit.word", "_hit.place")
    return hits.join(F.broadcast(postings), "word").select(
        "_row", "notice", "phrase", (F.col("place") - F.col("position")).alias("offset"), "bit", "width")


def _windows(offsets: DataFrame) -> DataFrame:
    """The windows that each offset falls into, as phase and window: two that overlap by half, or
    one where a window is a single offset."""
    phase = F.explode(F.when(F.col("width") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    shift = F.when(F.col("phase") == 1, F.floor((F.col("width") + 1) / 2)).otherwise(0)
    return offsets.withColumn("phase", phase).withColumn(
        "window", F.floor((F.col("offset") + shift) / F.col("width"))).drop("offset", "width")


def find_notices(files: DataFrame, notices: Sequence[Notice] = NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """(_row, notice, share): the best share of each notice found in a file of ``places_of``."""
    weights = word_weights(files, notices)
    probes = [probes_of(n, weights) for n in notices]
    probed = sorted({n.words[p] for n, at in zip(notices, probes) for p in at})
    rare = F.filter("_hits", lambda h: h["word"].isin(*probed))
    votes = _windows(_relative(files.select("_row", rare.alias("_hits")), _postings(files, notices, [[at] for at in probes])))
    keys = ["_row", "notice", "phase", "window"]
    sizes = F.element_at(F.array(*[F.lit(len(at)) for at in probes]), F.col("notice") + 1)
    agreed = (votes.groupBy(keys).agg(F.bit_count(F.bit_or("bit")).alias("votes")).filter("votes >= 2")
              .withColumn("share", F.col("votes") / sizes).filter(F.col("share") >= min_share).drop("votes"))
    agreed = stored(agreed, "agreed")

    # Every key phrase, word for word, at an offset of an agreed window.
    phrases = [n.phrases for n in notices]
    some = broadcast_by_size(stored(agreed.select("_row").distinct(), "candidates"), BROADCAST_BYTES)
    lengths = F.array(*[F.array(*[F.lit(len(at)) for at in sets]) for sets in phrases])
    stand = (_relative(files.select("_row", "_hits").join(some, "_row", "leftsemi"), _postings(files, notices, phrases))
             .groupBy("_row", "notice", "phrase", "offset", "width").agg(F.bit_count(F.bit_or("bit")).alias("n"))
             .filter(F.col("n") == F.get(F.get(lengths, F.col("notice")), F.col("phrase"))))
    known = (_windows(stand).groupBy(keys).agg(F.count_distinct("phrase").alias("n"))
             .filter(F.col("n") == F.size(F.get(lengths, F.col("notice")))))
    return agreed.join(known, keys, "leftsemi").groupBy("_row", "notice").agg(F.max("share").alias("share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_share: float = MIN_SHARE, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    files = places_of(docs, id_col, text_col, notices)
    names = F.element_at(F.array(*[F.lit(n.label) for n in notices]), F.col("notice") + 1)
    found = stored(find_notices(files, notices, min_share).groupBy("_row").agg(
        F.max("share").alias("_share"), F.collect_set(names).alias("_added")), "found")

    rows = files.select("_row", "_id", "n_words", "_base").join(broadcast_by_size(found, BROADCAST_BYTES), "_row", "left")
    rows = rows.withColumn("_places", F.flatten(F.transform("_base", lambda p: p["at"])))
    base = F.transform("_base", lambda p: p["label"])
    added = F.coalesce("_added", F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce("_share", F.lit(0.0))
    score = F.when(F.size("_places") > 0, F.greatest(share, F.lit(0.5))).otherwise(share)
    return rows.select(
        F.col("_id").alias(id_col), "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, added)).alias("labels"), score.alias("score"))
