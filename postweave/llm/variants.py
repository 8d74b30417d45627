"""Spelling variants: words one edit apart, found by a frontier that walks a relational trie.

Trie. A node is a prefix of some word, named by its 64-bit hash; kept are the root, prefixes that end a word and
prefixes with several continuations. An edge leads from a kept node to the next one and carries the letters between
them, so the number of levels is that of the forks along a word and not its length. The edge table is
distributed and has one row per edge: level, node, label, child, the word that ends at the child, the
first letters that go on from there, and how many letters words have left at least and at most.

Frontier. States are (word, position, node, edits). Level by level they are joined with the edges of their node. A
state without an edit may match the label, or spend its edit in it: replace a letter, take one more from the label
or pass over one of its own. A state with an edit must match. Insertions and deletions in a run of equal letters are taken at
the run's end only, so every neighbour is reached on one path. A state goes on only if the child has an edge with its
next letter and words of a fitting length. A state with one edit at the end of its word and at the end of another one is a pair of neighbours.

Upper levels have few edges, which are broadcast within a checked size; deeper ones are shuffled by node.

Groups. A word's form is its most frequent neighbour, if that is ``ratio`` times as frequent; its root is where the
forms lead to. Counts grow by the ratio with each step, so chains are short; they are followed by doubling.

Defined cases: null and empty texts have no words; repeated rows count as often as they stand; words of any length
take part; a word without neighbours has no form and is its own root; empty tables give empty results. Ties between forms go to
the smallest word in code-point order. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import broadcast_by_size, stored

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
BROADCAST_BYTES = 48 << 20
SALTS = 8
WORDS_PER_PART = 20_000
ROOT = 0


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of a column ``word`` with one row per occurrence."""
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _salted_join(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of unique keys of which some may match a large part of the rows."""
    copies = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    turn = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", turn).join(broadcast_by_size(copies, BROADCAST_BYTES), [key, "_salt"]).drop("_salt")


def trie_edges(words: DataFrame) -> DataFrame:
    """level, node, label, child, ends (the word that ends at the child, or null), nexts (first letters
    that go on from the child)."""
    named = words.select("word", F.xxhash64("word").alias("_id"), F.xxhash64(F.lit(1), "word").alias("_id2"))
    prefixes = named.select("_id", "_id2", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda d: F.struct(
            d.alias("depth"), F.xxhash64(F.substr("word", F.lit(1), d)).alias("node"),
            F.substr("word", d + 1, F.lit(1)).alias("next")))).alias("_p")).select("_id", "_id2", "_p.*")
    kept = prefixes.groupBy("node").agg(F.min("next").alias("_a"), F.max("next").alias("_b"))
    kept = stored(kept.filter("_a = '' or _a <> _b").select("node"), "trie-nodes")
    paths = _salted_join(prefixes.drop("next"), kept, "node").groupBy("_id", "_id2").agg(
        F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    at = lambda i, field, none: F.when(i == 0, F.lit(none)).otherwise(
        F.get(F.col("path"), i - 1)[field])
    steps = paths.join(named, ["_id", "_id2"]).select("word", F.explode(F.transform("path", lambda x, i: F.struct(
        i.alias("level"), at(i, "node", ROOT).alias("node"), at(i, "depth", 0).alias("start"),
        x["depth"].alias("end"), x["node"].alias("child")))).alias("_s")).select("word", "_s.*")
    steps = steps.withColumn("label", F.substr("word", F.col("start") + 1, F.col("end") - F.col("start")))
    left = F.length("word") - F.col("end")
    edges = steps.groupBy("level", "node", "label", "child").agg(
        F.max(F.when(left == 0, F.col("word"))).alias("ends"), F.min(left).alias("least"), F.max(left).alias("most"))
    edges = stored(edges, "trie-steps")
    following = edges.groupBy(F.col("node").alias("child")).agg(
        F.concat_ws("", F.collect_set(F.substring("label", 1, 1))).alias("nexts"))
    return edges.join(following, "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit(""))).withColumn(
        "first", F.substring("label", 1, 1))


def _agreement(head: Column, label: Column) -> Column:
    """How many letters two texts have in common at the start."""
    same = F.zip_with(F.split(head, ""), F.split(label, ""), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False).cast("int")
    return F.when(head == "", 0).when(first == 0, F.length(label)).otherwise(first - 1)


def _letter(k: int) -> Column:
    """The letter of the word that is k places after the position; empty past the end."""
    return F.substr("word", F.col("pos") + 1 + k, F.lit(1))


def _moved(joined: DataFrame, to: Column, edits: Column) -> DataFrame:
    """The states at the child with which a neighbour can still be reached, and those that have reached one."""
    moved = joined.select("word", to.cast("int").alias("pos"), F.col("child").alias("node"), edits.cast("int").alias("edits"),
                          "ends", "nexts", "least", "most")
    left, slack = F.length("word") - F.col("pos"), 1 - F.col("edits")
    moved = moved.filter((left >= 0) & left.between(F.col("least") - slack, F.col("most") + slack))
    found = (F.col("edits") == 1) & (left == 0) & F.col("ends").isNotNull()
    goes_on = F.when(F.col("edits") == 0, F.col("nexts") != "").otherwise((left > 0) & F.contains(F.col("nexts"), _letter(0)))
    return moved.filter(found | goes_on).select("word", "pos", "node", "edits", F.when(found, F.col("ends")).alias("ends"))


def marked_edges(edges: DataFrame) -> DataFrame:
    """The edges with a column ``mark``, one row for each way in which a state finds an edge of its node.

    ``=`` and the first letter of the label; for labels of one letter ``>`` and each letter that goes on from the
    child, or nothing more where a word ends there; ``*`` for longer labels, which an edit may fall into."""
    onward = F.transform(F.filter(F.split("nexts", ""), lambda c: c != ""), lambda c: F.concat(F.lit(">"), c))
    onward = F.when(F.col("ends").isNull(), onward).otherwise(F.array_append(onward, F.lit(">")))
    marks = F.when(F.length("label") == 1, onward).otherwise(F.array(F.lit("*")))
    return edges.withColumn("mark", F.explode(F.array_append(marks, F.concat(F.lit("="), "first"))))


def _advance(states: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """The states after one more edge: word, pos, node, edits, ends (where they have reached a neighbour).

    ``edges`` are marked. All moves that the letters of the word decide are one equi-join: a state asks for a mark
    for each move it may make. Where the label has one letter, as near the root, those are all: the letter after
    the edit must go on from the child. ``small``: the edges may be broadcast."""
    side = F.broadcast if small else lambda df: df
    zero, one = F.lit(0), F.lit(1)
    size, pos, left = F.length("label"), F.col("pos"), F.length("word") - F.col("pos")

    def ask(move: int, kind: str, letter: Column) -> Column:
        return F.struct(F.lit(move).alias("move"), F.concat(F.lit(kind), letter).alias("mark"))

    meet, last, replace, take, over = range(5)
    r0, r1 = _letter(0), _letter(1)
    own = ask(meet, "=", r0)
    asks = F.when(F.col("edits") == 0, F.array(own, ask(last, "=", r0), ask(replace, ">", r1), ask(take, ">", r0), ask(over, "=", r1)))
    asking = states.select("word", "pos", "node", "edits", F.explode(asks.otherwise(F.array(own))).alias("_ask"))
    asking = asking.select("word", "pos", "node", "edits", "_ask.*")
    met = asking.join(side(edges.filter("mark <> '*'")), ["node", "mark"])
    # The label as it is; with an edit left, also without the word's last letter.
    whole = (size == 1) | (F.substr("word", pos + 1, size) == F.col("label"))
    move, other = F.col("move"), F.col("label") != r0
    # One letter replaced, taken or passed over. Past the end of the word there is nothing to replace.
    met = met.filter(F.when(move == meet, whole).when(move == last, (left == size + 1) & whole)
                     .when(move == replace, (left >= 1) & other).when(move == take, other)
                     .otherwise((size == 1) & (left >= 2) & (r0 != r1)))
    to = F.when(move == meet, size).when(move == last, size + 1).when(move == replace, 1).when(move == take, 0).otherwise(2)
    out = _moved(met, pos + to, F.when(move == meet, F.col("edits")).otherwise(one))

    # An edit within a longer label: the letters at its first two places tell most pairs apart.
    fresh = states.filter("edits = 0").select("word", "pos", "node", r0.alias("r0"), r1.alias("r1"), left.alias("left"))
    left = F.col("left")
    long = edges.filter("mark = '*'").withColumn("second", F.substring("label", 2, 1))
    pairs = fresh.join(side(long), "node")
    near = (F.col("first") == F.col("r0")) | (F.col("second") == F.col("r1")) | (F.col("second") == F.col("r0")) | (F.col("first") == F.col("r1"))
    fits = (left - size).between(F.col("least") - 1, F.col("most") + 1)
    pairs = pairs.filter(near & fits & (size <= left + 1))
    pairs = pairs.withColumn("size", size).withColumn("head", F.substr("word", pos + 1, size + 1))
    pairs = pairs.withColumn("same", _agreement(F.expr("left(head, size)"), F.col("label")))
    size, same = F.col("size"), F.col("same")

    def text(col: str, start: Column, count: Column) -> Column:
        return F.substr(col, start, F.greatest(count, zero))

    free = same < size
    rest = text("label", same + 2, size - same - 1)  # of the label, after the letter that differs
    changed = [
        (free & (left >= size) & (text("head", same + 2, size - same - 1) == rest), pos + size),
        (free & (left >= size - 1) & (text("head", same + 1, size - same - 1) == rest), pos + size - 1),
        (free & (left > size) & (text("head", same + 2, size - same) == text("label", same + 1, size - same)), pos + size + 1)]
    ends = F.array_compact(F.array(*[F.when(when, to.cast("int")) for when, to in changed]))
    return out.union(_moved(pairs.withColumn("_to", F.explode(ends)), F.col("_to"), one))


def _parts(words: DataFrame) -> int:
    """Tasks that the frontier's work is dealt to, by the number of words."""
    return max(words.sparkSession.sparkContext.defaultParallelism, words.count() // WORDS_PER_PART)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): ordered pairs of words that differ by one inserted, deleted or replaced code point.

    A level unites two joins, each with as many tasks as the last level left files. Without a bound tasks and
    files grow from level to level, and with them what the driver holds of each."""
    words, parts = words.select("word"), _parts(words)
    edges = stored(marked_edges(trie_edges(words)).coalesce(parts), "trie-edges")
    width = F.lit(100) + F.octet_length("label") + F.octet_length("nexts") + F.coalesce(F.octet_length("ends"), F.lit(0))
    sizes = dict(edges.groupBy("level").agg(F.sum(width.cast("long"))).collect())  # one row per level
    states = words.select("word", F.lit(0).alias("pos"), F.lit(ROOT).cast("long").alias("node"), F.lit(0).alias("edits"))
    pairs = states.select("word", F.lit(None).cast("string").alias("ends")).limit(0)
    for level in sorted(sizes):
        here = edges.filter(F.col("level") == level).drop("level")
        ahead = _advance(states, here, sizes[level] <= BROADCAST_BYTES)
        states = stored(ahead.coalesce(parts), f"frontier{level}")
        pairs = pairs.union(states.filter("ends is not null").select("word", "ends"))
        states = states.filter("ends is null")
    # Names of nodes are hashes: the pair itself is checked, too.
    return pairs.filter(F.levenshtein("word", "ends", 1) == 1).select("word", F.col("ends").alias("near")).distinct()


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) with one row per word."""
    words = stored(words.select("word", "n"), "counted")
    # The frontier's work is spread by word, however few files the counts came in.
    words = stored(words.repartition(_parts(words), "word"), "words")
    links = stored(neighbours(words), "neighbours")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("_m"))
    best = links.join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_m")).alias("m"), "near")).alias("_best"))
    most = -F.col("_best.m")
    takes = most >= ratio * F.col("n")
    graded = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("_best.near")).alias("form"), F.when(takes, most).alias("form_n")), "forms")
    roots, left = graded.filter("form is not null").select("word", F.col("form").alias("root")), 1
    while left:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        left = roots.filter("_next is not null").limit(1).count()
        roots = roots.drop("_next")
    return graded.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
