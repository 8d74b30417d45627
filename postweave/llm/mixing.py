"""Mixing sources to target weights out of fixed-length token blocks.

Each source's words, in a fixed order of its documents, are packed into blocks of
``block_words`` words. The mix has so many slots, each for one block. The slots of a source are
dealt to the output shards by a multinomial of equal shares under the source's own generator. So
the counts of the sources in a shard are, given the shard's size, multinomial by their targets, shards
look alike, and the totals meet the targets to a block. A source numbers its slots across
the shards; slot j takes the block that a pseudorandom permutation of the block indices, one
for each pass over the source, gives for j. Blocks and slots are then joined by index.
No block is used more often than its source is passed over, at most three times.

Targets: the sources in code-point order, null last, weigh 1, 2, 3, 1, ...; they share the size
of the corpus by weight. A target above three times its source's size stops there and the
excess goes to the others by weight, until none is above.

Sources are a table like any other, of any number of rows: their order, targets and draws are Spark
jobs, and the driver sees sums over all sources only. Everything is seeded, and no order depends on the
partitioning, so reruns agree.

Defined cases: null or empty texts have size 0 and take nothing; a source without words has target
0. Documents are ordered by a hash chunk, then id, size and text hash. Rows that repeat id, source and text
are counted to one row before they are placed and numbered after, so they are separate documents with the same
text and no hot key; a null id is an id like any other. Of rows that share id and text but differ elsewhere,
``mix_documents`` returns the columns of one, chosen by their values. A text of any length is one run of
blocks. Columns of the input named like the working columns are untouched. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.common import WORD, broadcast_by_size, broadcast_within, stored, text_of
from postweave.operators.ordering import dense_index

BLOCK_WORDS = 128
SHARDS = 256
MOST_PASSES = 3
CHUNK_ROWS = 5_000
SALTS = 16
RUN_ROWS = 10_000
BROADCAST_BYTES = 64 << 20


def sizes_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: dict | None = None, most: int = MOST_PASSES) -> DataFrame:
    """(_source, _index, _source_size, _target) of a table (_source, _source_size): the sum of the sizes
    shared by weight, none above ``most`` times its size.
    A source that ``weights`` does not name weighs 0. Each round is one sum over the sources."""
    name = F.col("_source").cast("string")
    ranked = dense_index(sources.withColumn("_none", name.isNull()).withColumn("_name", F.coalesce(name, F.lit(""))),
                         ["_none", "_name"], "_index")
    if weights:
        spark, kind = sources.sparkSession, dict(sources.dtypes)["_source"]
        given = spark.createDataFrame(list(weights.items()), f"_given {kind}, _weight double")
        ranked = ranked.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left")
        ranked = ranked.withColumn("_weight", F.coalesce("_weight", F.lit(0.0)))
    else:
        ranked = ranked.withColumn("_weight", (1 + F.col("_index") % 3).cast("double"))
    table = stored(ranked.select("_source", "_index", "_source_size", "_weight"), "weights")

    first = table.agg(F.sum("_source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    total, rest, share, stopped = float(first["size"] or 0), float(first["size"] or 0), first["weight"] or 1.0, 0
    most_of = (most * F.col("_source_size")).cast("double")
    while True:
        due = F.lit(rest) * F.col("_weight") / F.lit(share)
        over = due > most_of
        now = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most_of)).alias("size"),
                        F.sum(F.when(~over, F.col("_weight"))).alias("weight")).first()
        if now["n"] <= stopped or not now["weight"]:
            return table.select("_source", "_index", "_source_size", F.least(due, most_of).alias("_target"))
        stopped, rest, share = now["n"], total - now["size"], now["weight"]


def slot_count(size: int, target: float, block_words: int, most: int = MOST_PASSES) -> int:
    """Slots of a source: whole passes over its blocks, and the rest to the nearest block."""
    if not size:
        return 0
    blocks, passes = -(-size // block_words), int(target // size)
    rest = round((target - passes * size) / size * blocks)
    return min(passes * blocks + rest, most * blocks)


def draw_shards(count: int, shards: int, seed: int, index: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first slot) of a source in each shard."""
    drawn = np.random.default_rng([seed, index]).multinomial(count, np.full(shards, 1 / shards))
    return drawn, np.cumsum(drawn) - drawn


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 by key: a Feistel network on the next even number
    of bits, walked until it falls into the range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right, k = out[todo] >> half, out[todo] & mask, key[todo]
        for turn in range(4):
            left, right = right, left ^ (_mix64(right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Mix:
    """The plan of a mix over documents: sizes, targets, places and slots.

    ``rows`` has one row per document: _id, _hash, _size, _index (of its source), _offset (of its
    first word in the source); ``pieces`` one per document and block; ``slots`` one per slot.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                 text_col: str = "text", block_words: int = BLOCK_WORDS, shards: int = SHARDS,
                 weights: dict | None = None, seed: int = 0) -> None:
        self.spark, self.block_words, self.shards, self.seed = docs.sparkSession, block_words, shards, seed
        text = text_of(text_col)
        sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                            sizes_of(text).alias("_size"), F.xxhash64(text).alias("_hash"))
        sized = stored(sized.groupBy("_id", "_source", "_size", "_hash").agg(F.count("*").alias("_n")), "sizes")
        sources = sized.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size"))
        self.sources = stored(source_targets(stored(sources, "sources"), weights), "targets")
        self._place(sized)

    def _with_source(self, sized: DataFrame) -> DataFrame:
        """Each row with its source's numbers; where the sources are too many to broadcast, by a salted join."""
        salt = F.pmod(F.xxhash64("_id", "_hash"), F.lit(SALTS)).cast("int")
        small = broadcast_by_size(self.sources.withColumnRenamed("_source", "_named").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), BROADCAST_BYTES)
        return (sized.withColumn("_salt", salt)
                .join(small, F.col("_source").eqNullSafe(F.col("_named")) & (F.col("_salt") == F.col("_part")))
                .drop("_source", "_named", "_salt", "_part"))

    def _place(self, sized: DataFrame) -> None:
        """Running sums within hash chunks of a source, then over the chunks' totals."""
        chunks = max(1, -(-sized.count() // CHUNK_ROWS))
        keyed = self._with_source(sized).withColumn(
            "_chunk", F.pmod(F.xxhash64("_id", "_hash"), F.lit(chunks)).cast("int"))
        words = F.col("_size") * F.col("_n")
        totals = keyed.groupBy("_index", "_chunk").agg(F.sum(words).alias("_total"))
        before = F.sum("_total").over(Window.partitionBy("_index").orderBy("_chunk")) - F.col("_total")
        starts = stored(totals.select("_index", "_chunk", before.alias("_before")), "chunks")
        inside = Window.partitionBy("_index", "_chunk").orderBy("_id", "_size", "_hash").rowsBetween(
            Window.unboundedPreceding, 0)
        placed = keyed.withColumn("_inside", F.sum(words).over(inside) - words)
        placed = placed.join(broadcast_within(starts, 60, BROADCAST_BYTES), ["_index", "_chunk"])
        # Equal rows one after the other, in runs so that no list of them grows with their number.
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN_ROWS)))
        last = F.least(F.lit(RUN_ROWS - 1).cast("long"), F.col("_n") - 1 - F.col("_run") * RUN_ROWS)
        placed = placed.withColumn("_run", runs).withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        nth = F.col("_run") * RUN_ROWS + F.col("_nth")
        self.rows = placed.withColumn("_offset", F.col("_before") + F.col("_inside") + nth * F.col("_size")).drop(
            "_chunk", "_inside", "_before", "_n", "_run", "_nth")

    @property
    def pieces(self) -> DataFrame:
        """The words that a document has in each block: _block, _start (in the document), _words."""
        n = self.block_words
        first, end = F.col("_offset"), F.col("_offset") + F.col("_size")
        block = F.explode(F.sequence(F.floor(first / n), F.floor((end - 1) / n)))
        low = F.greatest(first, F.col("_block") * n)
        return (self.rows.filter("_size > 0").withColumn("_block", block)
                .withColumn("_start", low - first)
                .withColumn("_words", F.least(end, (F.col("_block") + 1) * n) - low))

    @property
    def slots(self) -> DataFrame:
        """One row per slot of the mix: _shard, _index, _slot, _block."""
        n, shards, seed = self.block_words, self.shards, self.seed

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for index, size, target in frame.itertuples(index=False):
                    count, first = draw_shards(slot_count(size, target, n), shards, seed, index)
                    yield pd.DataFrame({"shard": np.arange(shards), "source": index, "first": first, "count": count,
                                        "blocks": -(-size // n)})[count > 0]

        def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard, source, first, count, blocks in frame.itertuples(index=False):
                    for at in range(first, first + count, 1 << 16):
                        slot = np.arange(at, min(at + (1 << 16), first + count), dtype=np.int64)
                        passes = slot // blocks
                        key = _mix64(passes.astype(np.uint64) + np.uint64((seed << 20) + (source << 2) + 1))
                        yield pd.DataFrame({"_shard": shard, "_index": source, "_slot": slot,
                                            "_block": permuted(slot % blocks, blocks, key)})

        drawn = self.sources.select("_index", "_source_size", "_target").mapInPandas(
            draw, "shard int, source long, first long, count long, blocks long")
        spread = drawn.repartition(self.spark.sparkContext.defaultParallelism, "shard", "source")
        return spread.mapInPandas(expand, "_shard int, _index long, _slot long, _block long")

    def uses(self) -> DataFrame:
        """Pieces of documents with _uses: how often the mix takes each."""
        counts = self.slots.groupBy("_index", "_block").agg(F.count("*").alias("_uses"))
        return self.pieces.join(counts, ["_index", "_block"], "left").withColumn(
            "_uses", F.coalesce("_uses", F.lit(0)))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    mix = Mix(docs, id_col, **options)
    keys = ["_index", "_offset", "_id", "_size", "_source_size", "_target"]
    taken = mix.uses().groupBy(keys).agg(F.sum(F.col("_words") * F.col("_uses")).cast("long").alias("taken"))
    empty = mix.rows.filter("_size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), "taken")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: one row per slot and piece: shard, slot, block, id, start, words."""
    mix = Mix(docs, id_col, **options)
    return mix.slots.join(mix.pieces, ["_index", "_block"]).select(
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_block").alias("block"),
        F.col("_id").alias(id_col), F.col("_start").alias("start"), F.col("_words").alias("words"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with all their columns: one row for each time that any part of
    a document is taken. A row's text is what that pass takes, white space after words included;
    it is the whole text where the pass takes all. Documents that are not taken go."""
    mix = Mix(docs, id_col, source_col, text_col, **options)
    spans = mix.uses().filter("_uses > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_uses").cast("int"))))
    copies = spans.groupBy("_index", "_offset", "_id", "_hash", "_size", "_copy").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_start").alias("at"), F.col("_words").alias("n")))).alias("_spans"),
        F.sum("_words").alias("_taken"))
    text = text_of(text_col)
    row = F.struct(*[F.col(c) for c in docs.columns])
    values = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if c != text_col and "map<" not in kind])
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), row.alias("_row"), values.alias("_values"))
    held = held.groupBy("_id", "_hash").agg(F.min_by("_row", "_values").alias("_row"))  # rows that repeat a document
    joined = copies.join(held, copies["_id"].eqNullSafe(held["_id"]) & (copies["_hash"] == held["_hash"]))
    words = F.regexp_extract_all(F.col("_row")[text_col], F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), 0)
    cut = F.array_join(F.transform("_spans", lambda s: F.array_join(
        F.slice(F.col("_pieces"), s["at"].cast("int") + 1, s["n"].cast("int")), "")), "")
    whole = F.col("_taken") == F.col("_size")
    rows = joined.select("_row", "_spans", "_taken", "_size", F.when(~whole, words).alias("_pieces"))
    rows = rows.withColumn("_text", F.when(whole, F.col("_row")[text_col]).otherwise(cut))

    def column(name: str) -> Column:
        old = F.col("_row")[name]
        if name == text_col:
            return F.col("_text").alias(name)
        if name == chars_col:
            return F.when(whole, old).otherwise(F.char_length("_text").cast(dict(docs.dtypes)[name])).alias(name)
        return old.alias(name)

    return rows.select(*[column(c) for c in docs.columns])
