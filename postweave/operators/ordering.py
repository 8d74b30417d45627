"""Row positions: dense index, row lookup, ordered split, seeded shuffle, batches.

Spark rows have no order, so an order key is always given; it should be unique.
A table is cut into key ranges of about ``rows_per_range`` rows by fixed boundary rows
taken from a sample; a small table is one range. The range of a row depends on its key
and the boundaries only, not on how a stage was partitioned, so a stage that is run
again numbers its rows alike. Rows of equal keys cannot be told apart by ranges: where
they fill a range far beyond its size, the operators ask for a further key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from postweave.functions import bind, seeded_hash
from postweave.session import stored

ROWS_PER_RANGE = 1_000_000
SAMPLE_PER_RANGE = 20
#: A range may hold so many times the rows it should before equal keys are refused.
MOST_UNEVEN = 20
#: Boundaries that a plan holds as constants; more ranges than that are found by way of tables.
LITERAL_RANGES = 1_000
#: Tasks that ranges found by tables are dealt to at most; a task takes several of them one by one.
MOST_PARTS = 20_000
#: Parts that the rows of a coarse range are dealt to while they look up their range.
RANGE_SALTS = 16
#: Ranges that one lookup of a key cuts what is left into.
LOOKUP_RANGES = 100
#: Key rows among which a lookup picks its own; only these reach the driver.
LOOKUP_ROWS = 10_000

_RANGE = "_key_range"


@dataclass
class _Ranges:
    """Key ranges of a table: the range of a row, and where each range starts."""

    of_row: Column
    starts: list[int]
    sizes: list[int]


def _key_list(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(k) for k in keys])


def _before(keys: Sequence[str], row: Row) -> Column:
    """Whether the row's key comes before ``row``; NULL comes first.

    Spelled out per column, so that the scan sees comparisons with constants.
    """
    key, rest = keys[0], keys[1:]
    bound = row[key]
    below = F.lit(False) if bound is None else F.col(key).isNull() | (F.col(key) < bound)
    if not rest:
        return below
    return below | (F.col(key).eqNullSafe(bound) & _before(rest, row))


def _row_literal(df: DataFrame, keys: Sequence[str], row: Row) -> Column:
    """A constant struct with the column types of the keys."""
    return F.struct(*[F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys])


def _boundaries(df: DataFrame, keys: Sequence[str], rows: int, ranges: int) -> list[Row]:
    """About ``ranges - 1`` key rows that cut the table evenly.

    Only balance depends on the sample, so it need not be the same every time. It
    holds about 20 key rows per range, of which a plan has at most ``LITERAL_RANGES``.
    """
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    sample = df.select(*keys).sample(fraction, seed=17).orderBy(*keys).collect()
    step = max(1, len(sample) // ranges)
    cuts = sample[step::step]
    return [r for i, r in enumerate(cuts) if i == 0 or r != cuts[i - 1]]


def _range_by_search(df: DataFrame, keys: Sequence[str], cuts: Sequence[Row]) -> Column:
    """How many boundary rows are at or below the key: a binary search by halving steps."""
    if not cuts:
        return F.lit(0)
    if len(keys) == 1:
        # Missing keys all fall before the first boundary: no comparison with them holds.
        known = [r for r in cuts if r[keys[0]] is not None]
        kind, key = df.schema[keys[0]].dataType, F.col(keys[0])
        table = F.array(*[F.lit(r[keys[0]]).cast(kind) for r in known])
    else:
        known, key = list(cuts), _key_struct(keys)
        table = F.array(*[_row_literal(df, keys, r) for r in known])
    largest = 1 << (len(known).bit_length() - 1) if known else 0
    steps = F.array(*[F.lit(largest >> k) for k in range(largest.bit_length())])

    def search(value: Column) -> Column:
        def advance(found: Column, step: Column) -> Column:
            # Past the end of the table the boundary is NULL, and the step is not taken.
            return F.when(F.get(table, found + step - 1) <= value, found + step).otherwise(found)

        return F.aggregate(steps, F.lit(0), advance)

    return bind(key, search) if known else F.lit(0)


def _sizes(df: DataFrame, of_row: Column) -> list[int]:
    """Rows per range; one number per range reaches the driver."""
    found = {r[_RANGE]: r["count"] for r in df.groupBy(of_row.alias(_RANGE)).count().collect()}
    return [found.get(i, 0) for i in range(max(found, default=0) + 1)]


def _ranges(
    df: DataFrame,
    keys: Sequence[str],
    rows: int,
    rows_per_range: int,
    spread: Callable[[int], Column] | None = None,
) -> _Ranges:
    count = max(1, math.ceil(rows / rows_per_range))
    if count == 1:
        return _Ranges(F.lit(0), [0], [rows])
    if spread is not None:
        of_row = spread(count)
    else:
        of_row = _range_by_search(df, keys, _boundaries(df, keys, rows, count))
    sizes = _sizes(df, of_row)
    if max(sizes) > MOST_UNEVEN * rows_per_range:
        raise ValueError("too many rows with equal order keys; add a key that tells them apart")
    starts = [0] * len(sizes)
    for i in range(1, len(sizes)):
        starts[i] = starts[i - 1] + sizes[i - 1]
    return _Ranges(of_row, starts, sizes)


def _search_steps(size: int) -> Column:
    """Halving steps for a table of at most ``size`` entries."""
    largest = 1 << (size.bit_length() - 1) if size else 0
    return F.array(*[F.lit(largest >> k) for k in range(largest.bit_length())])


def _found_in(table: Column, steps: Column, value: Column) -> Column:
    """How many entries of a sorted array are at or below the value."""

    def advance(found: Column, step: Column) -> Column:
        return F.when(F.get(table, found + step - 1) <= value, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), advance)


def _ranged_by_tables(df: DataFrame, keys: Sequence[str], rows: int, rows_per_range: int) -> DataFrame:
    """``_coarse`` and ``_key_range`` of each row, for any number of ranges.

    Coarse boundaries, about the root of the number of ranges, are constants; the boundaries within a
    coarse range come from its part of a sample, as one row per coarse range, and rows meet them in a
    shuffled join. Neither the boundaries nor the sample pass through the driver."""
    ranges = math.ceil(rows / rows_per_range)
    count = math.ceil(math.sqrt(ranges))
    key = _key_struct(keys)
    coarse = _range_by_search(df, keys, _boundaries(df, keys, rows, count))
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    sample = df.select(*keys).sample(fraction, seed=19).select(coarse.alias("_coarse"), key.alias("_key"))
    in_order = Window.partitionBy("_coarse").orderBy("_key")
    cuts = sample.withColumn("_place", F.row_number().over(in_order)).filter(F.col("_place") % SAMPLE_PER_RANGE == 0)
    tables = cuts.groupBy("_coarse").agg(F.sort_array(F.collect_set("_key")).alias("_cuts"))  # about ``count`` keys
    most = stored(tables, "cuts")
    longest = most.agg(F.max(F.size("_cuts"))).first()[0] or 0
    copies = most.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RANGE_SALTS - 1))))
    salted = df.withColumn("_coarse", coarse).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(RANGE_SALTS)).cast("int"))
    joined = salted.join(copies.hint("shuffle_hash"), ["_coarse", "_salt"], "left")
    fine = F.coalesce(bind(key, lambda k: _found_in(F.col("_cuts"), _search_steps(longest), k)), F.lit(0))
    of_row = F.col("_coarse").cast("long") * (longest + 1) + fine
    return joined.withColumn(_RANGE, of_row).drop("_cuts", "_salt")


def _index_by_tables(df: DataFrame, keys: Sequence[str], out: str, rows: int, rows_per_range: int) -> DataFrame:
    """Positions for any number of ranges: offsets are a table, summed within coarse ranges and over them."""
    ranged = _ranged_by_tables(df, keys, rows, rows_per_range)
    sizes = stored(ranged.groupBy("_coarse", _RANGE).agg(F.count("*").alias("_n")), "range-sizes")
    if sizes.agg(F.max("_n")).first()[0] > MOST_UNEVEN * rows_per_range:
        raise ValueError("too many rows with equal order keys; add a key that tells them apart")
    earlier = Window.unboundedPreceding, -1
    whole = sizes.groupBy("_coarse").agg(F.sum("_n").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_coarse").rowsBetween(*earlier)), F.lit(0))
    tops = whole.select("_coarse", above.alias("_above"))  # one row per coarse range
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_coarse").orderBy(_RANGE).rowsBetween(*earlier)), F.lit(0))
    starts = sizes.withColumn("_within", within).join(tops, "_coarse").select(
        _RANGE, (F.col("_above") + F.col("_within")).alias("_start"))
    starts = stored(starts, "range-starts")
    parts = min(math.ceil(rows / rows_per_range), MOST_PARTS)
    order = Window.partitionBy(_RANGE).orderBy(*keys)
    placed = ranged.drop("_coarse").repartition(parts, F.col(_RANGE)).withColumn("_place", F.row_number().over(order))
    joined = placed.join(starts.hint("shuffle_hash"), _RANGE)
    return joined.withColumn(out, F.col("_start") + F.col("_place") - 1).select(*df.columns, out)


def dense_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    out: str = "row_idx",
    spread: Callable[[int], Column] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the 0-based position of each row in key order.

    ``spread`` may give the range of a row without a sample, for keys whose
    distribution is known (it must grow with the key).
    """
    keys, rows = _key_list(order_by), df.count()
    if spread is None and rows > rows_per_range * LITERAL_RANGES:
        return _index_by_tables(df, keys, out, rows, rows_per_range)
    ranges = _ranges(df, keys, rows, rows_per_range, spread)
    starts = F.expr("array(" + ",".join(f"{s}L" for s in ranges.starts) + ")")
    order = Window.partitionBy(_RANGE).orderBy(*keys)
    return (
        df.withColumn(_RANGE, ranges.of_row)
        .repartitionById(len(ranges.starts), F.col(_RANGE))
        .withColumn(out, F.get(starts, F.col(_RANGE)) + F.row_number().over(order) - 1)
        .drop(_RANGE)
    )


def key_at(
    df: DataFrame,
    i: int,
    order_by: str | Sequence[str],
    rows: int | None = None,
    lookup_rows: int = LOOKUP_ROWS,
) -> Row | None:
    """The order key of the row at position ``i``; None past the end.

    The range that holds the position is cut again and again, until it has at most
    ``lookup_rows`` rows or one key only; nothing larger is sorted. ``rows`` saves
    counting the table where its row count is known.
    """
    keys = _key_list(order_by)
    if i < 0:
        raise ValueError("position must not be negative")
    inside = df.select(*keys)
    rows = inside.count() if rows is None else rows
    if i >= rows:
        return None
    while rows > lookup_rows:
        cuts = _boundaries(inside, keys, rows, LOOKUP_RANGES)
        ends = inside.agg(F.min(_key_struct(keys)).alias("low"), F.max(_key_struct(keys)).alias("high")).first()
        if ends["low"] == ends["high"]:
            return ends["low"]
        if not cuts or cuts == [ends["low"]]:
            cuts = [ends["high"]]  # the sample saw one key; the last one splits for certain
        of_row = _range_by_search(inside, keys, cuts)
        sizes, hit = _sizes(inside, of_row), 0
        while i >= sizes[hit]:
            i -= sizes[hit]
            hit += 1
        if sizes[hit] == rows:  # the sample missed the other keys again
            of_row = _range_by_search(inside, keys, [ends["high"]])
            sizes, hit = _sizes(inside, of_row), 0
            if i >= sizes[0]:
                i, hit = i - sizes[0], 1
        inside, rows = inside.filter(of_row == hit), sizes[hit]
    return inside.orderBy(*keys).limit(i + 1).offset(i).collect()[0]


def row_at(
    df: DataFrame, i: int, order_by: str | Sequence[str], lookup_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """The row at position ``i`` in key order."""
    keys = _key_list(order_by)
    key = key_at(df, i, keys, lookup_rows=lookup_rows)
    if key is None:
        return df.limit(0)
    return df.filter(reduce(and_, [F.col(k).eqNullSafe(key[k]) for k in keys]))


def ordered_split(
    df: DataFrame,
    n: int,
    order_by: str | Sequence[str],
    out: str = "split",
    rows: int | None = None,
    lookup_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """First ``n`` rows in key order are ``train``, the others ``valid``.

    The key at position ``n`` is looked up first; the rows are then only compared
    with it, without a shuffle.
    """
    keys = _key_list(order_by)
    # The lookup reads the keys several times: what they come from is computed once.
    return _split_before(df, key_at(stored(df.select(*keys), "order-keys"), n, keys, rows, lookup_rows), keys, out)


def _split_before(df: DataFrame, cut: Row | None, keys: Sequence[str], out: str) -> DataFrame:
    if cut is None:
        return df.withColumn(out, F.lit("train"))
    return df.withColumn(
        out, F.when(_before(keys, cut), F.lit("train")).otherwise(F.lit("valid"))
    )


def share_split(
    df: DataFrame,
    parts: tuple[int, int],
    order_by: str | Sequence[str],
    out: str = "split",
    lookup_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """``ordered_split`` at a share of the rows, such as ``(7, 10)``, rounded down."""
    keys = _key_list(order_by)
    placed = stored(df.select(*keys), "order-keys")
    rows = placed.count()
    cut = key_at(placed, rows * parts[0] // parts[1], keys, rows, lookup_rows)
    return _split_before(df, cut, keys, out)


def seeded_shuffle(
    df: DataFrame,
    seed: int,
    epoch: int,
    id_col: str,
    out: str = "shuffle_pos",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add each row's position in a reproducible random order of the epoch."""
    mixed = df.withColumn("_mix", seeded_hash(seed, F.lit(epoch), F.col(id_col)))

    def spread(ranges: int) -> Column:
        head = F.conv(F.substring("_mix", 1, 8), 16, 10).cast("bigint")
        return F.floor(head * F.lit(ranges) / F.lit(2**32)).cast("int")

    return dense_index(mixed, ["_mix", id_col], out, spread, rows_per_range).drop("_mix")


def assign_batches(
    df: DataFrame, batch_size: int, index: str = "row_idx", out: str = "batch_id"
) -> DataFrame:
    """Batch number of each indexed row; the last batch may be short."""
    return df.withColumn(out, F.floor(F.col(index) / F.lit(batch_size)).cast("bigint"))


def batch_plan(
    df: DataFrame, batch_size: int, iterations: int, split_col: str = "split"
) -> DataFrame:
    """Rows, batches and epochs of an iteration budget for each split."""
    return (
        df.groupBy(split_col)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("n_batches", F.ceil(F.col("n_rows") / batch_size).cast("bigint"))
        .withColumn(
            "n_epochs",
            F.floor(F.lit(iterations) / (F.col("n_rows") / F.lit(batch_size))).cast("bigint"),
        )
    )
