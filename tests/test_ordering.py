import hashlib
import math

import pytest
from pyspark.sql import functions as F

from postweave.operators import ordering


RANGE = 50


def numbers(spark, n=1000):
    """Keys in mixed order; a third of the rows share one ``hot`` value."""
    return spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("word"),
    )


def check_index(df, keys):
    rows = ordering.dense_index(df, keys, rows_per_range=RANGE).collect()
    ordered = sorted(rows, key=lambda r: [(r[k] is not None, r[k]) for k in keys])
    assert [r["row_idx"] for r in ordered] == list(range(len(rows)))


def test_index_small(spark):
    check_index(numbers(spark, 15), ["id"])


def test_index_by_ranges(spark):
    check_index(numbers(spark), ["id"])


def test_index_with_hot_first_key(spark):
    check_index(numbers(spark), ["word", "id"])


def test_index_with_missing_keys(spark):
    df = numbers(spark).withColumn("word", F.nullif("word", F.lit("hot")))
    check_index(df, ["word", "id"])


def test_hot_key_is_spread_over_ranges(spark):
    df = numbers(spark)
    found = ordering._ranges(df, ["word", "id"], 1000, RANGE)
    assert len(found.sizes) > 10 and max(found.sizes) < 250


def test_index_does_not_depend_on_partitions(spark):
    df = numbers(spark)
    one = ordering.dense_index(df.repartition(3), "id", rows_per_range=RANGE)
    other = ordering.dense_index(df.repartition(17, "word"), "id", rows_per_range=RANGE)
    assert one.exceptAll(other).count() == 0


def test_index_of_nothing(spark):
    assert ordering.dense_index(numbers(spark).limit(0), "id").count() == 0


@pytest.mark.parametrize("i", [0, 1, 499, 999])
def test_row_at(spark, i):
    rows = ordering.row_at(numbers(spark), i, "id", lookup_rows=RANGE).collect()
    assert [r["id"] for r in rows] == [i]


def test_row_past_the_end(spark):
    assert ordering.row_at(numbers(spark), 1000, "id").count() == 0
    assert ordering.row_at(numbers(spark, 2), 2, "id").count() == 0


@pytest.mark.parametrize("n", [0, 1, 700, 999, 1000, 5000])
def test_ordered_split(spark, n):
    rows = ordering.ordered_split(numbers(spark), n, "id", lookup_rows=RANGE).collect()
    assert {r["id"] for r in rows if r["split"] == "train"} == set(range(min(n, 1000)))


def test_ordered_split_does_not_shuffle_rows(spark):
    from conftest import plan_of

    df = numbers(spark)
    assert "Exchange" not in plan_of(ordering.ordered_split(df, 10, "id"))


def shuffle_order(ids, seed, epoch):
    def mix(i):
        return hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest(), i

    return {i: pos for pos, i in enumerate(sorted(ids, key=mix))}


def test_seeded_shuffle(spark):
    df = numbers(spark)
    for epoch in (1, 2):
        want = shuffle_order(range(1000), 50, epoch)
        for parts in (2, 13):
            rows = ordering.seeded_shuffle(
                df.repartition(parts), 50, epoch, "id", rows_per_range=RANGE
            ).collect()
            assert {r["id"]: r["shuffle_pos"] for r in rows} == want


def test_last_batch_is_short(spark):
    indexed = ordering.dense_index(numbers(spark, 25), "id")
    sizes = ordering.assign_batches(indexed, 12).groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in sizes} == {0: 12, 1: 12, 2: 1}


@pytest.mark.parametrize(
    "batch, iterations, epochs", [(128, 10_000, 274), (12, 30_000, 77), (28, 30_000, 180)]
)
def test_batch_plan(spark, batch, iterations, epochs):
    df = spark.range(4663).withColumn("split", F.lit("train"))
    row = ordering.batch_plan(df, batch, iterations).first()
    assert row["n_epochs"] == epochs and row["n_batches"] == math.ceil(4663 / batch)


@pytest.mark.parametrize("n", [100, 333, 334, 600])
def test_split_by_two_keys_with_missing_values(spark, n):
    df = numbers(spark).withColumn("word", F.nullif("word", F.lit("hot")))
    rows = ordering.ordered_split(df, n, ["word", "id"], lookup_rows=RANGE).collect()
    ordered = sorted(rows, key=lambda r: (r["word"] is not None, r["word"] or "", r["id"]))
    assert [r["split"] for r in ordered] == ["train"] * n + ["valid"] * (1000 - n)
    found = ordering.row_at(df, n, ["word", "id"], lookup_rows=RANGE).collect()
    assert [r["id"] for r in found] == [ordered[n]["id"]]


def test_split_by_share_rounds_down(spark):
    rows = ordering.share_split(numbers(spark, 19), (7, 10), "id").collect()
    assert {r["id"] for r in rows if r["split"] == "train"} == set(range(13))
    assert ordering.share_split(numbers(spark, 19).limit(0), (7, 10), "id").count() == 0


def test_equal_keys_are_refused_by_the_index_and_found_by_the_lookup(spark):
    same = spark.range(2000).select(F.lit(7).alias("k"))
    with pytest.raises(ValueError):
        ordering.dense_index(same, "k", rows_per_range=RANGE)
    assert ordering.key_at(same, 1500, "k", lookup_rows=RANGE)["k"] == 7
    nearly = same.union(spark.range(3).select((F.col("id") * 100).cast("int").alias("k")))
    found = [ordering.key_at(nearly, i, "k", lookup_rows=RANGE)["k"] for i in (0, 1, 1999, 2001, 2002)]
    assert found == [0, 7, 7, 100, 200]


@pytest.mark.parametrize("keys", [["id"], ["word", "id"]])
def test_index_by_tables(spark, monkeypatch, keys):
    monkeypatch.setattr(ordering, "LITERAL_RANGES", 3)
    monkeypatch.setattr(ordering, "RANGE_SALTS", 3)
    check_index(numbers(spark), keys)
    check_index(numbers(spark).withColumn("word", F.nullif("word", F.lit("hot"))), keys)
    same = ordering.dense_index(numbers(spark).repartition(13), keys, rows_per_range=RANGE)
    other = ordering.dense_index(numbers(spark).repartition(2), keys, rows_per_range=RANGE)
    assert same.exceptAll(other).count() == 0 and same.columns == ["id", "word", "row_idx"]


def test_index_by_tables_refuses_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LITERAL_RANGES", 3)
    equal = spark.range(4000).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError):
        ordering.dense_index(equal, "id", rows_per_range=50)


def test_many_ranges_leave_little_on_the_driver(spark, monkeypatch):
    """1e5 ranges: key rows that reach the driver, and the size of the plan."""
    monkeypatch.setattr(ordering, "MOST_PARTS", 8)
    seen, cut = [], ordering._boundaries

    def counted(df, keys, rows, ranges):
        seen.append(min(rows, ranges * ordering.SAMPLE_PER_RANGE))
        return cut(df, keys, rows, ranges)

    monkeypatch.setattr(ordering, "_boundaries", counted)
    df = spark.range(300_000).select(((F.col("id") * 7919) % 300_000).alias("id"))
    placed = ordering.dense_index(df, "id", rows_per_range=3)
    assert seen == [ordering.SAMPLE_PER_RANGE * 317]  # of 8 bytes each
    assert len(placed._jdf.queryExecution().executedPlan().toString()) < 1_000_000
    assert placed.filter("id <> row_idx").count() == 0 and placed.count() == 300_000
