"""Listings by tasks, bucketed tables, and length sketches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postweave.operators import sketches
from postweave.session import scratch_path
from postweave.sources import scan_media
from postweave.sources.buckets import open_bucketed, write_bucketed
from postweave.sources.media import _TreeReader, write_media


def test_listing_equals_an_inventory(spark, tmp_path):
    root = str(tmp_path / "tree")
    files = [(f"f{i % 4}/images", f"img{i}.{'jpg' if i % 3 else 'png'}", b"x" * i) for i in range(60)] + [("f9", "é ü.jpg", None)]
    table = spark.createDataFrame(files, "folder string, image string, content binary").repartition(3)
    assert sum(r.files for r in write_media(table, root).collect()) == 61
    (tmp_path / "tree" / "flat.jpg").write_bytes(b"123")
    (tmp_path / "tree" / "_hidden").mkdir()
    (tmp_path / "tree" / "_hidden" / "no.jpg").write_bytes(b"1")
    inventory = set()
    for where, _, names in os.walk(root):
        for name in names:
            full = os.path.join(where, name)
            below = os.path.relpath(full, root)
            if "_hidden" not in below:
                inventory.add((full, below.split("/")[0] if "/" in below else None, name, os.path.getsize(full)))
    assert {tuple(r) for r in scan_media(spark, root).collect()} == inventory
    # Spark's own listing leaves out files without bytes.
    assert {tuple(r) for r in scan_media(spark, root, by_tasks=False).collect()} == {r for r in inventory if r[3]}
    assert scan_media(spark, root, "*.png").count() == 20
    # The driver learns the directories, not the files.
    assert [p.folder for p in _TreeReader(root, "*").partitions()] == [None, "f0", "f1", "f2", "f3", "f9"]
    write_media(table, root).collect()  # a second write replaces the files
    assert scan_media(spark, root).count() == 62
    empty = tmp_path / "none"
    empty.mkdir()
    assert scan_media(spark, str(empty)).count() == 0


def test_buckets_join_without_a_shuffle(spark):
    path = scratch_path(spark, "buckets")
    name = path.rsplit("-", 1)[1]
    posts = spark.range(500).select((F.col("id") % 450).alias("post_id"), F.col("id").alias("n"))
    images = spark.range(0, 500, 2).select(F.col("id").alias("post_id"), F.array(F.col("id").cast("double")).alias("features"))
    left = write_bucketed(posts, f"a_{name}", f"{path}/a", "post_id", 4)
    write_bucketed(images, f"b_{name}", f"{path}/b", "post_id", 4)
    spark.sql(f"DROP TABLE b_{name}")  # as another session would find it
    right = open_bucketed(spark, f"b_{name}", f"{path}/b", "post_id bigint, features array<double>", "post_id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "post_id")
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        got = sorted(tuple(r) for r in joined.select("post_id", "n").collect())
        assert got == sorted(tuple(r) for r in posts.join(images, "post_id").select("post_id", "n").collect())
        assert "Exchange" in plan_of(posts.join(images, "post_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    again = write_bucketed(posts.limit(3), f"a_{name}", f"{path}/a", "post_id", 4)
    assert again.count() == 3


def test_sketches_are_updated_and_merged(spark):
    source, store = scratch_path(spark, "values"), scratch_path(spark, "sketches")
    rng = np.random.default_rng(3)
    assert sketches.describe_sketches(spark, store).first()["count"] == 0
    every, seen = [], 0
    for part in range(3):
        values = [(int(v), "train" if v % 3 else None) for v in rng.lognormal(5, 2, 20_000)] + [(None, "train")]
        every += values
        spark.createDataFrame(values, "x long, split string").repartition(2).write.mode("append").parquet(source)
        files = sketches.new_files(spark, source, store)
        assert len(files) == 2
        seen += sketches.update_sketches(spark, source, store, F.col("x"), F.col("split"))
        assert sketches.new_files(spark, source, store) == []
        assert sketches.update_sketches(spark, source, store, F.col("x"), F.col("split")) == 0
    assert seen == 6
    for splits, kept in [(None, lambda s: True), (["train"], lambda s: s == "train"), (["none"], lambda s: False)]:
        x = np.sort([v for v, s in every if v is not None and kept(s)])
        found = sketches.describe_sketches(spark, store, splits)
        assert source.rsplit("/", 1)[1] not in plan_of(found)  # only the store is read
        row = found.first()
        assert row["count"] == len(x)
        if len(x):
            assert (row["min"], row["max"]) == (x[0], x[-1])
            assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std(ddof=1))
            for share, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]:
                low, high = np.searchsorted(x, row[name], "left") / len(x), np.searchsorted(x, row[name], "right") / len(x)
                assert low - sketches.RANK_ERROR <= share <= high + sketches.RANK_ERROR
        else:
            assert row["q50"] is None and row["mean"] is None
