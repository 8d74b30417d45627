"""Registered queries of stored layouts: media files, bucketed tables, length sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators import fusion, sketches
from postweave.plans import tables as T
from postweave.plans.catalog import CLEAN, _long, _r, query
from postweave.session import scratch_path
from postweave.sources import scan_media
from postweave.sources.buckets import write_bucketed
from postweave.sources.media import write_media

BUCKETS = 8


@query(
    """SELECT concat('class', label, '/img_', vec_id, '.jpg') AS place, concat('class', label) AS folder,
    concat('img_', vec_id, '.jpg') AS image, (vec_id * 37) % 1009 AS length FROM embeddings"""
)
def scan_media_inventory(spark, folder):
    """A file for every vector, written by tasks, and what the listing by tasks finds."""
    root = scratch_path(spark, "media")
    name = F.concat(F.lit("img_"), F.col("vec_id"), F.lit(".jpg"))
    files = T.table(spark, folder, "embeddings").select(
        F.concat(F.lit("class"), F.col("label")).alias("folder"), name.alias("image"),
        F.encode(F.repeat(F.lit("x"), (F.col("vec_id") * 37 % 1009).cast("int")), "UTF-8").alias("content"))
    write_media(files, root).collect()
    found = scan_media(spark, root, "*.jpg")
    return found.select(F.replace("path", F.lit(root + "/"), F.lit("")).alias("place"), "folder", "image", "length")


@query(
    f"""{CLEAN} SELECT c.post_id, c.label, CAST(unnest(range(len(embedding))) AS INT) AS pos,
    round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM clean c JOIN embeddings ON vec_id = c.post_id"""
)
def align_bucketed(spark, folder):
    """Posts and their image features, joined bucket by bucket."""
    posts = T.clean_posts(spark, folder).select("post_id", "label")
    images = T.post_images(spark, folder)
    path = scratch_path(spark, "buckets")
    name = path.rsplit("-", 1)[1]
    left = write_bucketed(posts, f"posts_{name}", f"{path}/posts", "post_id", BUCKETS)
    right = write_bucketed(images, f"images_{name}", f"{path}/images", "post_id", BUCKETS)
    return _long(fusion.align_modalities(left, right), ["post_id", "label"], "features")


@query(
    f"""{CLEAN}, n AS (SELECT split, length(tweet) AS x FROM split_posts)
    SELECT split, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x)::DOUBLE AS min,
    max(x)::DOUBLE AS max, true AS q25_within, true AS q50_within, true AS q75_within FROM n GROUP BY split"""
)
def describe_sketched_lengths(spark, folder):
    """Lengths described from stored sketches, which were filled in two goes; whether each quartile's
    rank is within the sketch's bound."""
    source, store = scratch_path(spark, "lengths"), scratch_path(spark, "sketches")
    posts = T.split_posts(spark, folder).select("split", "tweet")
    value, split = F.length("tweet"), F.col("split")
    half = F.pmod(F.xxhash64("tweet"), F.lit(2)) == 0
    posts.filter(half).write.parquet(source)
    sketches.update_sketches(spark, source, store, value, split)
    posts.filter(~half).write.mode("append").parquet(source)
    sketches.update_sketches(spark, source, store, value, split)
    lengths = spark.read.parquet(source).select("split", value.alias("x"))
    out = None
    for name in ["train", "valid"]:
        found = sketches.describe_sketches(spark, store, [name])
        near = lengths.filter(F.col("split") == name).crossJoin(F.broadcast(found.select("q25", "q50", "q75")))  # one row
        ranks = near.agg(*[F.avg((F.col("x") <= F.col(q)).cast("int")).alias(f"{q}_to") for q in ["q25", "q50", "q75"]],
                         *[F.avg((F.col("x") < F.col(q)).cast("int")).alias(f"{q}_from") for q in ["q25", "q50", "q75"]])
        within = [((F.col(f"{q}_from") <= share + sketches.RANK_ERROR) & (F.col(f"{q}_to") >= share - sketches.RANK_ERROR)).alias(f"{q}_within")
                  for q, share in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]]
        row = found.crossJoin(ranks).select(F.lit(name).alias("split"), "count", _r("mean", "mean"), _r("std", "std"), "min", "max", *within)
        out = row if out is None else out.union(row)
    return out
