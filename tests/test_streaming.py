from pyspark.sql import functions as F

from postweave.operators import evaluate
from postweave.streaming import score_stream, stream_confusion


def test_stream_equals_batch_and_continues(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") % 3).cast("int").alias("label"),
        F.array((F.col("id") % 5).cast("double"), F.lit(2.0)).alias("logits"),
    )
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def score(df):
        return df.select("label", (F.get("logits", 0) < F.get("logits", 1)).cast("int").alias("prediction"))

    def run():
        stream = score_stream(spark, source, rows.schema, score, files_per_batch=2)
        stream_confusion(stream, out, state).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    first = rows.filter("label < 2").repartition(5)
    first.write.parquet(source)
    assert run() == sorted(map(tuple, evaluate.confusion_counts(score(first)).collect()))
    rows.filter("label = 2").repartition(3).write.mode("append").parquet(source)
    assert run() == sorted(map(tuple, evaluate.confusion_counts(score(rows)).collect()))
    assert run() == sorted(map(tuple, evaluate.confusion_counts(score(rows)).collect()))


def test_query_reads_the_table_as_a_file_or_a_folder(spark, tmp_path):
    from postweave.plans import catalog

    rows = spark.range(60).select(
        F.col("id").alias("vec_id"),
        (F.col("id") % 10).cast("int").alias("label"),
        F.array([F.sin(F.col("id") * k + k).cast("float") for k in range(1, 65)]).alias("embedding"),
    )
    many, one = tmp_path / "many", tmp_path / "one"
    rows.repartition(4).write.parquet(str(many / "embeddings.parquet"))
    rows.limit(0).write.parquet(str(many / "embeddings-2.parquet"))
    one.mkdir()
    rows.toPandas().to_parquet(one / "embeddings.parquet")
    found = [sorted(map(tuple, catalog.stream_scores(spark, str(d)).collect())) for d in (many, one)]
    assert found[0] == found[1] == sorted(map(tuple, catalog.write_result_tables(spark, str(many)).collect()))
    assert sum(n for _, _, n in found[0]) == 60
