import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.operators import vectors as vec

RNG = np.random.default_rng(1)
X = RNG.normal(size=(40, 6))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 3, i % 4 != 0, x.tolist()) for i, x in enumerate(X)]
    return spark.createDataFrame(data, "post_id int, k int, used boolean, features array<double>")


def matrix(df, col):
    return np.array([r[col] for r in df.orderBy("post_id").collect()])


def test_erf(spark):
    points = np.concatenate([np.linspace(-7, 7, 281), [0.46875, -0.46875, 4.0, 1e-9]])
    df = spark.createDataFrame([(float(p),) for p in points], "x double")
    got = [r["e"] for r in df.select(PF.erf(F.col("x")).alias("e")).collect()]
    assert got == pytest.approx([math.erf(p) for p in points], abs=1e-15, rel=1e-14)


def test_standardize(rows):
    fitted = vec.fit_standardizer(rows.filter("post_id < 20"))
    got = matrix(vec.standardize_by(rows, fitted), "features")
    assert got == pytest.approx((X - X[:20].mean(0)) / X[:20].std(0))
    flat = matrix(vec.standardize(rows, [1.0] * 6, [0.0] * 6), "features")
    assert flat == pytest.approx(X - 1)


def test_augment(spark, rows):
    split = rows.withColumn("split", F.when(F.col("post_id") < 30, "train").otherwise("test"))
    got = vec.augment_train(split, copies=3, jitter=0.2, seed=7).collect()
    assert len(got) == 30 * 3 + 10
    turned = 0
    for r in got:
        x = X[r["post_id"]]
        if r["split"] == "test":
            assert r["copy_no"] == 0 and r["features"] == x.tolist()
            continue
        y = np.array(r["features"])
        forward, backward = y / x, y / x[::-1]
        back = np.ptp(backward) < np.ptp(forward)
        turned += back
        scale = (backward if back else forward)
        assert np.ptp(scale) < 1e-9 and 0.8 <= scale[0] < 1.2
    assert 20 < turned < 70
    again = vec.augment_train(split.repartition(7), copies=3, jitter=0.2, seed=7)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mean_pool(rows):
    for mask, keep in [(None, np.ones(40, bool)), ("used", np.arange(40) % 4 != 0)]:
        df = rows if mask is None else rows.withColumn("used", F.col("used").cast("int"))
        got = {r["k"]: r["features"] for r in vec.mean_pool(df, "k", "features", mask).collect()}
        for k in range(3):
            part = X[(np.arange(40) % 3 == k) & keep]
            assert got[k] == pytest.approx(part.mean(0).tolist())


def test_mean_pool_without_unmasked_rows(spark):
    df = spark.createDataFrame(
        [(1, 0, [1.0, 2.0]), (2, 1, [3.0, 4.0])], "k int, m int, v array<double>"
    )
    got = {r["k"]: r["v"] for r in vec.mean_pool(df, "k", "v", "m").collect()}
    assert got == {1: None, 2: [3.0, 4.0]}


def test_first_pool(rows):
    got = {r["k"]: r["features"] for r in vec.first_pool(rows, "k", "post_id", "features").collect()}
    assert got == {k: X[k].tolist() for k in range(3)}
    placed = rows.withColumn("pos", F.floor(F.col("post_id") / 3))
    known = vec.first_pool(placed, "k", "pos", "features", position=0).collect()
    assert {r["k"]: r["features"] for r in known} == got


@pytest.mark.parametrize("batches", [False, True])
def test_projection_in_jvm_and_in_arrow_batches(spark, rows, batches):
    weights, bias = RNG.normal(size=(4, 6)), RNG.normal(size=4)
    got = matrix(vec.linear_project(rows, weights, bias, batches=batches), "projected")
    assert got == pytest.approx(X @ weights.T + bias)
    missing = spark.createDataFrame(
        [(1, None), (2, [1.0] * 6), (3, [1.0] * 5 + [None]), (4, [1.0] * 5), (5, [1.0] * 7), (6, [])],
        "post_id int, features array<double>",
    )
    rows = vec.linear_project(missing, weights, batches=batches).orderBy("post_id").collect()
    first, second, *odd = rows
    assert [r["projected"] for r in [first, *odd]] == [None] * 5
    assert second["projected"] == pytest.approx(weights.sum(1).tolist())


def test_activations(rows):
    assert matrix(vec.activate(rows, "relu"), "activated") == pytest.approx(np.maximum(X, 0))
    phi = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    assert matrix(vec.activate(rows, "gelu"), "activated") == pytest.approx(X * phi(X))
    with pytest.raises(ValueError):
        vec.activate(rows, "tanh")


def test_softmax_of_large_entries(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "v array<double>")
    row = df.select(PF.softmax(F.col("v")).alias("p"), PF.log_sum_exp(F.col("v")).alias("l")).first()
    assert row["p"] == pytest.approx([0.5, 0.5, 0.0]) and row["l"] == pytest.approx(1000 + math.log(2))
