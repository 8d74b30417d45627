import numpy as np
import pandas as pd
import pytest

from postweave.operators import stats


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_split_sizes_and_class_counts(spark):
    rows = [("train", 1), ("train", 1), ("train", None), ("valid", 2)]
    df = frame(spark, rows, "split string, label int")
    sizes = {r["split"]: r["n_rows"] for r in stats.split_sizes(df).collect()}
    assert sizes == {"train": 3, "valid": 1, "all": 4}
    counts = [tuple(r) for r in stats.class_counts(df).collect()]
    assert counts == [("train", 1, 2), ("valid", 2, 1)]


def test_class_weights(spark):
    df = frame(spark, [(0,)] * 4 + [(1,)] * 2 + [(5,)] + [(None,)], "label int")
    weights = {r["label"]: r["weight"] for r in stats.class_weights(df).collect()}
    raw = np.array([1 / 4, 1 / 2, 1])
    assert weights == pytest.approx(dict(zip([0, 1, 5], raw / raw.sum())))
    assert sum(weights.values()) == pytest.approx(1)


def test_length_counts_code_points(spark):
    df = frame(spark, [("\U0001f525é",), ("",), (None,)], "tweet string")
    assert [r["tweet_length"] for r in stats.text_length(df).collect()] == [2, 0, None]


def test_describe_matches_pandas(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = frame(spark, [(v,) for v in values], "tweet_length bigint")
    want = pd.Series(values).describe()
    got = stats.describe_lengths(df).first()
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    assert [got[n] for n in names] == pytest.approx(list(want))
    rough = stats.describe_lengths(df, approx=True).first()
    assert rough["q50"] in values


@pytest.mark.parametrize("values", [list(range(101)), [1, 2, 2, 3, 50, 51], [7, 7, 7], [0, 1]])
@pytest.mark.parametrize("bins", [1, 5, 50])
def test_histogram_matches_numpy(spark, values, bins):
    df = frame(spark, [(v,) for v in values] + [(None,)], "tweet_length bigint")
    rows = stats.length_histogram(df, bins=bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n_rows"] for r in rows] == counts.tolist()
    assert [r["from_edge"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert [r["to_edge"] for r in rows] == pytest.approx(edges[1:].tolist())


def test_epoch_loss_counts_a_short_batch_fully(spark):
    rows = [(1, 0, 1.0, 1, 1), (1, 0, 3.0, 1, 0), (1, 1, 8.0, 0, 0)]
    df = frame(spark, rows, "epoch int, batch_id int, loss double, label int, prediction int")
    row = stats.running_epoch_metrics(df).first()
    assert row["loss"] == pytest.approx(5.0) and row["accuracy"] == pytest.approx(2 / 3)
    assert stats.running_epoch_metrics(df, mean_of="sample").first()["loss"] == pytest.approx(4.0)
