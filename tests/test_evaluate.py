import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from postweave.operators import evaluate

RNG = np.random.default_rng(9)
LABELS = RNG.choice([0, 1, 2, 4], size=300, p=[0.6, 0.2, 0.15, 0.05])
GUESSES = np.where(RNG.random(300) < 0.6, LABELS, RNG.choice([0, 1, 3], size=300))


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(int(a), int(b)) for a, b in zip(LABELS, GUESSES)] + [(None, 1), (1, None)]
    return spark.createDataFrame(data, "label int, prediction int")


def test_confusion_matrix_keeps_zero_cells(pairs):
    cells = {(r["label"], r["prediction"]): r["n_rows"] for r in evaluate.confusion_matrix(pairs).collect()}
    assert len(cells) == 25 and sum(cells.values()) == 300
    assert cells[3, 0] == 0 and cells[0, 4] == ((LABELS == 0) & (GUESSES == 4)).sum()
    wide = {r["label"]: r for r in evaluate.confusion_matrix_wide(pairs, range(6)).collect()}
    assert wide[0]["p0"] == cells[0, 0] and wide[3]["p1"] == 0 and wide[0]["p5"] == 0


@pytest.mark.parametrize(
    "ours, theirs, column",
    [
        (evaluate.accuracy, "accuracy", "accuracy"),
        (evaluate.weighted_precision, "weightedPrecision", "weighted_precision"),
        (evaluate.weighted_recall, "weightedRecall", "weighted_recall"),
        (evaluate.weighted_f1, "f1", "weighted_f1"),
    ],
)
def test_measures_agree_with_the_library(pairs, ours, theirs, column):
    known = pairs.na.drop().select(*[F.col(c).cast("double") for c in pairs.columns])
    want = MulticlassClassificationEvaluator(labelCol="label", metricName=theirs).evaluate(known)
    assert ours(pairs).first()[column] == pytest.approx(want)
    assert evaluate.summary_metrics(pairs).first()[column] == pytest.approx(want)


def test_weighted_recall_is_accuracy(pairs):
    row = evaluate.summary_metrics(pairs).first()
    assert row["weighted_recall"] == pytest.approx(row["accuracy"])


def test_class_that_is_never_predicted_or_never_true(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 2)], "label int, prediction int")
    rows = {r["name"]: r for r in evaluate.classification_report(df).collect()}
    assert (rows["1"]["precision"], rows["1"]["f1"], rows["1"]["support"]) == (0.0, 0.0, 1)
    assert (rows["2"]["recall"], rows["2"]["f1"], rows["2"]["support"]) == (0.0, 0.0, 0)


def test_report(pairs):
    rows = {r["name"]: r for r in evaluate.classification_report(pairs).collect()}
    assert set(rows) == {"0", "1", "2", "3", "4", "accuracy", "macro avg", "weighted avg"}
    assert rows["3"]["support"] == 0 and rows["3"]["recall"] == 0.0
    for k in range(5):
        hits = ((LABELS == k) & (GUESSES == k)).sum()
        assert rows[str(k)]["precision"] == pytest.approx(hits / max(1, (GUESSES == k).sum()))
        assert rows[str(k)]["recall"] == pytest.approx(hits / max(1, (LABELS == k).sum()))
    f1 = [rows[str(k)]["f1"] for k in range(5)]
    assert rows["macro avg"]["f1"] == pytest.approx(np.mean(f1))
    assert rows["accuracy"]["support"] == 300
    named = {r["name"]: r for r in evaluate.classification_report(pairs, list("abcdef")).collect()}
    assert named["f"]["support"] == 0 and named["f"]["f1"] == 0.0
    assert named["b"]["recall"] == rows["1"]["recall"]
    assert named["macro avg"]["f1"] == pytest.approx(np.mean(f1))
