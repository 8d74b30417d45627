import random

import pytest

from postweave.operators import history
from postweave.schema import HISTORY


def table(spark, losses, accs=None, model="m"):
    accs = accs or [0.5] * len(losses)
    rows = [(model, e + 1, 1.0, a, loss, a / 2) for e, (loss, a) in enumerate(zip(losses, accs))]
    return spark.createDataFrame(rows, HISTORY)


def walk(losses, accs, patience, threshold):
    """The rule, epoch by epoch."""
    best, waited, saved = float("inf"), 0, None
    for epoch, (loss, acc) in enumerate(zip(losses, accs), 1):
        if threshold is not None and acc > threshold:
            return epoch, "threshold", saved
        if loss is not None and loss < best:
            best, waited, saved = loss, 0, epoch
            continue
        waited += 1
        if patience is not None and waited >= patience:
            return epoch, "patience", saved
    return len(losses), "epoch_limit", saved


def stop(spark, losses, accs, patience, threshold):
    row = history.early_stop(table(spark, losses, accs), patience, threshold).first()
    return row["stop_epoch"], row["reason"], row["best_epoch"]


CASES = [
    ([3.0, 2.0, 2.0, 2.0, 2.0, 1.0], [0.5] * 6, 3, 0.99),
    ([3.0, 2.0, 1.0], [0.5, 0.99, 0.995], 3, 0.99),
    ([3.0, 2.0], [1.0, 1.0], 3, 0.99),
    ([3.0, 2.0, 4.0, 5.0, 1.0], [0.5] * 5, None, None),
    ([None, None, 1.0, 2.0], [0.5] * 4, 3, 0.99),
    ([None, None], [0.5] * 2, 2, 0.99),
    ([float("nan"), 5.0, float("nan"), 4.0], [0.5] * 4, 3, 0.99),
    ([2.0, 3.0, 4.0, 5.0], [0.5, 0.5, 0.5, 1.0], 3, 0.99),
]


@pytest.mark.parametrize("losses, accs, patience, threshold", CASES)
def test_early_stop(spark, losses, accs, patience, threshold):
    assert stop(spark, losses, accs, patience, threshold) == walk(losses, accs, patience, threshold)


def test_early_stop_on_random_histories(spark):
    rng = random.Random(4)
    models = {}
    for n in range(60):
        size = rng.randint(1, 15)
        models[f"m{n}"] = (
            [rng.randint(0, 6) / 2 for _ in range(size)],
            [rng.choice([0.5, 0.98, 0.99, 0.995]) for _ in range(size)],
        )
    rows = [
        (m, e + 1, 1.0, a, loss, a)
        for m, (losses, accs) in models.items()
        for e, (loss, a) in enumerate(zip(losses, accs))
    ]
    df = spark.createDataFrame(rows, HISTORY)
    for patience, threshold in [(3, 0.99), (2, None), (None, 0.99)]:
        got = {
            r["model"]: (r["stop_epoch"], r["reason"], r["best_epoch"])
            for r in history.early_stop(df, patience, threshold).collect()
        }
        assert got == {m: walk(*v, patience, threshold) for m, v in models.items()}


def test_counter_and_running_best(spark):
    rows = history.patience_counter(table(spark, [3.0, 3.0, 2.0, 2.5, 2.5])).orderBy("epoch").collect()
    assert [r["counter"] for r in rows] == [0, 1, 0, 1, 2]
    assert [r["best_loss"] for r in rows] == [3.0, 3.0, 2.0, 2.0, 2.0]
    assert [r["improved"] for r in rows] == [True, False, True, False, False]


def test_cut_and_checkpoint(spark):
    df = table(spark, [3.0, 2.0, 2.0, 2.0, 2.0, 1.0])
    stops = history.early_stop(df)
    assert history.cut_history(df, stops).count() == 5
    assert history.best_checkpoint_epoch(df).first()["best_epoch"] == 2


def test_model_selection_takes_the_first_listed_on_ties(spark):
    both = history.union_histories(
        {
            "b": table(spark, [1.0, 1.0], [0.2, 0.8]).drop("model"),
            "a": table(spark, [1.0, 1.0], [0.8, 0.1]).drop("model"),
        }
    )
    assert history.select_model(both, ["b", "a"]).first()["model"] == "b"
    assert history.select_model(both, ["a", "b"]).first()["model"] == "a"
    assert history.winner_history(both, ["a", "b"]).count() == 2


def test_trim_and_curves(spark):
    df = table(spark, [1.0, 2.0, 3.0])
    assert sorted(r["epoch"] for r in history.trim_history(df, 1).collect()) == [1, 2]
    assert history.trim_history(df, 0).count() == 3
    curves = history.learning_curves(df)
    assert curves.count() == 12 and set(curves.columns) == {"model", "epoch", "series", "value"}
