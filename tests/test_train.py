import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import evaluate, history, score, train
from postweave.sources import load_checkpoint, save_checkpoint

RNG = np.random.default_rng(5)
N, D, K = 240, 4, 3
CENTRES = RNG.normal(scale=3, size=(K, D))
Y = np.arange(N) % K
X = CENTRES[Y] + RNG.normal(size=(N, D))


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (i, int(Y[i]), "train" if i < 180 else "valid", x.tolist()) for i, x in enumerate(X)
    ]
    return spark.createDataFrame(data, "post_id int, label int, split string, features array<double>")


def numpy_gradient(x, y, w, b):
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(p[np.arange(len(y)), y]).mean()
    acc = (z.argmax(1) == y).mean()
    e = p.copy()
    e[np.arange(len(y)), y] -= 1
    return e.T @ x / len(y), e.mean(0), loss, acc


def test_gradient_matches_numpy(rows):
    w, b = RNG.normal(size=(K, D)), RNG.normal(size=K)
    got = train.softmax_gradient(rows, w, b).orderBy("pos").collect()
    gw, gb, loss, _ = numpy_gradient(X, Y, w, b)
    assert [got[0][f"g{k}"] for k in range(K)] == pytest.approx(gb.tolist())
    assert got[0]["loss"] == pytest.approx(loss) and got[1]["loss"] is None
    table = np.array([[r[f"g{k}"] for k in range(K)] for r in got[1:]])
    assert table == pytest.approx(gw.T)


def numpy_epochs(epochs, lr):
    """Plain restatement of full-batch Adam."""
    w, b = np.zeros((K, D)), np.zeros(K)
    m = v = np.zeros((K, D + 1))
    out = []
    for t in range(1, epochs + 1):
        gw, gb, loss, acc = numpy_gradient(X[:180], Y[:180], w, b)
        g = np.column_stack([gw, gb])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:, :D], b - step[:, D]
        _, _, valid_loss, valid_acc = numpy_gradient(X[180:], Y[180:], w, b)
        out.append((loss, acc, valid_loss, valid_acc))
    return out, w, b


@pytest.mark.parametrize("partitions", [1, 11])
def test_epochs_match_numpy(rows, partitions):
    head = train.train_epochs(
        rows.repartition(partitions), K, D, epochs=6, lr=0.05, threshold=None, patience=None
    )
    want, w, b = numpy_epochs(6, 0.05)
    assert np.array([h[2:] for h in head.history]) == pytest.approx(np.array(want))
    losses = [h[2] for h in head.history]
    assert losses == sorted(losses, reverse=True)
    assert head.best_epoch == 6 and head.weights == pytest.approx(w)


def test_stop_rules_agree_with_the_history_operators(spark, rows):
    noisy = rows.withColumn(
        "label", F.when(F.col("split") == "valid", (F.col("label") + 1) % K).otherwise(F.col("label"))
    )
    for data, options in [
        (rows, dict(epochs=60, lr=0.3, patience=3, threshold=0.9)),
        (noisy, dict(epochs=60, lr=0.3, patience=2, threshold=None)),
        (noisy, dict(epochs=3, lr=0.3, patience=None, threshold=None)),
    ]:
        head = train.train_epochs(data, K, D, model="m", **options)
        limits = {k: options[k] for k in ("patience", "threshold")}
        row = history.early_stop(head.history_table(spark), **limits).first()
        assert row["stop_epoch"] == len(head.history)
        assert (row["reason"], row["best_epoch"]) == (head.stop_reason, head.best_epoch)


def test_rows_without_label_or_vector_are_left_out(spark, rows):
    extra = spark.createDataFrame(
        [(900, None, "train", [1.0] * D), (901, 1, "train", None)], rows.schema
    )
    options = dict(epochs=2, lr=0.05)
    plain = train.train_epochs(rows, K, D, **options)
    more = train.train_epochs(rows.unionByName(extra), K, D, **options)
    assert np.array([h[2:] for h in more.history]) == pytest.approx(
        np.array([h[2:] for h in plain.history])
    )


def test_head_checkpoint(spark, rows, tmp_path):
    head = train.train_epochs(rows, K, D, epochs=3, lr=0.1)
    save_checkpoint(spark, head, str(tmp_path / "head"))
    again = load_checkpoint(spark, str(tmp_path / "head"), "head")
    assert again.weights == pytest.approx(head.weights) and again.bias == pytest.approx(head.bias)
    scored = score.score_split(again, rows)
    assert evaluate.accuracy(scored).first()["accuracy"] > 0.9


def test_classifiers_learn(spark, rows, tmp_path):
    fit_rows, rest = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    weighted = fit_rows.withColumn("w", F.lit(0.5))
    models = [
        train.fit_linear_probe(fit_rows, reg=0.01),
        train.fit_linear_probe(weighted, weight="w", reg=0.01),
    ]
    for n, model in enumerate(models):
        scored = score.score_split(model, rest, ["post_id"])
        assert evaluate.accuracy(scored).first()["accuracy"] > 0.9
        save_checkpoint(spark, model, str(tmp_path / f"m{n}"))
        loaded = score.score_split(load_checkpoint(spark, str(tmp_path / f"m{n}")), rest, ["post_id"])
        assert loaded.exceptAll(scored).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_probe_reaches_the_optimum(rows, weighted):
    """At the minimum the loss gradient cancels that of the penalty on scaled weights."""
    fit_rows = rows.filter("split = 'train'")
    x, y = X[:180], Y[:180]
    w = np.ones(180)
    weight = None
    if weighted:
        fit_rows = fit_rows.withColumn("w", F.when(F.col("label") == 0, 3.0).otherwise(1.0))
        w, weight = np.where(y == 0, 3.0, 1.0), "w"
    model = train.fit_linear_probe(fit_rows, weight=weight, reg=0.05)
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ coef.T + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(180), y] -= 1
    gradient = (p * w[:, None]).T @ x / w.sum()
    mean = np.average(x, axis=0, weights=w)
    spread = ((x - mean) ** 2 * w[:, None]).sum(0) / w.sum()
    total = gradient + 0.05 * spread * coef
    # The library divides by n - 1 where this divides by n.
    assert np.abs(total).max() < 2e-3 and np.abs(gradient).max() > 1e-2


def test_text_and_fused_classifiers_learn(spark, rows):
    topics = F.array(F.lit("wild fire here"), F.lit("deep flood water"), F.lit("calm day"))
    posts = rows.withColumn("tweet", F.get(topics, F.col("label")))
    fit_rows, rest = posts.filter("split = 'train'"), posts.filter("split = 'valid'")
    text_model = train.fit_text_classifier(fit_rows)
    assert evaluate.accuracy(score.score_split(text_model, rest)).first()["accuracy"] == 1.0
    both = posts.withColumn("text_features", F.array(F.length("tweet").cast("double")))
    fused = train.fit_fused_classifier(both.filter("split = 'train'"))
    scored = score.score_split(fused, train.fused_inputs(both.filter("split = 'valid'")))
    assert evaluate.accuracy(scored).first()["accuracy"] > 0.9


def test_cross_entropy(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0], 2), (2, [500.0, -500.0, 0.0], 1), (3, [1.0, 1.0, 1.0], None)],
        "post_id int, logits array<double>, label int",
    )
    got = {r["post_id"]: r["loss"] for r in score.cross_entropy(df).collect()}
    assert got[1] == pytest.approx(np.log(np.exp([1, 2, 3]).sum()) - 3)
    assert got[2] == pytest.approx(1000.0) and got[3] is None
    weighted = score.mean_cross_entropy(
        score.cross_entropy(df).withColumn("w", F.lit(2.0)), weight="w"
    ).first()["loss"]
    assert weighted == pytest.approx((got[1] + got[2]) / 2)


def test_first_of_equal_logits_wins(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), (None,)], "logits array<double>")
    assert [r["prediction"] for r in score.predict_class(df).collect()] == [1, None]


def test_labels_outside_the_classes_do_not_train(spark):
    good = [(i, [float(i % 2), 1.0], i % 2, "train" if i < 8 else "valid") for i in range(12)]
    odd = [(20, [9.0, 9.0], -1, "train"), (21, [9.0, 9.0], 7, "train"), (22, [9.0, 9.0], None, "train")]
    schema = "id int, features array<double>, label int, split string"
    one = train.train_epochs(spark.createDataFrame(good, schema), 2, 2, epochs=3)
    other = train.train_epochs(spark.createDataFrame(good + odd, schema), 2, 2, epochs=3)
    assert np.array_equal(one.weights, other.weights) and one.history == other.history
    valid = spark.createDataFrame([r for r in good if r[3] == "valid"], schema)
    with pytest.raises(ValueError):
        train.train_epochs(valid, 2, 2, epochs=3)
