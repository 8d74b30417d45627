import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import history
from postweave.plans import experiment
from postweave.schema import LABEL_CODES
from postweave.sources import load_checkpoint, read_manifest

RNG = np.random.default_rng(2)
NAMES = list(LABEL_CODES)
WORDS = ["calm", "bridge", "trees", "smoke", "water", "hospital"]


def manifest(path, first, count):
    """Posts whose words and vectors tell the class; some are incomplete."""
    rows, vectors = [], []
    for i in range(first, first + count):
        k = (i * 5) % 6
        name = f"{(i * 31) % 997:04d}" + (".JPG" if i % 4 == 0 else ".jpg")
        tweet = "" if i % 10 == 3 else f"{WORDS[k]} seen\nat {i}"
        rows.append((name, tweet, "other" if i % 17 == 5 else NAMES[k]))
        x = RNG.normal(size=8)
        x[k] += 4
        vectors.append((name.replace(".JPG", ".jpg"), x.tolist()))
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, quoting=csv.QUOTE_ALL)
        writer.writerow(["image", "tweet", "label"])
        writer.writerows(rows)
    return rows, vectors


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("posts")
    train_rows, a = manifest(base / "train.csv", 0, 120)
    test_rows, b = manifest(base / "test.csv", 120, 60)
    features = spark.createDataFrame(a + b, "image string, features array<double>")
    features.write.parquet(str(base / "features"))
    return base, train_rows, test_rows


def complete(rows):
    return [r for r in rows if r[1] and r[2] in LABEL_CODES]


def test_manifests_are_split_in_load_order(spark, files):
    base, train_rows, test_rows = files
    train, test = (read_manifest(spark, str(base / n), with_order=True) for n in ("train.csv", "test.csv"))
    posts = experiment.split_manifests(train, test, 70).collect()
    images = {s: {r["image"] for r in posts if r["split"] == s} for s in ("train", "valid", "test")}
    fixed = [r[0].replace(".JPG", ".jpg") for r in complete(train_rows)]
    assert images["train"] == set(fixed[:70]) and images["valid"] == set(fixed[70:])
    assert len(images["test"]) == len(test_rows)
    assert sorted(r["post_id"] for r in posts) == list(range(len(posts)))
    by_id = [r["image"] for r in sorted(posts, key=lambda r: r["post_id"])]
    assert by_id == fixed + [r[0].replace(".JPG", ".jpg") for r in test_rows]


@pytest.mark.parametrize("kind", experiment.KINDS)
def test_whole_run(spark, files, tmp_path, kind):
    base, _, test_rows = files
    out = str(tmp_path / kind)
    argv = ["--train", str(base / "train.csv"), "--test", str(base / "test.csv")]
    argv += ["--features", str(base / "features"), "--fusion", kind, "--train-rows", "70"]
    # Attention over a batch makes each vector small, so more epochs are needed there.
    argv += ["--text-dims", "12", "--epochs", "25", "--lr", "0.5", "--out", out]
    experiment.main(argv)
    tables = {
        n: spark.read.parquet(f"{out}/{n}")
        for n in ["history", "learning_curves", "predictions", "metrics", "report", "confusion_matrix"]
    }
    labelled = sum(r[2] in LABEL_CODES for r in test_rows)
    assert tables["predictions"].count() == len(test_rows)
    assert tables["confusion_matrix"].agg(F.sum("n_rows")).first()[0] == labelled
    report = {r["name"]: r for r in tables["report"].collect()}
    assert report["accuracy"]["support"] == labelled
    assert tables["metrics"].first()["accuracy"] > (0.5 if kind == "basic_attention" else 0.8)
    assert tables["learning_curves"].count() == 4 * tables["history"].count()
    stop = history.early_stop(tables["history"]).first()
    assert stop["stop_epoch"] == tables["history"].count()
    head = load_checkpoint(spark, f"{out}/model", "head")
    assert head.weights.shape[0] == 6


def test_best_of_takes_the_better_vectors(spark):
    rows = []
    for i in range(150):
        x = RNG.normal(size=4)
        x[i % 3] += 5
        split = "train" if i < 80 else "valid" if i < 110 else "test"
        rows.append((i, i % 3, split, RNG.normal(size=2).tolist(), x.tolist()))
    df = spark.createDataFrame(
        rows, "post_id int, label int, split string, noise array<double>, good array<double>"
    )
    models = {"noise": ("noise", 2), "good": ("good", 4), "again": ("good", 4)}
    run = experiment.run_best_of(df, models, classes=3, epochs=15, lr=0.3)
    assert run.name == "good"
    assert run.metrics("test").first()["accuracy"] > 0.9


@pytest.mark.parametrize("kind", experiment.KINDS)
def test_trained_runs_learn(spark, kind, tmp_path):
    """Words and vectors tell the class; all layers are trained, and a second call goes on from the journal."""
    data = []
    for i in range(180):
        k = (i * 5) % 6
        x = RNG.normal(size=8)
        x[k] += 4
        data.append((i, k, f"{WORDS[k]} seen at {i % 7}", x.tolist(), ["train", "train", "train", "valid", "test"][i % 5]))
    pairs = spark.createDataFrame(data, "post_id long, label int, tweet string, features array<double>, split string").repartition(3)
    options = dict(lr=0.1, text_dims=40, attention_width=4, journal=str(tmp_path / "journal"))
    experiment.run_trained(pairs, kind, epochs=2, **options)
    run = experiment.run_trained(pairs, kind, epochs=8, **options)
    past = run.head.history_table(spark).collect()
    assert [r["epoch"] for r in past] == list(range(1, len(past) + 1)) and len(past) >= 2
    losses = [r["train_loss"] for r in past]
    assert losses[-1] < losses[0]
    tables = run.tables("test")
    assert tables["predictions"].count() == 36 and tables["metrics"].first()["accuracy"] > 0.3
