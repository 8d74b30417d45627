import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import fusion

RNG = np.random.default_rng(3)
X = RNG.normal(size=(50, 5))
W, B, Q = RNG.normal(size=(4, 5)), RNG.normal(size=4), RNG.normal(size=4)


@pytest.fixture(scope="module")
def rows(spark):
    # Key 0 holds most rows.
    data = [(i, 0 if i < 35 else i % 4, i // 12, x.tolist()) for i, x in enumerate(X)]
    return spark.createDataFrame(data, "post_id int, k int, batch_id int, features array<double>")


def scores(x):
    hidden = x @ W.T + B
    phi = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    return (hidden * phi(hidden)) @ Q


def softmax(s):
    e = np.exp(s - s.max())
    return e / e.sum()


@pytest.mark.parametrize(
    "scope, bounded", [("batch_id", True), ("batch_id", False), ("k", False), ("k", True), (None, True)]
)
def test_attention_over_a_scope(rows, scope, bounded):
    table = rows.collect()
    group = np.array([0 if scope is None else r[scope] for r in table])
    ids = np.array([r["post_id"] for r in table])
    want = np.empty(50)
    for g in np.unique(group):
        members = ids[group == g]
        want[members] = softmax(scores(X[members]))
    got = fusion.batch_attention(rows, W, B, Q.tolist(), scope, bounded).orderBy("post_id").collect()
    assert [r["weight"] for r in got] == pytest.approx(want.tolist())
    assert np.array([r["attended"] for r in got]) == pytest.approx(X * want[:, None])


def test_rows_without_a_scope_are_one_scope(spark):
    df = spark.createDataFrame(
        [(i, None if i < 2 else "a", X[i].tolist()) for i in range(4)],
        "post_id int, k string, features array<double>",
    )
    found = [
        fusion.batch_attention(df, W, B, Q.tolist(), "k", bounded).orderBy("post_id").collect()
        for bounded in (True, False)
    ]
    weights = [[r["weight"] for r in rows] for rows in found]
    assert len(weights[1]) == 4 and weights[0] == pytest.approx(weights[1])


def test_softmax_of_far_apart_scores(spark):
    values = [-2000.0, -1.5, 3.25, 900.0, 901.5]
    df = spark.createDataFrame([(1, v) for v in values], "k int, _score double")
    row = fusion.softmax_stats(df, "k").first()
    got = [math.exp(v - row["_top"]) / row["_mass"] for v in values]
    assert got == pytest.approx(softmax(np.array(values)).tolist())


def test_concat_keeps_order(spark):
    df = spark.createDataFrame([([1.0], [2.0, 3.0])], "a array<double>, b array<double>")
    assert fusion.fuse_concat(df, "b", "a").first()["fused"] == [2.0, 3.0, 1.0]


def test_cross_attention(spark):
    texts = {p: RNG.normal(size=3) for p in range(6)}
    images = [(n, n % 4 if n < 20 else 0, RNG.normal(size=5)) for n in range(60)]
    wq, wk, wv = RNG.normal(size=(2, 3)), RNG.normal(size=(2, 5)), RNG.normal(size=(3, 5))
    bq, bk, bv = RNG.normal(size=2), RNG.normal(size=2), RNG.normal(size=3)
    t = spark.createDataFrame(
        [(p, v.tolist()) for p, v in texts.items()], "post_id int, text_features array<double>"
    )
    i = spark.createDataFrame(
        [(n, p, v.tolist()) for n, p, v in images],
        "image_id int, post_id int, features array<double>",
    )
    got = fusion.cross_attention(t, i, "post_id", (wq, bq), (wk, bk), (wv, bv)).collect()
    weights = fusion.cross_attention_weights(t, i, "post_id", "image_id", (wq, bq), (wk, bk))
    by_image = {r["image_id"]: r["weight"] for r in weights.collect()}
    assert {r["post_id"] for r in got} == set(texts)
    assert len(by_image) == len(images)
    for r in got:
        if r["post_id"] > 3:  # no images
            assert r["attended"] == pytest.approx(texts[r["post_id"]].tolist())
            continue
        mine = [(n, v) for n, p, v in images if p == r["post_id"]]
        stack = np.array([v for _, v in mine])
        asked = wq @ texts[r["post_id"]] + bq
        want = softmax((stack @ wk.T + bk) @ asked)
        assert [by_image[n] for n, _ in mine] == pytest.approx(want.tolist())
        out = want @ (stack @ wv.T + bv) + texts[r["post_id"]]
        assert r["attended"] == pytest.approx(out.tolist())


def test_one_image_has_weight_one(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0])], "post_id int, text_features array<double>")
    i = spark.createDataFrame([(1, 7, [5.0])], "post_id int, image_id int, features array<double>")
    layers = ([[3.0, 4.0]], None), ([[9.0]], None)
    row = fusion.cross_attention_weights(t, i, "post_id", "image_id", *layers).first()
    assert row["weight"] == 1.0
    out = fusion.cross_attention(t, i, "post_id", *layers, ([[1.0], [10.0]], None)).first()
    assert out["attended"] == pytest.approx([6.0, 52.0])


def test_attention_table_and_matrix(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.25, 0.75])], "id int, t array<string>, w array<double>")
    rows = fusion.attention_table(df, "id", "t", "w")
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(1, 0, "a", 0.25), (1, 1, "b", 0.75)]
    wide = fusion.attention_matrix(rows, "id", "item", ["b", "a", "c"]).first()
    assert tuple(wide) == (1, 0.75, 0.25, None)


def test_alignment_is_an_inner_join(spark):
    posts = spark.createDataFrame([(1, "x"), (2, "y")], "post_id int, tweet string")
    images = spark.createDataFrame([(2, [1.0]), (3, [2.0])], "post_id int, features array<double>")
    assert [tuple(r) for r in fusion.align_modalities(posts, images).collect()] == [(2, "y", [1.0])]


def test_rows_of_a_skewed_key_never_meet_in_a_window(rows):
    """The only window is over the score levels left after the first reduction."""
    from conftest import plan_of

    plan = plan_of(fusion.batch_attention(rows, W, B, Q.tolist(), "k", bounded=False))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "max(_level" in windows[0]
    below = plan.split(windows[0])[1]
    assert "HashAggregate" in below and "partial_sum(EXP" in below
