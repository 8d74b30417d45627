"""Trained networks against numpy: gradients, histories, dropout, journals and permutations."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from postweave.functions.permute import mixed, permutation
from postweave.operators import attention, networks, text, train
from postweave.session import scratch_path

RNG = np.random.default_rng(11)
N, D, T, K = 60, 5, 40, 3
X = RNG.normal(size=(N, D))
TERMS = [sorted(RNG.choice(T, size=RNG.integers(0, 6), replace=False).tolist()) for _ in range(N)]
VALUES = [RNG.normal(size=len(t)).tolist() for t in TERMS]
Y = RNG.integers(K, size=N)
TRAIN = np.arange(N) < 45
DENSE = np.zeros((N, D + T))
DENSE[:, :D] = X
for i, (t, v) in enumerate(zip(TERMS, VALUES)):
    DENSE[i, [D + x for x in t]] = v


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, int(Y[i]), "train" if TRAIN[i] else "valid", i if TRAIN[i] else i - 45, X[i].tolist(), (TERMS[i], VALUES[i]),
             DENSE[i].tolist()) for i in range(N)]
    return spark.createDataFrame(data, "post_id long, label int, split string, row_idx long, features array<double>, "
                                       "text_terms struct<terms: array<int>, values: array<double>>, fused array<double>").repartition(4)


def both_gradients(network, rows, params, epoch=1):
    """The gradient of a data pass and, entry by entry for some, the numeric one of its loss."""
    slim = network.rows(rows, "label", F.col("split") == "train", F.lit(1.0)).persist()
    grad, totals = network.data_pass(slim, params, epoch)
    rng, pairs = np.random.default_rng(0), []
    for name, value in params.items():
        for _ in range(2):
            at = tuple(int(rng.integers(k)) for k in value.shape)
            kept, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                losses.append(network.data_pass(slim, params, epoch)[1][0])
            value[at] = kept
            pairs.append((name, grad[name][at], (losses[0] - losses[1]) / 2e-5))
    slim.unpersist()
    return pairs, totals


@pytest.mark.parametrize("hidden, dropout", [(None, 0.0), (7, 0.0), (7, 0.4)])
def test_head_gradient_is_the_numeric_one(rows, hidden, dropout):
    network = networks.Head(K, dense=D, sparse=T, hidden=hidden, dropout=dropout)
    params = network.initial()
    if hidden is None:
        params["out"] += RNG.normal(size=params["out"].shape)
    pairs, totals = both_gradients(network, rows, params)
    assert totals[2] == 45 and totals[5] == 15
    for name, ours, numeric in pairs:
        assert ours == pytest.approx(numeric, abs=1e-6), name


def test_sparse_rows_train_like_dense_ones(spark, rows):
    both = networks.fit_network(networks.Head(K, dense=D, sparse=T), rows, epochs=5, lr=0.05)
    dense = train.train_epochs(rows, K, D + T, col="fused", epochs=5, lr=0.05)
    assert np.array([h[2:] for h in both.history]) == pytest.approx(np.array([h[2:] for h in dense.history]), abs=1e-9)
    assert both.params["out"].T == pytest.approx(dense.weights, abs=1e-9)
    assert both.best_epoch == dense.best_epoch
    ours = {r.post_id: r.logits for r in both.transform(rows).collect()}
    theirs = {r.post_id: r.logits for r in dense.transform(rows, "fused").collect()}
    for i in range(N):
        assert ours[i] == pytest.approx(theirs[i], abs=1e-9)


def test_slices_of_a_batch_give_the_same(rows, monkeypatch):
    network = networks.Head(K, dense=D, sparse=T, hidden=7)
    slim = network.rows(rows, "label", F.col("split") == "train", F.lit(1.0))
    whole, _ = network.data_pass(slim, network.initial(), 1)
    monkeypatch.setattr(networks, "CELLS", 21)
    sliced, _ = network.data_pass(slim, network.initial(), 1)
    assert networks.flat_of(sliced) == pytest.approx(networks.flat_of(whole))


def test_sparse_text_has_no_dense_array(spark):
    data = [(i, f"alpha beta {w} {w}", "train", i % 2) for i, w in enumerate(["red", "blue", "green", "red"])]
    posts = spark.createDataFrame(data, "post_id long, tweet string, split string, label int")
    model = text.fit_tfidf(posts, 20)
    rows = text.tfidf_terms(posts, model)
    network = networks.Head(2, sparse=text.tfidf_width(model))
    slim = network.rows(rows, "label", F.lit(True), F.lit(1.0))
    # The counts and the weights are functions of the JVM; filling the vector in would be a third one.
    assert plan_of(slim).count("UDF(") == 2 and plan_of(text.tfidf_features(posts, model)).count("UDF(") == 3
    dense = {r.post_id: r.text_features for r in text.tfidf_features(posts, model).collect()}
    for r in rows.collect():
        full = np.zeros(text.tfidf_width(model))
        full[r.text_terms.terms] = r.text_terms.values
        assert full == pytest.approx(dense[r.post_id])


def test_dropout_is_the_same_for_any_partitioning(rows):
    network = networks.Head(K, dense=D, hidden=16, dropout=0.5)
    found = [networks.fit_network(network, rows.repartition(n), epochs=3, lr=0.01).params["inner"] for n in (1, 6)]
    assert found[0] == pytest.approx(found[1])
    kept = [networks.kept_units(np.arange(4000), 50, epoch, 1, 0.3) for epoch in (1, 2)]
    assert abs(kept[0].mean() - 0.7) < 0.01 and abs((kept[0] == kept[1]).mean() - 0.58) < 0.01
    assert np.abs(np.corrcoef(kept[0].T[:8]) - np.eye(8)).max() < 0.08


def test_weight_decay_acts_apart_from_the_gradient(rows):
    plain = networks.fit_network(networks.Head(K, dense=D), rows, epochs=1, lr=0.1, initial={
        "out": np.ones((D, K)), "out_bias": np.ones(K)})
    decayed = networks.fit_network(networks.Head(K, dense=D), rows, epochs=1, lr=0.1, weight_decay=0.5, initial={
        "out": np.ones((D, K)), "out_bias": np.ones(K)})
    assert decayed.params["out"] == pytest.approx(plain.params["out"] - 0.05)


def test_a_run_that_was_cut_off_goes_on(spark, rows):
    network, options = networks.Head(K, dense=D, hidden=6, dropout=0.2), dict(lr=0.05, patience=2, threshold=None)
    whole = networks.fit_network(network, rows, epochs=9, **options)
    path = scratch_path(spark, "journal")
    for epochs in (2, 5, 9, 9):
        resumed = networks.fit_network(network, rows, epochs=epochs, journal=path, **options)
    assert resumed.history == [(m, e, *map(pytest.approx, v)) for m, e, *v in whole.history]
    assert networks.flat_of(resumed.params) == pytest.approx(networks.flat_of(whole.params))
    assert (resumed.best_epoch, resumed.stop_reason) == (whole.best_epoch, whole.stop_reason)


class Killed(Exception):
    pass


def test_a_run_killed_within_an_epoch_goes_on(spark, rows, monkeypatch):
    network, path, calls = networks.Head(K, dense=D), scratch_path(spark, "journal"), []
    pass_ = networks.Head.data_pass

    def dying(self, *args):
        calls.append(1)
        if len(calls) == 4:
            raise Killed
        return pass_(self, *args)

    monkeypatch.setattr(networks.Head, "data_pass", dying)
    with pytest.raises(Killed):
        networks.fit_network(network, rows, epochs=6, lr=0.05, patience=None, journal=path)
    monkeypatch.setattr(networks.Head, "data_pass", pass_)
    resumed = networks.fit_network(network, rows, epochs=6, lr=0.05, patience=None, journal=path)
    whole = networks.fit_network(network, rows, epochs=6, lr=0.05, patience=None)
    assert networks.flat_of(resumed.params) == pytest.approx(networks.flat_of(whole.params))
    assert len(resumed.history) == 6


def test_no_train_rows_is_an_error(rows):
    with pytest.raises(ValueError):
        networks.fit_network(networks.Head(K, dense=D), rows.filter("split = 'valid'"))
    with pytest.raises(ValueError):
        networks.fit_network(networks.Head(K, dense=D), rows.filter("false"))


# --- permutation ------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4099])
def test_permutation_is_a_bijection(spark, size):
    for epoch in (1, 2):
        order = permutation(size, 50, epoch)
        numbers = order.of(np.arange(size))
        assert sorted(numbers) == list(range(size))
        found = spark.range(size).select(order.column(F.col("id")).alias("p")).collect()
        assert [r.p for r in found] == numbers.tolist()
        assert [r[0] for r in duckdb.sql(f"SELECT {order.sql('range')} FROM range({size}) ORDER BY range").fetchall()] == numbers.tolist()


def test_permutations_differ_by_epoch_and_need_no_shuffle(spark):
    one, two = (permutation(10_000, 50, e).of(np.arange(10_000)) for e in (1, 2))
    assert (one == two).mean() < 0.01 and abs(np.corrcoef(one, two)[0, 1]) < 0.05
    assert abs(np.corrcoef(one, np.arange(10_000))[0, 1]) < 0.05
    assert "Exchange" not in plan_of(spark.range(10).select(permutation(10, 1, 1).column(F.col("id"))))
    big = permutation(10**11, 7, 3)
    some = np.arange(10**11 - 1000, 10**11)
    assert len(set(big.of(some).tolist())) == 1000 and big.of(some).max() < 10**11


def test_mixing_has_few_collisions():
    assert len(np.unique(mixed(np.arange(100_000)))) == 100_000


# --- attention over a batch ---------------------------------------------------------------

TEXT = RNG.normal(size=(N, 4))


@pytest.fixture(scope="module")
def pairs(rows, spark):
    texts = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(TEXT)], "post_id long, text_features array<double>")
    return rows.join(texts, "post_id").persist()


BATCHED = attention.BatchAttention(K, (D, 4), train_rows=45, attention=6, batch_size=7)


def softmax(s):
    p = np.exp(s - s.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def batch_forward(network, params, part, epoch):
    """Logits of one split's rows, batch by batch, in numpy."""
    place = permutation(45, 50, epoch).of(np.arange(45)) if part is TRAIN else np.arange(15)
    batches, logits = place // 7, np.zeros((len(place), K))
    for b in np.unique(batches):
        some, fused = batches == b, []
        for m, x in enumerate((X[part], TEXT[part])):
            act, _ = attention.gelu_and_slope(x[some] @ params[f"w{m}"] + params[f"c{m}"])
            fused.append(x[some] * softmax(act @ params[f"q{m}"])[:, None])
        logits[some] = np.concatenate(fused, axis=1) @ params["out"] + params["out_bias"]
    return logits


def loss_and_hits(logits, y):
    return -np.log(softmax(logits)[np.arange(len(y)), y]).mean(), (logits.argmax(1) == y).mean()


def test_batch_attention_gradient_is_the_numeric_one(pairs):
    pairs_, totals = both_gradients(BATCHED, pairs, BATCHED.initial(), epoch=2)
    for name, ours, numeric in pairs_:
        assert ours == pytest.approx(numeric, abs=1e-6), name
    loss, hits = loss_and_hits(batch_forward(BATCHED, BATCHED.initial(), TRAIN, 2), Y[TRAIN])
    assert totals[0] / 45 == pytest.approx(loss) and totals[1] / 45 == pytest.approx(hits)


def numeric_history(forward, params, epochs, lr):
    """Adam with a numeric gradient of the whole loss, in plain numpy."""
    flat = networks.flat_of(params)
    m = v = np.zeros_like(flat)
    out = []
    for epoch in range(1, epochs + 1):
        def loss(f, epoch=epoch):
            return loss_and_hits(forward(networks.shaped_like(f, params), TRAIN, epoch), Y[TRAIN])
        before, g = loss(flat), np.zeros_like(flat)
        for i in range(len(flat)):
            e = np.zeros_like(flat)
            e[i] = 1e-5
            g[i] = (loss(flat + e)[0] - loss(flat - e)[0]) / 2e-5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - lr * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        out.append((*before, *loss_and_hits(forward(networks.shaped_like(flat, params), ~TRAIN, epoch + 1), Y[~TRAIN])))
    return out


def test_batch_attention_history_equals_numpy(pairs):
    small = attention.BatchAttention(K, (D, 4), train_rows=45, attention=3, batch_size=7)
    found = networks.fit_network(small, pairs, epochs=3, lr=0.01, threshold=None)
    want = numeric_history(lambda p, part, e: batch_forward(small, p, part, e), small.initial(), 3, 0.01)
    assert np.array([h[2:] for h in found.history]) == pytest.approx(np.array(want), abs=1e-5)
    scored = found.transform(pairs.filter("split = 'valid'")).collect()
    logits = batch_forward(small, found.params, ~TRAIN, 0)
    for r in scored:
        assert r.logits == pytest.approx(logits[r.row_idx].tolist(), abs=1e-9)


# --- attention over the images of a post ----------------------------------------------------

COUNTS = [0, 1, 2, 5] * (N // 4)
IMAGES = [RNG.normal(size=(n, D)) for n in COUNTS]


@pytest.fixture(scope="module")
def crossed(spark):
    data = [(i, x.tolist()) for i, some in enumerate(IMAGES) for x in some] + [(0, None), (None, [0.0] * D), (999, [1.0] * D)]
    images = spark.createDataFrame(data, "post_id long, features array<double>").repartition(3).persist()
    return attention.CrossAttention(K, images, text_width=4, image_width=D, attention=6)


def cross_forward(params, part, epoch=0):
    out = []
    for i in np.flatnonzero(part):
        enhanced, mean = TEXT[i], np.zeros(D)
        if COUNTS[i]:
            query = TEXT[i] @ params["q"] + params["q_bias"]
            share = softmax((IMAGES[i] @ params["k"] + params["k_bias"]) @ query)
            enhanced = TEXT[i] + share @ (IMAGES[i] @ params["v"] + params["v_bias"])
            mean = IMAGES[i].mean(axis=0)
        out.append(np.concatenate([enhanced, mean]) @ params["out"] + params["out_bias"])
    return np.array(out)


def test_cross_attention_gradient_is_the_numeric_one(crossed, pairs):
    posts = pairs.drop("features")
    found, totals = both_gradients(crossed, posts, crossed.initial())
    for name, ours, numeric in found:
        assert ours == pytest.approx(numeric, abs=1e-6), name
    loss, hits = loss_and_hits(cross_forward(crossed.initial(), TRAIN), Y[TRAIN])
    assert totals[0] / 45 == pytest.approx(loss) and totals[1] / 45 == pytest.approx(hits)


def test_cross_attention_history_equals_numpy(crossed, pairs):
    posts = pairs.drop("features")
    small = attention.CrossAttention(K, crossed.images, text_width=4, image_width=D, attention=2)
    found = networks.fit_network(small, posts, epochs=3, lr=0.01, threshold=None)
    want = numeric_history(cross_forward, small.initial(), 3, 0.01)
    assert np.array([h[2:] for h in found.history]) == pytest.approx(np.array(want), abs=1e-5)
    logits = cross_forward(found.params, np.ones(N, dtype=bool))
    for r in found.transform(posts).collect():
        assert r.logits == pytest.approx(logits[r.post_id].tolist(), abs=1e-9)


def test_far_apart_scores_keep_their_weights(spark, pairs):
    """Scores of a post on several levels of the exponent."""
    images = spark.createDataFrame([(0, [400.0] * D), (0, [1.0] * D), (0, [400.0] * D)], "post_id long, features array<double>")
    network = attention.CrossAttention(K, images, text_width=4, image_width=D, attention=2)
    params = {k: np.ones_like(v) for k, v in network.initial().items()}
    posts = spark.createDataFrame([(0, [1.0] * 4)], "id long, t array<double>")
    row = network.attended(posts, params).first()
    assert row.mass == pytest.approx(2.0 * np.exp(5 * 400 * 5 * 2 - row.top), rel=1e-9) and row.z == pytest.approx([400.0] * D)
