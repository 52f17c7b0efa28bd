"""Trainers against plain numpy, and invariants of training."""

import brute
import numpy as np
import pytest
from conftest import make_points, random_rows
from pyspark.sql import functions as F

from slicegrad.operators import statistics as st
from slicegrad.plans.mlp import Shape, train_mlp
from slicegrad.plans.objectives import Adam, Objective
from slicegrad.plans.train import evaluate, train, train_all
from slicegrad.sources.libsvm import read_libsvm, write_libsvm

FEATURES, BATCH, STEPS = 12, 25, 3


def matrix(model, features=FEATURES):
    rows = model.weights().collect()
    w = np.zeros((features, 1 + max(r.k for r in rows)))
    for r in rows:
        w[r.feature, r.k] = r.w
    return w


def split(points, columns, partitions=3):
    return st.split_placement(points, columns, partitions)


CASES = [
    ("lr", "lr", 2, None, 1, False),
    ("svm", "svm", 2, None, 1, False),
    ("mlr", "mlr", 3, 3, 3, False),
    ("fm", "fm", 2, 2, 3, False),
    ("adamlr", "lr", 2, None, 1, True),
    ("adamsvm", "svm", 2, None, 1, True),
]


@pytest.mark.parametrize("model,kind,classes,k,width,adam", CASES)
@pytest.mark.parametrize("layout", ["small", "split"])
def test_weights_equal_numpy(spark, model, kind, classes, k, width, adam, layout):
    rows = random_rows(classes=classes, features=FEATURES)
    rows[5] = (rows[5][0], {})
    points = make_points(spark, rows)
    settings = {"step": 0.3, "reg": 0.05, "iterations": STEPS, "batch_size": BATCH, "num_features": FEATURES}
    if layout == "split":
        settings |= {"placement": split(points, width), "partitions": 3}
    trained = train(points, model, k=k, **settings)
    expected, losses = brute.train(kind, rows, FEATURES, BATCH, STEPS, 0.3, 0.05, width, adam)
    np.testing.assert_allclose(matrix(trained), expected, atol=1e-9)
    np.testing.assert_allclose([r[1] for r in trained.records], losses, atol=1e-9)


@pytest.mark.parametrize("kind,classes,width", [("lr", 2, 1), ("mlr", 3, 3), ("fm", 2, 4)])
def test_numpy_gradient_is_the_slope_of_the_loss(kind, classes, width):
    rows = random_rows(classes=classes, n=20)
    x, y = brute.dense(rows, FEATURES)
    w = np.random.default_rng(1).normal(size=(FEATURES, width))
    _, grad = brute.loss_and_grad(kind, w, x, y)
    for f, k in [(0, 0), (3, width - 1), (7, 0)]:
        step = np.zeros_like(w)
        step[f, k] = 1e-6
        slope = (brute.loss_and_grad(kind, w + step, x, y)[0] - brute.loss_and_grad(kind, w - step, x, y)[0]) / 2e-6
        assert slope == pytest.approx(grad[f, k], abs=1e-5)


@pytest.mark.parametrize("hidden", [6, 17])
@pytest.mark.parametrize("layout", ["small", "split"])
def test_perceptron_equals_numpy(spark, layout, hidden):
    rows = random_rows(classes=3, n=30)
    rows[4] = (1, {})
    points = make_points(spark, rows)
    extra = {}
    if layout == "split":
        extra = {"placement": split(points, 6), "partitions": 3}
    model = train_mlp(
        points, step=2.0, batch_size=15, iterations=2, classes=3, hidden=hidden, num_features=FEATURES, **extra
    )
    w1, w2, seen = brute.train_mlp(rows, FEATURES, hidden, 3, 15, 2, 2.0)
    got = {(r.layer, r.i, r.j): r.w for r in model.weights().collect()}
    for layer, w in ((0, w1), (1, w2)):
        for (i, j), value in np.ndenumerate(w):
            assert got[layer, i, j] == pytest.approx(value, abs=1e-9)
    assert len(got) == w1.size + w2.size
    np.testing.assert_allclose([(r[1], r[3]) for r in model.records], seen, atol=1e-9)
    scored = model.score(points)
    assert scored.count() == len(rows)
    share = F.col("p0") + F.col("p1") + F.col("p2")
    assert scored.where(F.abs(share - 1) > 1e-9).count() == 0


def test_perceptron_step_follows_the_slope():
    rows = random_rows(classes=3, n=10)
    x, y = brute.dense(rows, FEATURES)
    picked = brute.draws(10, 8, 0)
    w1, w2, _ = brute.train_mlp(rows, FEATURES, 4, 3, 8, 0, 1.0)
    after1, after2, _ = brute.train_mlp(rows, FEATURES, 4, 3, 8, 1, 1.0)
    xb, yb = x[picked], y[picked]
    for which, before, after in ((0, w1, after1), (1, w2, after2)):
        for at in [(0, 0), (2, 2)]:
            bump = np.zeros_like(before)
            bump[at] = 1e-5
            pair = [(w1 + s * bump, w2) if which == 0 else (w1, w2 + s * bump) for s in (1, -1)]
            slope = (brute.mlp_loss(*pair[0], xb, yb) - brute.mlp_loss(*pair[1], xb, yb)) / 2e-5 / 8
            assert (before - after)[at] == pytest.approx(slope, rel=1e-3, abs=1e-9)


@pytest.mark.parametrize("model,k,loss", [("lr", None, np.log(2)), ("svm", None, 1.0), ("mlr", 3, np.log(3))])
def test_loss_of_the_zero_model(spark, model, k, loss):
    points = make_points(spark, random_rows(classes=2))
    trained = train(points, model, k=k, step=0.1, batch_size=8, iterations=1, valid_ratio=0.5)
    assert trained.records[0][1] == pytest.approx(loss)
    assert trained.records[0][2] == pytest.approx(loss)


def test_result_does_not_depend_on_partitions(spark):
    points = make_points(spark, random_rows())
    settings = {"step": 0.3, "batch_size": 20, "iterations": 2, "num_features": FEATURES}
    results = [
        matrix(train(points, "lr", placement=split(points, 1, p), partitions=p, **settings)) for p in (1, 2, 5)
    ]
    np.testing.assert_allclose(results[0], results[1], atol=1e-12)
    np.testing.assert_allclose(results[0], results[2], atol=1e-12)


def test_batch_may_exceed_the_data(spark):
    rows = random_rows(n=5)
    trained = train(make_points(spark, rows), "lr", step=0.3, batch_size=40, iterations=1, num_features=FEATURES)
    expected, _ = brute.train("lr", rows, FEATURES, 40, 1, 0.3, 0.0)
    np.testing.assert_allclose(matrix(trained), expected, atol=1e-9)


def test_batches_are_drawn_in_groups(spark, monkeypatch):
    import slicegrad.plans.batches as batches

    monkeypatch.setattr(batches, "SLOTS_PER_PASS", 2 * BATCH)
    rows = random_rows()
    trained = train(make_points(spark, rows), "lr", step=0.3, batch_size=BATCH, iterations=5, num_features=FEATURES)
    expected, _ = brute.train("lr", rows, FEATURES, BATCH, 5, 0.3, 0.0)
    np.testing.assert_allclose(matrix(trained), expected, atol=1e-9)


@pytest.mark.parametrize("labels", [[-1, 1], [0, 2], [0.5, 1]])
def test_bad_labels_raise(spark, labels):
    points = make_points(spark, [(y, {0: 1.0}) for y in labels])
    with pytest.raises(ValueError, match="labels"):
        train(points, "lr", step=0.1, batch_size=2, iterations=1)


def test_empty_input_and_gaps_in_ids_raise(spark):
    points = make_points(spark, random_rows(n=4))
    with pytest.raises(ValueError, match="no rows"):
        train(points.where("row_id < 0"), "lr", step=0.1, batch_size=2, iterations=1)
    with pytest.raises(ValueError, match="dense"):
        train(points.where("row_id <> 1"), "lr", step=0.1, batch_size=2, iterations=1)


def test_settings_are_restored(spark):
    before = [spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    train(make_points(spark, random_rows(n=6)), "lr", step=0.1, batch_size=2, iterations=1)
    assert before == [spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]


def test_user_defined_objective(spark):
    class Squares(Objective):
        name = "least squares"

        def weights(self):
            return ["w0"]

        def stats(self):
            return ["s0"]

        def terms(self):
            return {"s0": F.col("w0") * F.col("value")}

        def loss(self):
            return F.pow(F.col("s0") - F.col("label"), 2) / 2

        def coefs(self):
            return {"c0": F.col("s0") - F.col("label")}

        def sums(self):
            return {"g0": F.col("c0") * F.col("value")}

        def gradient(self):
            return {"w0": F.col("g0")}

        def scores(self):
            return {"score": F.col("s0")}

    rows = random_rows()
    trained = train(make_points(spark, rows), Squares(), step=0.2, batch_size=20, iterations=2, num_features=FEATURES)
    x, y = brute.dense(rows, FEATURES)
    w = np.zeros(FEATURES)
    for t in range(2):
        picked = brute.draws(len(rows), 20, t)
        w = w - 0.2 / 20 * x[picked].T @ (x[picked] @ w - y[picked])
    np.testing.assert_allclose(matrix(trained)[:, 0], w, atol=1e-9)


def test_score_and_evaluate(spark):
    rows = random_rows()
    rows[3] = (0, {})
    points = make_points(spark, rows)
    trained = train(points, "lr", step=0.5, batch_size=20, iterations=2, num_features=FEATURES)
    x, y = brute.dense(rows, FEATURES)
    w = matrix(trained)
    scores = {r.row_id: r.score for r in trained.score(points).collect()}
    np.testing.assert_allclose([scores[i] for i in range(len(rows))], x @ w[:, 0], atol=1e-9)
    picked = brute.draws(len(rows), 30, 0, seed=100_000)
    seen = evaluate(trained, points, valid_ratio=0.5).first()
    assert seen.n == 30
    assert seen.loss == pytest.approx(brute.loss_and_grad("lr", w, x[picked], y[picked])[0] / 30)


def test_chain_from_text(spark, tmp_path):
    path = str(tmp_path / "points")
    write_libsvm(make_points(spark, random_rows()), path)
    models = train_all(read_libsvm(spark, path), "LR-SVM", step=0.3, batch_size=10, iterations=1)
    assert list(models) == ["lr", "svm"]
    assert models["lr"].num_features == FEATURES


def test_block_width():
    assert [Shape(1, h, 2).width for h in (4, 500, 7, 17, 64)] == [4, 16, 7, 9, 16]


def test_features_beyond_the_given_number_raise(spark):
    points = make_points(spark, [(1, {0: 1.0}), (0, {7: 2.0})])
    with pytest.raises(ValueError, match="does not fit"):
        train(points, "lr", step=0.1, batch_size=2, iterations=1, num_features=5)
    with pytest.raises(ValueError, match="negative"):
        train(make_points(spark, [(1, {-1: 1.0})]), "lr", step=0.1, batch_size=2, iterations=1, num_features=5)


@pytest.mark.parametrize("kind,k", [("lr", 1), ("fm", 3)])
@pytest.mark.parametrize("adam", [False, True])
def test_stretches_of_a_large_model_equal_numpy(spark, monkeypatch, kind, k, adam):
    """Features that a stretch does not touch shrink at its end as if in every iteration."""
    monkeypatch.setattr("slicegrad.plans.train.MERGE_EVERY", 3)
    rows = random_rows(n=40, density=0.15)
    points = make_points(spark, rows)
    model = train(
        points, kind, k=k - 1 or None, step=0.3, reg=0.05, batch_size=4, iterations=8, num_features=FEATURES, partitions=3,
        placement=split(points, k), optimizer=Adam() if adam else None, valid_every=5,
    )
    w, losses = brute.train(kind, rows, FEATURES, 4, 8, 0.3, 0.05, k, adam)
    got = {(r.feature, r.k): r.w for r in model.weights().collect()}
    for at, value in np.ndenumerate(w):
        assert got[at] == pytest.approx(value, abs=1e-9)
    np.testing.assert_allclose([r[1] for r in model.records], losses, atol=1e-9)
    assert [r[2] is not None for r in model.records] == [t % 5 == 0 for t in range(8)]


@pytest.mark.parametrize("hidden", [[6], [17, 5], [4, 18, 3]])
@pytest.mark.parametrize("layout", ["small", "split"])
@pytest.mark.parametrize("adam", [False, True])
def test_layers_equal_numpy(spark, layout, hidden, adam):
    rows = random_rows(classes=3, n=30)
    rows[4] = (1, {})
    points = make_points(spark, rows)
    extra = {"placement": split(points, 6), "partitions": 3} if layout == "split" else {}
    model = train(
        points, "adammlp" if adam else "mlp", k=3, step=0.05 if adam else 2.0, reg=0.01 if adam else 0.0, batch_size=15, iterations=2,
        hidden=hidden, num_features=FEATURES, **extra,
    )
    weights, seen = brute.train_layers(rows, [FEATURES, *hidden, 3], 15, 2, 0.05 if adam else 2.0, 0.01 if adam else 0.0, adam)
    got = {(r.layer, r.i, r.j): r.w for r in model.weights().collect()}
    assert len(got) == sum(w.size for w in weights)
    for layer, w in enumerate(weights):
        for (i, j), value in np.ndenumerate(w):
            assert got[layer, i, j] == pytest.approx(value, abs=1e-9)
    np.testing.assert_allclose([(r[1], r[3]) for r in model.records], seen, atol=1e-9)
    scored = model.score(points)
    assert scored.count() == len(rows) and scored.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
    assert 0 < model.evaluate(points, len(rows), 0.5).first().loss < 3


def test_a_perceptron_needs_a_hidden_layer(spark):
    with pytest.raises(ValueError, match="hidden layer"):
        train(make_points(spark, [(1, {0: 1.0})]), "mlp", step=0.1, batch_size=2, iterations=1, hidden=[])
