import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from wordloom.operators import classify, svm


def _rows(spark, x, y, dense=False):
    def vector(row):
        return Vectors.dense(row) if dense else Vectors.sparse(len(row), [(j, v) for j, v in enumerate(row) if v])

    return spark.createDataFrame([(i, str(c), vector([float(v) for v in row])) for i, (row, c) in enumerate(zip(x, y, strict=True))], ["row_id", "label", "features"])



def _descent(x, s, rounds=200_000):
    """Plain gradient descent on the same objective, as slow as it is simple."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate, w = 1 / (1 + 2 * np.linalg.norm(x, 2) ** 2), np.zeros(x.shape[1])
    for _ in range(rounds):
        g = w - 2 * x.T @ (s * np.maximum(1 - s * (x @ w), 0))
        if np.linalg.norm(g) < 1e-10:
            break
        w = w - rate * g
    return w, x


@pytest.mark.parametrize("dense", [False, True])
def test_two_labels_reach_the_optimum(spark, dense):
    rng = np.random.default_rng(3)
    x = (rng.random((120, 15)) < 0.3).astype(float)
    y = np.where(x[:, 0] + x[:, 1] + 0.6 * rng.normal(size=120) > 0.8, "b", "a")
    model = svm.fit(_rows(spark, x, y, dense).repartition(5), ["a", "b"])
    want, xx = _descent(x, np.where(y == "b", 1.0, -1.0))
    assert model.weights.shape == (1, 16)
    assert np.allclose(model.weights[0], want, atol=1e-6)
    got = {r["row_id"]: r["predicted"] for r in model.predict(_rows(spark, x, y, dense)).collect()}
    assert got == {i: "b" if v > 0 else "a" for i, v in enumerate(xx @ want)}


def test_rest_against_one_for_three_labels_and_rows_left_out(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 90)
    x = np.eye(3)[y] * rng.integers(0, 3, (90, 1)) + rng.random((90, 3)) * 0.3
    rows = _rows(spark, x, y)
    extra = spark.createDataFrame([(900, None, Vectors.dense([1.0, 1.0, 1.0])), (901, "other", Vectors.dense([9.0, 9.0, 9.0])),
                                   (902, "0", None)], rows.schema)
    model = svm.fit(rows.unionByName(extra), ["0", "1", "2"])
    wants = [_descent(x, np.where(y == k, 1.0, -1.0)) for k in range(3)]
    for k in range(3):
        assert np.allclose(model.weights[k], wants[k][0], atol=1e-6)
    scores = np.stack([xx @ w for w, xx in wants])
    got = {r["row_id"]: r["predicted"] for r in model.predict(rows).collect()}
    assert got == {i: str(k) for i, k in enumerate(scores.argmax(axis=0))}
    assert model.predict(extra.where("row_id = 902")).first()["predicted"] in ("0", "1", "2")
    assert model.predict(extra.where("false")).count() == 0


def test_rows_without_features_get_the_intercept(spark):
    model = svm.fit(_rows(spark, np.zeros((5, 2)), ["a", "b", "b", "b", "b"]), ["a", "b"])
    # one weight: minimise 0.5 b² + 4 (1 - b)² + (1 + b)², so b = 6 / 11
    assert np.allclose(model.weights[0], [0, 0, 6 / 11])


def test_too_little_to_train_on(spark):
    rows = _rows(spark, np.eye(2), ["a", "b"])
    with pytest.raises(ValueError, match="two labels"):
        svm.fit(rows, ["a"])
    with pytest.raises(ValueError, match="training rows"):
        svm.fit(rows.where("false"), ["a", "b"])


@pytest.mark.parametrize("algorithm", ["svm", "logistic_regression"])
def test_gradient_by_joins_is_that_of_the_objective(spark, algorithm):
    has = {0: "x", 1: "xy", 2: "y", 3: ""}
    y = {0: "b", 1: "a", 2: "a", 3: "b"}
    w = {"x": 0.4, "y": -0.3, "z": 0.2, None: 0.1}
    bow = spark.createDataFrame([(i, t) for i, ts in has.items() for t in ts], "row_id long, term string")
    rows = spark.createDataFrame(list(y.items()), "row_id long, label string")
    weights = spark.createDataFrame(list(w.items()), "term string, weight double")

    def value(w):
        out = 0.5 * sum(v * v for t, v in w.items() if t or algorithm == "svm")
        for i, ts in has.items():
            m = (1 if y[i] == "b" else -1) * (sum(w[t] for t in ts) + w[None])
            out += max(0, 1 - m) ** 2 if algorithm == "svm" else np.log1p(np.exp(-m))
        return out

    got = {r["term"]: r["gradient"] for r in classify.residual_gradient(bow, rows, weights, "b", algorithm).collect()}
    assert got.keys() == w.keys()
    for t in w:
        slope = (value({**w, t: w[t] + 1e-6}) - value({**w, t: w[t] - 1e-6})) / 2e-6
        assert abs(got[t] - slope) < 1e-6


def test_a_step_is_few_jobs(spark, monkeypatch):
    jobs = []
    for name in ("_newton", "_total"):
        plain = getattr(svm, name)
        monkeypatch.setattr(svm, name, lambda *args, plain=plain: jobs.append(1) or plain(*args))
    rng = np.random.default_rng(6)
    x = (rng.random((200, 60)) < 0.2).astype(float) * np.linspace(0.1, 9, 60)
    y = np.where(rng.random(200) < 0.5, "b", "a")
    rows = _rows(spark, x, y).repartition(3).persist()
    found = svm.fit(rows, ["a", "b"]).weights
    assert len(jobs) <= 60
    monkeypatch.setattr(svm, "MATRIX_FEATURES", 0)
    assert np.allclose(found, svm.fit(rows, ["a", "b"]).weights, atol=1e-6)
