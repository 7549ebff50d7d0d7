"""The linear booster against plain coordinate descent over rows, in blocks and over sparse rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.dataset import Dataset, SparseDataset
from gradloom.errors import FeatureOutOfBounds
from gradloom.functions import objectives
from gradloom.model import BoostedModel
from gradloom.params import TrainingParams
from gradloom.plans import boost, linear

SPARSE = "row_id long, y double, w double, q long, indices array<int>, values array<double>"


def rows_of(n=120, width=7, holes=0.4, seed=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < holes, 0, rng.normal(size=(n, width))).astype(np.float32).astype(float)
    return x, x @ rng.normal(size=width) + 0.3, 0.5 + rng.random(n)


def both(spark, x, y, w, q=None):
    """The same rows as a dense and as a sparse table; zeros are missing in both."""
    q = np.zeros(len(x), int) if q is None else q
    width = x.shape[1]
    dense = [(i, float(y[i]), float(w[i]), int(q[i]), *[float(v) if v else None for v in x[i]]) for i in range(len(x))]
    cells = [(i, float(y[i]), float(w[i]), int(q[i]), np.flatnonzero(x[i])[::-1].tolist(), x[i][np.flatnonzero(x[i])[::-1]].tolist()) for i in range(len(x))]
    names = [f"f{k}" for k in range(width)]
    a = Dataset.of(spark.createDataFrame(dense, "row_id long, y double, w double, q long, " + ", ".join(f"{c} double" for c in names)), names, "row_id", label="y", weight="w")
    return a, SparseDataset(spark.createDataFrame(cells, SPARSE), width, label="y", weight="w")


def plain(p, o, x, y, w, rounds, base):
    """Every row's gradient follows each step."""
    b, weights = np.zeros(o.outputs), np.zeros((x.shape[1], o.outputs))
    for _ in range(rounds):
        m = base + b + x @ weights
        g, h = (v.reshape(len(x), -1) for v in o.np_gradient(m if o.outputs > 1 else m[:, 0], y, w))
        for k in range(o.outputs):
            gk, hk = g[:, k].copy(), h[:, k]
            d = -p.eta * gk.sum() / hk.sum()
            b[k] += d
            gk += hk * d
            for f in range(x.shape[1]):
                s, c, old = gk @ x[:, f], hk @ x[:, f] ** 2, weights[f, k]
                grid = [0.0, (c * old - s - p.alpha) / (c + p.reg_lambda), (c * old - s + p.alpha) / (c + p.reg_lambda)]
                loss = [(s * (v - old) + c * (v - old) ** 2 / 2 + p.alpha * abs(v) + p.reg_lambda * v * v / 2) for v in grid]
                d = p.eta * (grid[int(np.argmin(loss))] - old) if c >= 1e-5 else 0.0
                weights[f, k] += d
                gk += hk * x[:, f] * d
    return b, weights


@pytest.mark.parametrize("cells", [linear.CELLS, 9, 1])
@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic", "multi:softprob"])
def test_blocks_and_sparse_rows_equal_plain_descent(spark, monkeypatch, cells, objective):
    monkeypatch.setattr(linear, "HELD", 50)
    x, y, w = rows_of()
    x[:, 3] = 0  # never occurs
    if objective != "reg:squarederror":
        y = (np.argsort(np.argsort(y)) * (3 if objective.startswith("multi") else 2) // len(y)).astype(float)
    p = TrainingParams(booster="gblinear", objective=objective, eta=0.6, alpha=0.8, reg_lambda=0.5, num_class=3 if objective.startswith("multi") else 1)
    o = objectives.create(p)
    for d in both(spark, x, y, w):
        base = BoostedModel(p, o, 7, 0.1).base_score
        got = linear.fit_linear(p, o, boost._prepared(p, [d], o.outputs), 7, 3, base, cells)
        b, weights = plain(p, o, x, y, w, 3, base)
        np.testing.assert_allclose(got.weights, weights, atol=1e-5)
        np.testing.assert_allclose(got.bias, b, atol=1e-5)
        assert (got.weights[3] == 0).all()


def test_ranking_by_linear_scores(spark):
    x, y, w = rows_of(200, 4, 0.0)
    q = np.arange(200) // 10
    y = np.concatenate([np.argsort(np.argsort(y[q == k])) // 3 for k in range(20)]).astype(float)
    p = TrainingParams(booster="gblinear", objective="rank:pairwise", eta=0.5)
    models = [boost.train(p, d.with_(qid="q", weight=None), 5).model for d in both(spark, x, y, w, q)]
    np.testing.assert_allclose(models[0].linear.weights, models[1].linear.weights, atol=1e-5)
    m = x @ models[0].linear.weights[:, 0]
    higher = [(m[i] > m[j]) for k in range(20) for i in np.flatnonzero(q == k) for j in np.flatnonzero(q == k) if y[i] > y[j]]
    assert np.mean(higher) > 0.95


def test_a_hundred_thousand_sparse_features(spark):
    """50 cells a row over 10^5 features; memory is a block's, jobs are one a block."""
    n, width = 4000, 100_000
    made = spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(width)).cast("int")).alias("noise"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 - 0.5).alias("a"))
    made = made.select("row_id", (3 * F.col("a") + 1).alias("y"), F.concat(F.array(F.lit(width - 1)), F.filter("noise", lambda f: f != width - 1)).alias("indices"), F.concat(F.array("a"), F.array_repeat(F.lit(0.01), 50)).alias("values"))
    d = SparseDataset(made.withColumn("values", F.slice("values", 1, F.size("indices"))), width, label="y")
    began = time.monotonic()
    m = boost.train(TrainingParams(booster="gblinear", eta=1.0, reg_lambda=0.1), d, 2).model
    assert time.monotonic() - began < 240
    assert m.linear.weights.shape == (width, 1) and abs(m.linear.weights[-1, 0] - 3) < 0.3
    off = m.predict(d, ("row_id", "y")).select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off < 0.3


def test_odd_sparse_rows(spark):
    """Null values, NaN and repeated cells count as in trees: missing, and the first of a feature."""
    schema = "row_id long, y double, indices array<int>, values array<double>"
    odd = [(1, 2.0, [2, 0, 2], [1.0, None, 9.0]), (2, 1.0, [], []), (3, 4.0, [1, 0], [float("nan"), 2.0])]
    same = [(1, 2.0, [2], [1.0]), (2, 1.0, [], []), (3, 4.0, [0], [2.0])]
    p = TrainingParams(booster="gblinear")
    a, b = (boost.train(p, SparseDataset(spark.createDataFrame(r, schema), 3, label="y"), 2).model.linear for r in (odd, same))
    np.testing.assert_allclose(a.weights, b.weights)
    np.testing.assert_allclose(a.bias, b.bias)
    for f in (3, -1):
        with pytest.raises(FeatureOutOfBounds):
            boost.train(p, SparseDataset(spark.createDataFrame([(1, 1.0, [f], [1.0])], schema), 3, label="y"), 1)
