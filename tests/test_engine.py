"""The engine against closed forms, brute force and itself under other partitionings."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradloom import interop, shap
from gradloom.dataset import Dataset
from gradloom.errors import DimensionMismatch, EmptyDataset, FeatureOutOfBounds, InvalidParameter, ModelFormatError, ParseError, UnknownName
from gradloom.functions import gain, metrics, objectives
from gradloom.model import BoostedModel
from gradloom.params import TrainingParams
from gradloom.operators import running, trees
from gradloom.plans import boost, cv, kernel
from gradloom.plans.kernel import Cuts, Tree, make_cuts, np_lambda, np_metric
from gradloom.sources import files


def frame(n=400, seed=0, holes=0.05):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4)).astype(np.float32)
    x[rng.random((n, 4)) < holes] = np.nan
    y = 2 * np.nan_to_num(x[:, 0]) - 3 * np.nan_to_num(x[:, 1]) ** 2 + 0.05 * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(4)])
    pdf["row_id"], pdf["y"], pdf["c"], pdf["q"], pdf["cat"] = range(n), y, (y > y.mean()).astype(float), np.arange(n) // 10, np.arange(n) % 4
    pdf["k"], pdf["bm"] = np.digitize(y, np.quantile(y, [0.33, 0.66])).astype(float), 0.01 * np.arange(n) - 1
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.of(spark.createDataFrame(frame()).repartition(3), [f"f{i}" for i in range(4)], "row_id", label="y")


def margins(model, d):
    return np.array(model.predict_margin(d).orderBy("row_id").toPandas()["margin"].tolist(), float)


@pytest.mark.parametrize(
    "more",
    [{}, {"tree_method": "exact"}, {"grow_policy": "lossguide", "max_leaves": 5}, {"objective": "rank:ndcg"}, {"subsample": 0.6, "colsample_bynode": 0.5}],
)
def test_one_task_and_many_agree(data, more):
    p = TrainingParams(max_depth=2, **more)
    d = data.with_(label={"multi:softprob": "k", "rank:ndcg": "k"}.get(p.objective, "y"), qid="q" if p.objective[:4] == "rank" else None)
    one, many = boost.train(p, d, 2), boost.train(p, d, 2, backend="arrow")
    np.testing.assert_allclose(margins(one.model, d), margins(many.model, d), atol=1e-6)


@pytest.mark.parametrize(("kind", "seed"), [("rank:ndcg", 0), ("rank:map", 9)])
def test_drawn_pairs_are_the_same_in_one_task_and_many(spark, kind, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"row_id": range(360), "f0": rng.random(360).astype(np.float32), "f1": rng.random(360).astype(np.float32), "q": [0] * 300 + [1] * 60, "y": rng.integers(0, 4, 360).astype(float)})
    d = Dataset.of(spark.createDataFrame(pdf).repartition(3), ["f0", "f1"], "row_id", label="y", qid="q")
    p = TrainingParams(objective=kind, max_depth=2, seed=seed)
    one, many = boost.train(p, d, 2), boost.train(p, d, 2, backend="arrow")
    np.testing.assert_allclose(margins(one.model, d), margins(many.model, d), atol=1e-6)
    other = boost.train(p.with_(seed=seed + 1), d, 2)
    assert np.abs(margins(one.model, d) - margins(other.model, d)).max() > 1e-6
    whole = [boost.train(p.with_(max_pairs=0), d, 2, backend=b) for b in ("arrow", "task")]
    np.testing.assert_allclose(margins(whole[0].model, d), margins(whole[1].model, d), atol=1e-6)


def test_draws_are_even_and_no_more_than_asked_for():
    n, want = 101, 20_000
    times = np.zeros((n, n))
    for seed in range(50):
        a, b = kernel.drawn_pairs(n, 400, seed)
        assert len(a) == 400 and (a != b).all()
        np.add.at(times, (np.minimum(a, b), np.maximum(a, b)), 1)
    assert times.sum() == want
    got = times[np.triu_indices(n, 1)]
    assert abs(got.var() / got.mean() - 1) < 0.25  # as many as independent draws would vary


def test_folds_and_samples_take_any_ids(spark):
    ids = spark.range(12, numPartitions=3).select(F.monotonically_increasing_id().alias("row")).union(spark.createDataFrame([(-5,), (2**62,)], "row long"))
    got = ids.select("row", trees.fold_of(F.col("row"), 3, 1).alias("fold"), trees.keeps_row(F.col("row"), 0.5, 2, 3).alias("kept")).toPandas()
    assert got["fold"].between(0, 2).all()
    assert boost.sampled(got["row"].to_numpy(), 0.5, 2, 3).tolist() == got["kept"].tolist()


def test_cross_validation_of_a_read_table(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("y,f0\n" + "\n".join(f"{int(i >= 10)},{i + k / 10}" for i in range(20)) + "\n")
    d = files.read_csv(spark, str(tmp_path), header=True)
    got = cv.cross_validate(spark, TrainingParams(max_depth=1), d, 2, folds=2).collect()
    assert len(got) == 2


def test_folds_at_once_or_one_by_one(spark, data, monkeypatch):
    monkeypatch.setattr(boost, "TASK_BYTES", 0)
    one, many = (cv.cross_validate(spark, TrainingParams(max_depth=2), data, 2, 3, parallelism=n).orderBy("iteration").collect() for n in (1, 3))
    assert len(one) == 2
    np.testing.assert_allclose([r[2:] for r in one], [r[2:] for r in many], rtol=1e-9)
    with pytest.raises(InvalidParameter):
        cv.cross_validate(spark, TrainingParams(), data, 1, parallelism=0)


def test_running_sums_cross_buckets(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKETS", 7)
    rng = np.random.default_rng(3)
    v = rng.integers(0, 400, 1000)
    pdf = pd.DataFrame({"k": np.unique(v), "n": rng.integers(0, 9, len(np.unique(v)))})
    for ascending in (True, False):
        got = running.running_sums(spark.createDataFrame(pdf).repartition(5), "k", {"upto": "n"}, ascending).toPandas().sort_values("k", ascending=ascending)
        assert (got["upto"] == got["n"].cumsum()).all()
    assert running.running_sums(spark.createDataFrame(pdf).limit(0), "k", {"upto": "n"}).count() == 0


def test_ranking_metrics_of_one_long_list(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKETS", 5)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"r": range(500), "p": rng.integers(0, 50, 500) / 7, "y": rng.integers(0, 3, 500).astype(float)})
    d = spark.createDataFrame(pdf).repartition(4)
    for name in ("ndcg", "map", "ndcg@5", "map@3", "auc", "aucpr"):
        got = metrics.create(name).value(d, "p", "y", order="r")
        assert abs(got - np_metric(name, pdf["p"].to_numpy(), pdf["y"].to_numpy(), np.ones(500))) < 1e-9
        if name[:3] in ("ndc", "map"):
            assert abs(metrics.create(name).value(d.withColumn("q", F.lit(3)), "p", "y", group="q", order="r") - got) < 1e-9


def test_fits_a_step(spark):
    d = files.from_dense(spark, [[i / 100] for i in range(100)])
    d = d.with_(frame=d.frame.selectExpr("*", "cast(f0 >= 0.5 as double) y"), label="y")
    for method in ("hist", "exact", "approx"):
        got = boost.train(TrainingParams(max_depth=2, tree_method=method), d, 20, [("t", d)])
        assert got.history[-1][3] < 0.05
        assert got.history[-1][3] <= got.history[0][3]


def test_monotone_and_interactions_hold_for_hist_and_exact(spark, data):
    grid = np.full((50, 4), 0.5, np.float32)
    grid[:, 0] = np.linspace(0, 1, 50)
    for method in ("hist", "exact"):
        m = boost.train(TrainingParams(max_depth=3, tree_method=method, monotone_constraints=(-1, 0, 0, 0)), data, 5).model
        assert (np.diff(m.np_margin(grid)[:, 0]) <= 1e-9).all()
        m = boost.train(TrainingParams(max_depth=3, tree_method=method, interaction_constraints=((0, 1), (2, 3))), data, 5).model
        for t in m.trees:
            for path in _paths(t):
                assert path <= {0, 1} or path <= {2, 3}


def _paths(t, k=0, met=frozenset()):
    if t.left[k] < 0:
        return [met]
    return _paths(t, t.left[k], met | {t.feature[k]}) + _paths(t, t.right[k], met | {t.feature[k]})


def test_categories_split_by_set(spark):
    pdf = pd.DataFrame({"row_id": range(160), "f0": [float(i % 4) for i in range(160)], "y": [float(i % 2) for i in range(160)]})
    d = Dataset.of(spark.createDataFrame(pdf), ["f0"], "row_id", label="y", categorical=frozenset([0]))
    for method in ("hist", "exact"):
        m = boost.train(TrainingParams(max_depth=1, tree_method=method, eta=1.0), d, 3).model
        assert np.abs(m.np_margin(pdf[["f0"]].to_numpy(np.float32))[:, 0] - pdf["y"]).max() < 0.05
        c = shap.contributions(m, np.array([[0], [1], [np.nan]], np.float32))
        np.testing.assert_allclose(c.sum(2)[:, 0], m.np_margin(np.array([[0], [1], [np.nan]], np.float32))[:, 0], atol=1e-9)
        with pytest.raises(ModelFormatError):
            interop.export_json(m)


def test_contributions_are_shapley_values(data):
    m = boost.train(TrainingParams(max_depth=3), data, 2).model
    x = frame(6)[[f"f{i}" for i in range(4)]].to_numpy(np.float32)

    def known(t, k, s, row):
        if t.left[k] < 0:
            return t.value[k]
        f, v = t.feature[k], row[t.feature[k]]
        if f in s:
            left = t.default_left[k] if np.isnan(v) else v < np.float32(t.threshold[k])
            return known(t, t.left[k] if left else t.right[k], s, row)
        a, b = t.hess[t.left[k]], t.hess[t.right[k]]
        return (a * known(t, t.left[k], s, row) + b * known(t, t.right[k], s, row)) / (a + b)

    got = shap.contributions(m, x)
    for r, row in enumerate(x):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(factorial(n) * factorial(3 - n) / 24 * sum(known(t, 0, {*s, f}, row) - known(t, 0, set(s), row) for t in m.trees) for n in range(4) for s in combinations(rest, n))
            assert abs(got[r, 0, f] - want) < 1e-9
    inter = shap.interactions(m, x)
    np.testing.assert_allclose(inter[:, :, :4, :4].sum(3), got[:, :, :4], atol=1e-9)
    np.testing.assert_allclose(inter, np.swapaxes(inter, 2, 3), atol=1e-12)


def test_dart_contributions_base_margin_and_early_stopping(data):
    d = data.with_(base_margin="bm")
    m = boost.train(TrainingParams(max_depth=2, booster="dart", rate_drop=0.5), d, 4).model
    rows = m.contributions(d, ("row_id", "bm")).orderBy("row_id").collect()
    np.testing.assert_allclose([sum(r["contributions"][0]) for r in rows], margins(m, d), atol=1e-4)
    noise = data.with_(frame=data.frame.selectExpr("*", "cast(pmod(row_id * 7919, 13) as double) z"), label="z")
    got = boost.train(TrainingParams(max_depth=6, eta=0.5), noise.select_rows(noise.frame["row_id"] % 2 == 0), 30, [("t", noise.select_rows(noise.frame["row_id"] % 2 == 1))], patience=3)
    assert got.model.best_iteration is not None
    assert got.model.used_trees() == got.model.best_iteration + 1 < got.model.rounds


def test_linear_fits(data):
    lin = data.with_(frame=data.frame.selectExpr("*", "2 * coalesce(f0, 0) - 3 * coalesce(f1, 0) + 0.5 z"), label="z")
    m = boost.train(TrainingParams(booster="gblinear", eta=0.8, reg_lambda=0.0), lin, 30).model
    np.testing.assert_allclose(m.linear.weights[:2, 0], [2, -3], atol=0.05)
    with pytest.raises(ModelFormatError):
        m.contributions(lin)


def test_storage_round_trips(spark, data, tmp_path):
    m = boost.train(TrainingParams(objective="binary:logistic", max_depth=2), data.with_(label="c"), 3).model
    x = frame(20)[[f"f{i}" for i in range(4)]].to_numpy(np.float32)
    m.save(str(tmp_path / "m.json"))
    m.save(str(tmp_path / "m.bin"))
    m.write_table(spark, str(tmp_path / "t"))
    for back in (BoostedModel.load(str(tmp_path / "m.json")), BoostedModel.load(str(tmp_path / "m.bin")), BoostedModel.read_table(spark, str(tmp_path / "t")), interop.import_json(interop.export_json(m))):
        np.testing.assert_allclose(back.np_margin(x), m.np_margin(x), atol=1e-6)
    for bad in ("{}", "no"):
        with pytest.raises(ModelFormatError):
            BoostedModel.from_json(bad)
        with pytest.raises(ModelFormatError):
            interop.import_json(bad)


@pytest.mark.parametrize("name", ["count:poisson", "reg:gamma", "reg:tweedie"])
def test_log_links_survive_the_interchange(data, name):
    d = data.with_(frame=data.frame.selectExpr("*", "abs(y) + 0.1 z"), label="z")
    m = boost.train(TrainingParams(objective=name, max_depth=2), d, 2).model
    assert abs(interop.import_json(interop.export_json(m)).base_score - m.base_score) < 1e-9


def test_custom_objective_keeps_its_transform(data):
    o = objectives.custom("mine", lambda x, m, y, w: ((m - y) * w, x.ones(m) * w), transform=lambda x, m: m * 2.0)
    m = boost.train(TrainingParams(objective="mine", max_depth=2), data, 2, objective=o).model
    back = BoostedModel.from_bytes(m.to_bytes(), trust=True)
    p = np.array(back.predict(data).orderBy("row_id").toPandas()["prediction"], float)
    np.testing.assert_allclose(p, 2 * margins(m, data), atol=1e-5)


def test_cross_validation_keeps_queries_together(spark, data):
    got = cv.cross_validate(spark, TrainingParams(objective="rank:ndcg", max_depth=2), data.with_(label="k", qid="q"), 2, 3).collect()
    assert {r["iteration"] for r in got} == {0, 1}
    assert all(0 < r["test_mean"] <= 1 for r in got)


def test_rejections(spark, data):
    for bad in ({"eta": 0}, {"subsample": 0}, {"max_bin": 1}, {"grow_policy": "lossguide", "max_depth": 0}, {"tree_method": "exact", "grow_policy": "lossguide"}, {"alpha": -1}):
        with pytest.raises(InvalidParameter):
            TrainingParams(**bad)
    with pytest.raises(UnknownName):
        objectives.create(TrainingParams(objective="none"))
    with pytest.raises(UnknownName):
        metrics.create("none")
    with pytest.raises(InvalidParameter):
        objectives.create(TrainingParams(objective="binary:logistic", num_class=2))
    with pytest.raises(InvalidParameter):
        boost.train(TrainingParams(objective="multi:softprob", num_class=2), data.with_(label="k"), 1)
    with pytest.raises(EmptyDataset):
        boost.train(TrainingParams(), data.select_rows(data.frame["row_id"] < 0), 1)
    with pytest.raises(EmptyDataset):
        files.from_dense(spark, [])
    with pytest.raises(FeatureOutOfBounds):
        files.from_csr(spark, [0, 1], [5], [1.0], 2)
    with pytest.raises(DimensionMismatch):
        files.from_csr(spark, [0, 2], [0], [1.0], 2)
    m = boost.train(TrainingParams(max_depth=1), data, 1).model
    with pytest.raises(DimensionMismatch):
        m.predict_margin(Dataset(data.frame, ("f0",), "row_id"))
    assert issubclass(ParseError, ValueError)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("y,f0,f1\n1,2,3\n0,,NA\n")
    d = files.read_csv(spark, str(tmp_path / "a.csv"), header=True)
    assert [tuple(r) for r in d.frame.select("label", "f0", "f1").orderBy("label").collect()] == [(0.0, None, None), (1.0, 2.0, 3.0)]
    (tmp_path / "b.csv").write_text("1,2,3\n0,1\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST|malformed"):
        files.read_csv(spark, str(tmp_path / "b.csv")).frame.collect()
    (tmp_path / "c.svm").write_text("# note\n1 0:1.5 2:3.0\n\n0 1:2.0\n")
    d = files.read_libsvm(spark, str(tmp_path / "c.svm"))
    assert [tuple(r) for r in d.frame.select("label", "f0", "f1", "f2").orderBy("label").collect()] == [(0.0, None, 2.0, None), (1.0, 1.5, None, 3.0)]
    (tmp_path / "d.svm").write_text("1 nonsense\n")
    with pytest.raises(Exception, match="index:value"):
        files.read_libsvm(spark, str(tmp_path / "d.svm"))


def test_sparse_equals_dense(spark):
    a = files.from_csr(spark, [0, 2, 3], [0, 2, 1], [1.5, 3.0, 2.0], 3)
    b = files.from_dense(spark, [[1.5, float("nan"), 3.0], [float("nan"), 2.0, float("nan")]])
    assert a.frame.orderBy("row_id").collect() == b.frame.orderBy("row_id").collect()
    assert a.long().count() == 3


def test_gain_in_both_forms(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    g, h = rng.normal(size=50), rng.random(50) * 3
    p = TrainingParams(alpha=0.2, max_delta_step=0.3, min_child_weight=0.5)
    got = spark.createDataFrame(pd.DataFrame({"g": g, "h": h})).select(gain.leaf_weight(F.col("g"), F.col("h"), p).alias("w"), gain.structure_score(F.col("g"), F.col("h"), p).alias("s")).toPandas()
    np.testing.assert_allclose(got["w"], gain.np_weight(g, h, p), atol=1e-12)
    np.testing.assert_allclose(got["s"], gain.np_score(g, h, p), atol=1e-12)


@pytest.mark.parametrize("name", ["rmse", "mae", "logloss", "error", "auc", "aucpr", "ndcg@3", "map@2", "poisson-nloglik", "gamma-nloglik", "tweedie-nloglik@1.3"])
def test_metrics_in_both_forms(spark, name):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"p": np.round(rng.random(200), 2), "y": (rng.random(200) < 0.4).astype(float), "w": rng.random(200), "q": np.arange(200) // 10, "r": np.arange(200)})
    if name.startswith("gamma"):
        pdf["y"] += 0.5
    got = metrics.create(name).value(spark.createDataFrame(pdf).repartition(3), "p", "y", "w", "q", "r")
    assert abs(got - np_metric(name, *(pdf[c].to_numpy() for c in ("p", "y", "w", "q")))) < 1e-9


def test_swapping_changes_average_precision_as_the_gradient_says():
    rng = np.random.default_rng(3)

    def ap(rel):
        return ((np.cumsum(rel) / (np.arange(len(rel)) + 1)) * rel).sum() / rel.sum()

    for _ in range(20):
        y = (rng.random(8) < 0.5).astype(float)
        if not 0 < y.sum() < 8:
            continue
        m = rng.normal(size=8)
        g, _ = np_lambda("map", m, y, np.ones(8), np.zeros(8, int), np.arange(8))
        order = np.argsort(-m)
        want = np.zeros(8)
        for i in range(8):
            for j in range(8):
                if y[i] > y[j]:
                    swapped = order.copy()
                    a, b = np.flatnonzero(order == i)[0], np.flatnonzero(order == j)[0]
                    swapped[a], swapped[b] = swapped[b], swapped[a]
                    d = abs(ap(y[order]) - ap(y[swapped])) / (1 + np.exp(m[i] - m[j]))
                    want[i] -= d
                    want[j] += d
        np.testing.assert_allclose(g, want, atol=1e-6)


def test_cuts_and_bins():
    x = np.array([[1.0], [2.0], [2.0], [5.0], [np.nan]], np.float32)
    c = make_cuts(x, 256, frozenset())
    assert c.cuts[0][:-1].tolist() == [1, 2, 5]
    assert c.cuts[0][-1] == np.nextafter(np.float32(5), np.float32(np.inf))
    assert c.bins(x)[:, 0].tolist() == [1, 2, 2, 3, -1]
    assert Cuts([np.array([1.0, 3.0], np.float32)], frozenset([0])).bins(np.array([[3.0], [9.0]], np.float32))[:, 0].tolist() == [1, 0]


def test_missing_goes_where_it_gains(spark):
    d = files.from_dense(spark, [[0.0], [1.0], [float("nan")]])
    d = d.with_(frame=d.frame.selectExpr("*", "case when f0 = 0 then 0.0 else 1.0 end y"), label="y")
    for method in ("hist", "exact"):
        t: Tree = boost.train(TrainingParams(max_depth=1, tree_method=method, min_child_weight=0), d, 1).model.trees[0]
        assert not t.default_left[0]


def test_importance_and_classes(spark, data):
    m = boost.train(TrainingParams(max_depth=2), data, 3).model
    inner = sum(v >= 0 for t in m.trees for v in t.left)
    assert sum(r["importance"] for r in m.importance(spark, "weight").collect()) == inner
    with pytest.raises(UnknownName):
        m.importance(spark, "none")
    assert {r["class"] for r in boost.train(TrainingParams(objective="multi:softmax", num_class=3, max_depth=2), data.with_(label="k"), 3).model.predict_class(data).collect()} == {0, 1, 2}


def test_dart_weights_come_from_training(spark, sf, monkeypatch):
    from gradloom import queries

    calls, train = [], boost.train
    monkeypatch.setattr(boost, "train", lambda p, *a, **k: calls.append(p.booster) or train(p, *a, **k))
    row = queries.queries()["dart_weights"](spark, sf).collect()[0]
    assert calls == ["dart", "dart"]
    assert (row["dropped"], row["new_weight"], row["kept_share"]) == (2, round(1 / 3, 9), round(2 / 3, 9))
