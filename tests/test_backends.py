"""The backends against each other, sparse rows against dense ones, and growth against itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradloom.dataset import Dataset, SparseDataset
from gradloom.errors import FeatureOutOfBounds, InvalidParameter, ModelFormatError
from gradloom.functions import objectives
from gradloom.model import BoostedModel
from gradloom.operators import trees
from gradloom.params import TrainingParams
from gradloom.plans import backends, bins, boost, growth, kernel
from gradloom.sources import files


def table(n=400, seed=0, holes=0.05):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4)).astype(np.float32)
    x[rng.random((n, 4)) < holes] = np.nan
    y = 2 * np.nan_to_num(x[:, 0]) - 3 * np.nan_to_num(x[:, 1]) ** 2 + 0.05 * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(4)])
    pdf["row_id"], pdf["y"], pdf["c"], pdf["q"], pdf["cat"] = range(n), y, (y > y.mean()).astype(float), np.arange(n) // 10, (np.arange(n) * 7 % 5).astype(float)
    pdf["k"], pdf["bm"] = np.digitize(y, np.quantile(y, [0.33, 0.66])).astype(float), 0.01 * np.arange(n) - 1
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.of(spark.createDataFrame(table()).repartition(3), [f"f{i}" for i in range(4)], "row_id", label="y")


def margins(model, d):
    return np.array(model.predict_margin(d).orderBy("row_id").toPandas()["margin"].tolist(), float)


def alike(p, d, rounds=2, which="arrow"):
    one, many = (margins(boost.train(p, d, rounds, backend=b).model, d) for b in ("task", which))
    np.testing.assert_allclose(one, many, atol=1e-6)
    return one


@pytest.mark.parametrize(
    ("more", "which"),
    [({"booster": "dart", "rate_drop": 0.5, "skip_drop": 0.2}, "arrow"), ({"objective": "multi:softprob", "num_class": 3, "subsample": 0.7}, "arrow"), ({"tree_method": "approx", "max_bin": 8, "objective": "binary:logistic"}, "arrow"), ({"monotone_constraints": (1, -1, 0, 0), "gamma": 0.01, "alpha": 0.1}, "arrow"),
     ({"interaction_constraints": ((0, 1), (2, 3)), "colsample_bylevel": 0.5, "max_delta_step": 0.3}, "arrow"), ({"grow_policy": "lossguide", "max_leaves": 3, "max_depth": 0}, "catalyst"), ({"tree_method": "exact", "monotone_constraints": (0, 1, 0, 0), "subsample": 0.5}, "catalyst")],
)
def test_backends_agree(data, more, which):
    p = TrainingParams(**({"max_depth": 2} | more))
    d = data.with_(label={"multi:softprob": "k", "binary:logistic": "c"}.get(p.objective, "y"), base_margin="bm" if not more.get("num_class") else None)
    if p.objective == "binary:logistic":
        d = d.with_(weight="w", frame=d.frame.withColumn("w", 1 + F.col("row_id") % 3))
    alike(p, d, 3 if which == "arrow" else 1, which)


@pytest.mark.parametrize(("method", "which"), [("hist", "arrow"), ("hist", "catalyst"), ("exact", "catalyst")])
def test_backends_agree_on_categories(data, method, which):
    d = data.with_(features=("f0", "cat", "f1"), categorical=frozenset({1}), frame=data.frame.withColumn("y", F.col("y") + F.when(F.col("cat").isin(1, 3), 1).otherwise(0)))
    alike(TrainingParams(max_depth=2, tree_method=method), d, 1, which)


def test_an_empty_sample_keeps_the_smallest_hash(data):
    p = TrainingParams(max_depth=2, subsample=1e-7, min_child_weight=0)
    got = alike(p, data, 1)
    row = data.frame.select("row_id").toPandas()["row_id"].to_numpy()
    least = row[boost.hashed(row, 0, 0).argmin()]
    y = table()["y"].to_numpy()
    np.testing.assert_allclose(got, y.mean() + 0.3 * (y[least] - y.mean()) / 2, atol=1e-5)


def test_repeated_ids_of_ranked_rows(spark):
    pdf = table(120)
    pdf["row_id"], pdf["q"] = np.arange(120) // 3, np.arange(120) // 30
    d = Dataset.of(spark.createDataFrame(pdf), ["f0", "f1"], "row_id", label="k", qid="q")
    p = TrainingParams(objective="rank:ndcg", max_depth=2)
    one, many = (boost.train(p, d, 2, backend=b).model for b in ("task", "arrow"))
    assert one.trees[0].hess[0] == pytest.approx(many.trees[0].hess[0], rel=1e-6) and one.trees[0].feature == many.trees[0].feature
    np.testing.assert_allclose(one.np_margin(pdf[["f0", "f1"]].to_numpy()), many.np_margin(pdf[["f0", "f1"]].to_numpy()), atol=1e-6)


def test_exact_over_more_values_than_a_driver_should_hold(spark):
    n = (1 << 20) + 5000
    frame = spark.range(n).select(F.col("id").alias("row_id"), (F.pmod(F.col("id") * 7919, F.lit(n)) * 2.0**-3).cast("float").alias("f0"))
    d = Dataset(frame.withColumn("y", F.when(F.col("f0") < 50_000, 1.0).when(F.col("f0") > 90_000, 3.0).otherwise(0.0)), ("f0",), label="y")
    one, many = (boost.train(TrainingParams(tree_method="exact", max_depth=2), d, 1, backend=b).model.trees[0] for b in ("task", "catalyst"))
    assert one.threshold == many.threshold and one.left == many.left
    np.testing.assert_allclose(one.value, many.value, atol=1e-6)


def test_exact_running_sums_cross_ranges(spark):
    rng = np.random.default_rng(2)
    stats = pd.DataFrame({"node": rng.integers(0, 3, 300), "feature": rng.integers(0, 2, 300), "value": rng.integers(0, 90, 300).astype(np.float32), "g": rng.normal(size=300), "h": np.ones(300)}).groupby(["node", "feature", "value"], as_index=False).sum()
    totals = stats[stats.feature == 0].groupby("node", as_index=False)[["g", "h"]].sum().rename(columns={"g": "gt", "h": "ht"})
    totals[["gt", "ht"]] += 5.0
    s, t = spark.createDataFrame(stats), spark.createDataFrame(totals)
    ranges = spark.createDataFrame([(0, [10.0, 33.0, 34.0, 80.0])], "feature long, bounds array<float>")
    keys = ["node", "feature", "threshold", "default_left"]
    a, b = (trees.exact_splits(s, t, TrainingParams(), ranges=r).select(*keys, "gain").toPandas().sort_values(keys).reset_index(drop=True) for r in (None, ranges))
    pd.testing.assert_frame_equal(a, b, atol=1e-9)
    assert len(a) > 100


def test_many_blocks_and_searches_give_the_same_tree(data, monkeypatch):
    p = TrainingParams(max_depth=4, colsample_bynode=0.75)
    one = margins(boost.train(p, data, 1, backend="arrow").model, data)
    monkeypatch.setattr(backends, "BLOCK_CELLS", 100)
    monkeypatch.setattr(backends, "TASK_CELLS", 3000)
    np.testing.assert_allclose(one, margins(boost.train(p, data, 1, backend="arrow").model, data), atol=1e-6)


def test_records_pick_what_one_scan_does():
    rng = np.random.default_rng(5)
    for _ in range(300):
        gain = rng.choice([0.5, 1.0, 1.0 + 5e-7, 1.0 + 1.2e-6, 2.0, -1.0], 40) + rng.choice([0, 3e-7], 40)
        want = kernel._first_best(gain)
        cut = int(rng.integers(0, 41))
        found = [kernel.Split(gain[k], bin=int(k)) for part, at in ((gain[:cut], 0), (gain[cut:], cut)) for k in kernel._records(part) + at] if cut not in (0, 40) else [kernel.Split(gain[k], bin=int(k)) for k in kernel._records(gain)]
        assert kernel.pick(found, kernel.Split()).bin == want


def test_lossguide_searches_many_leaves_at_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((3000, 3)).astype(np.float32)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(row_id=range(3000), y=np.sin(9 * x[:, 0]) + np.cos(14 * x[:, 1] * x[:, 2]))
    d = Dataset(spark.createDataFrame(pdf), ("f0", "f1", "f2"), label="y")
    p = TrainingParams(grow_policy="lossguide", max_leaves=255, max_depth=0)
    made = []
    own = backends.ArrowBackend.best
    monkeypatch.setattr(backends.ArrowBackend, "best", lambda self, growths: made.append(len(growths[0].asked)) or own(self, growths))
    one, many = (boost.train(p, d, 1, backend=b).model.trees[0] for b in ("task", "arrow"))
    assert len(made) < 30 and sum(k < 0 for k in many.left) == 255
    assert one.feature == many.feature and one.bin == many.bin and one.left == many.left
    monkeypatch.setattr(growth, "AHEAD", 1)
    small = p.with_(max_leaves=12)
    assert boost.train(small, d, 1, backend="arrow").model.trees[0].left == boost.train(small, d, 1, backend="task").model.trees[0].left


def test_outputs_grow_in_the_same_jobs(data, monkeypatch):
    made = []
    own = backends.ArrowBackend._search
    monkeypatch.setattr(backends.ArrowBackend, "_search", lambda self, growths, asked: made.append({k for k, _ in asked}) or own(self, growths, asked))
    boost.train(TrainingParams(objective="multi:softprob", num_class=3, max_depth=3), data.with_(label="k"), 1, backend="arrow")
    assert len(made) == 3 and made[0] == {0, 1, 2}


# equal rows


def repeated(spark, times=12):
    """50 different rows, each of them so many times, with other ids."""
    pdf = pd.concat([table(50, holes=0.1)] * times, ignore_index=True)
    pdf["row_id"], pdf["w"] = range(len(pdf)), 1.0 + pdf["q"] % 2
    return Dataset.of(spark.createDataFrame(pdf).repartition(3), [f"f{i}" for i in range(4)], "row_id", label="y", weight="w")


@pytest.mark.parametrize(
    ("backend", "more"),
    [("task", {"max_bin": 8, "base_margin": "bm"}), ("task", {"tree_method": "approx", "max_bin": 8, "objective": "binary:logistic"}), ("arrow", {"max_bin": 8}), ("arrow", {"objective": "multi:softprob", "num_class": 3, "booster": "dart", "rate_drop": 0.5}), ("catalyst", {"tree_method": "exact", "min_child_weight": 20.0})],
)
def test_equal_rows_are_merged_with_their_sums(spark, monkeypatch, backend, more):
    more = dict(more)
    d = repeated(spark).with_(base_margin=more.pop("base_margin", None))
    p = TrainingParams(max_depth=2, **more)
    d = d.with_(label={"multi:softprob": "k", "binary:logistic": "c"}.get(p.objective, "y"))
    held = []
    own = boost._merged
    monkeypatch.setattr(boost, "_merged", lambda *a: held.append(own(*a)) or held[-1])
    other = d.select_rows(F.col("row_id") < 400)
    one = boost.train(p, d, 2, [("other", other)], backend=backend)
    assert held and held[0].groupBy("set").count().toPandas()["count"].max() == 50 and held[0].agg(F.sum("n")).collect()[0][0] == 1000
    monkeypatch.setattr(boost, "MERGE_FROM", 1000)
    many = boost.train(p, d, 2, [("other", other)], backend=backend)
    assert len(held) == 1
    np.testing.assert_allclose(margins(one.model, d), margins(many.model, d), atol=1e-6)
    np.testing.assert_allclose([h[3] for h in one.history], [h[3] for h in many.history], atol=1e-6)


def test_what_tells_equal_rows_apart_keeps_them(spark, monkeypatch):
    held = []
    own = boost._merged
    monkeypatch.setattr(boost, "_merged", lambda frame, which, n: held.append(which) or own(frame, which, n))
    d = repeated(spark).with_(label="c")
    p = TrainingParams(objective="binary:logistic", max_depth=2, eval_metric=("auc",))
    one = boost.train(p, d, 2, [("t", d)])
    boost.train(p.with_(subsample=0.5, eval_metric=()), d, 1)
    boost.train(p.with_(objective="rank:ndcg", eval_metric=()), d.with_(qid="q"), 1)
    assert held == [[0]]
    monkeypatch.setattr(boost, "MERGE_FROM", 1000)
    many = boost.train(p, d, 2, [("t", d)])
    np.testing.assert_allclose([h[3] for h in one.history], [h[3] for h in many.history], atol=1e-9)


@pytest.mark.parametrize("backend", ["task", "arrow"])
def test_data_that_is_evaluated_is_kept_once(data, monkeypatch, backend):
    held = []
    own = boost._prepared
    monkeypatch.setattr(boost, "_prepared", lambda p, sets, outputs: held.append(len(sets)) or own(p, sets, outputs))
    other = data.select_rows(F.col("row_id") % 3 == 0)
    p = TrainingParams(max_depth=2)
    got = boost.train(p, data, 2, [("train", data), ("other", other), ("again", other)], backend=backend).history
    far = boost.train(p, data, 2, [("train", data.with_(frame=data.frame.where("row_id >= 0"))), ("other", other)], backend=backend).history
    assert held == [2, 3] and [h[1] for h in got] == ["train", "other", "again"] * 2
    value = {(turn, name): v for turn, name, _, v in got}
    np.testing.assert_allclose([value[turn, name] for turn, name, *_ in far], [h[3] for h in far], atol=1e-9)
    assert value[1, "again"] == value[1, "other"] != value[1, "train"]


def test_a_table_that_no_task_should_hold_is_not_given_to_one(data, monkeypatch):
    p = TrainingParams(max_depth=3)
    one = margins(boost.train(p, data, 2, backend="task").model, data)
    made = []
    own = boost.SparkEngine
    monkeypatch.setattr(boost, "SparkEngine", lambda *a: made.append(a[-1]) or own(*a))
    monkeypatch.setattr(boost, "TASK_MOST", 400 * 10 * 8 - 1)
    np.testing.assert_allclose(one, margins(boost.train(p, data, 2, backend="task").model, data), atol=1e-6)
    assert made == ["task"]


# sparse rows


def sparse_of(spark, pdf, width, names, extra=()):
    cells = [[(i, float(v)) for i, v in zip(names, r, strict=True) if v == v] for r in pdf[[f"f{k}" for k in range(len(names))]].to_numpy()]
    rows = [(int(k), float(y), [i for i, _ in c], [v for _, v in c]) for k, y, c in zip(pdf["row_id"], pdf["y"], cells, strict=True)]
    return SparseDataset(spark.createDataFrame([*rows, *extra], "row_id long, y double, indices array<int>, values array<double>"), width, label="y")


@pytest.mark.parametrize("more", [{}, {"tree_method": "approx", "max_bin": 16}, {"booster": "dart", "rate_drop": 0.5}, {"subsample": 0.6, "colsample_bytree": 0.6}])
def test_sparse_equals_dense(spark, data, more):
    p = TrainingParams(max_depth=3, **more)
    s = sparse_of(spark, table(), 4, range(4))
    one, many = boost.train(p, data, 2, backend="task").model, boost.train(p, s, 2, [("t", s)])
    np.testing.assert_allclose(margins(one, data), margins(many.model, s), atol=1e-6)
    np.testing.assert_allclose(margins(one, data), margins(many.model, data), atol=1e-6)
    assert many.history[-1][3] < 1


def test_a_million_sparse_features(spark, monkeypatch):
    """Two features of a million matter; no column is made for one."""
    monkeypatch.setattr(backends, "TASK_CELLS", 1000)
    monkeypatch.setattr(bins, "HELD", 5000)
    rng = np.random.default_rng(8)
    n, width = 600, 1_000_000
    rows = []
    for k in range(n):
        a, b = rng.random(), rng.random()
        noise = rng.choice(width - 10, 50, replace=False) + 5
        rows.append((k, float(3 * (a > 0.5) - 2 * (b > 0.3)), [0, width - 1, *noise.tolist()], [a, b, *[1.0] * 50]))
    d = SparseDataset(spark.createDataFrame(rows, "row_id long, y double, indices array<int>, values array<double>"), width, label="y")
    model = boost.train(TrainingParams(max_depth=2, eta=1.0, reg_lambda=0.0), d, 1).model
    t = model.trees[0]
    assert {t.feature[k] for k in range(len(t)) if t.left[k] >= 0} == {0, width - 1}
    assert (np.abs(margins(model, d) - np.array([r[1] for r in rows])) > 0.1).mean() < 0.01  # but for bins of several values


def test_sparse_cells_may_repeat_be_unordered_or_missing(spark):
    pdf = table(200)
    rows = [(int(r.row_id), float(r.y), [3, 0, 1, 2, 1, 0], [r.f3, r.f0, r.f1, r.f2, 9.0, np.nan]) for r in pdf.itertuples()]
    d = SparseDataset(spark.createDataFrame(rows, "row_id long, y double, indices array<int>, values array<double>"), 4, label="y")
    dense = Dataset.of(spark.createDataFrame(pdf), [f"f{i}" for i in range(4)], "row_id", label="y")
    p = TrainingParams(max_depth=3)
    np.testing.assert_allclose(margins(boost.train(p, d, 2).model, d), margins(boost.train(p, dense, 2).model, dense), atol=1e-6)
    bad = SparseDataset(spark.createDataFrame([(1, 1.0, [7], [1.0])], "row_id long, y double, indices array<int>, values array<double>"), 4, label="y")
    with pytest.raises(Exception, match=FeatureOutOfBounds.__name__):
        boost.train(p, bad, 1)
    for more in ({"tree_method": "exact"}, {"backend": "task"}):
        with pytest.raises(InvalidParameter):
            boost.train(TrainingParams(tree_method=more.get("tree_method", "hist")), d, 1, backend=more.get("backend", "auto"))


def test_equal_sparse_rows_are_merged(spark, monkeypatch):
    pdf = pd.concat([table(40, holes=0.4)] * 8, ignore_index=True).assign(row_id=range(320))
    d = sparse_of(spark, pdf, 1000, [0, 7, 500, 999])
    p = TrainingParams(max_depth=3)
    held = []
    own = boost._merged
    monkeypatch.setattr(boost, "_merged", lambda *a: held.append(own(*a)) or held[-1])
    one = boost.train(p, d, 2, [("t", d)])
    assert len(held) == 1 and held[0].count() == 40
    monkeypatch.setattr(boost, "MERGE_FROM", 1000)
    many = boost.train(p, d, 2, [("t", d)])
    assert len(held) == 1
    np.testing.assert_allclose(margins(one.model, d), margins(many.model, d), atol=1e-6)
    np.testing.assert_allclose([h[3] for h in one.history], [h[3] for h in many.history], atol=1e-6)


def test_few_trees_score_sparse_rows_without_python(spark, monkeypatch):
    """Cells that repeat, come in any order, are NaN or aren't there; numbers of any width."""
    pdf = table(200, holes=0.3)
    rows = [(int(r.row_id), float(r.y), [3, 0, 1, 2, 1, 0], [r.f3, r.f0, r.f1, r.f2, 9.0, 5.0]) for r in pdf.itertuples()] + [(200, 0.0, [], []), (201, 1.0, [2], [0.4])]
    d = SparseDataset(spark.createDataFrame(rows, "row_id long, y double, indices array<long>, values array<double>"), 4, label="y")
    model = boost.train(TrainingParams(max_depth=3), d, 3).model
    assert "MapInArrow" not in model.predict_margin(d)._jdf.queryExecution().toString()
    one = margins(model, d)
    monkeypatch.setattr("gradloom.model.CASE_TREES", 0)
    assert "MapInArrow" in model.predict_margin(d)._jdf.queryExecution().toString()
    np.testing.assert_allclose(one, margins(model, d), atol=1e-6)


def test_libsvm_as_sparse(spark, tmp_path):
    pdf = table(150, holes=0.3)
    lines = [f"{y} " + " ".join(f"{i}:{v}" for i, v in enumerate(r) if v == v) for y, r in zip(pdf["y"], pdf[["f0", "f1", "f2", "f3"]].to_numpy(), strict=True)]
    (tmp_path / "a.txt").write_text("# x\n" + "\n".join(lines) + "\n\n")
    wide, sparse = files.read_libsvm(spark, str(tmp_path / "a.txt")), files.read_libsvm_sparse(spark, str(tmp_path / "a.txt"))
    assert sparse.n_features == 4 and sparse.long().count() == wide.long().count()
    p = TrainingParams(max_depth=3)
    np.testing.assert_allclose(margins(boost.train(p, wide, 2).model, wide), margins(boost.train(p, sparse, 2).model, sparse), atol=1e-6)


# prediction


@pytest.mark.parametrize("margin", [None, "bm", "bms", "bmn"])
def test_predictions_as_cases_and_over_arrays(data, monkeypatch, margin):
    """Null and NaN are missing, numbers and arrays are margins, in both forms."""
    frame = data.frame.withColumn("f0", F.when(F.col("row_id") % 7 == 0, float("nan")).otherwise(F.col("f0"))).withColumn("bms", F.when(F.col("row_id") % 4 > 0, F.array("bm"))).withColumn("bmn", F.when(F.col("row_id") % 3 == 0, float("nan")).otherwise(F.col("bm")))
    frame = frame.withColumn("cat", F.when(F.col("row_id") % 11 == 0, float("nan")).otherwise(F.col("cat")))
    d = Dataset(frame, ("f0", "cat", "f2"), label="y", categorical=frozenset({1}), base_margin=margin)
    model = boost.train(TrainingParams(max_depth=3), d.with_(base_margin=None, frame=frame.withColumn("y", F.col("y") + F.nanvl("cat", F.lit(0.0)) % 2)), 4).model
    got = []
    for limit in (0, 8):
        monkeypatch.setattr("gradloom.model.CASE_TREES", limit)
        got.append(margins(model, d))
    np.testing.assert_allclose(got[0], got[1], atol=1e-6)
    assert np.isfinite(got[0]).all()


def test_code_in_a_model_runs_only_if_trusted(data):
    own = objectives.custom("mine", lambda x, m, y, w: ((m - y) * w, x.ones(m) * w))
    text = boost.train(TrainingParams(max_depth=1, objective="mine"), data, 1, objective=own).model.to_json()
    with pytest.raises(ModelFormatError, match="trust"):
        BoostedModel.from_json(text)
    assert BoostedModel.from_json(text, trust=True).objective.name == "mine"
    assert BoostedModel.from_json(text, objective=own).objective is own


def test_contributions_of_deep_trees_add_up(spark):
    rng = np.random.default_rng(11)
    x = rng.random((600, 12)).astype(np.float32)
    names = [f"f{k}" for k in range(12)]
    pdf = pd.DataFrame(x, columns=names).assign(row_id=range(600), y=np.sin(7 * x).prod(1) + x.sum(1))
    d = Dataset(spark.createDataFrame(pdf), tuple(names), label="y")
    m = boost.train(TrainingParams(max_depth=12, min_child_weight=0), d, 2).model
    got = np.array(m.contributions(d).orderBy("row_id").toPandas()["contributions"].tolist())
    np.testing.assert_allclose(got[:, 0].sum(1), margins(m, d), atol=1e-5)
