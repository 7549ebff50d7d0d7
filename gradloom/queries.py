"""The registered queries over the engine's operators, each with the SQL that gives the same rows.

Frames that queries share are defined twice, as DataFrames and as SQL, from the same tables: EV (events as training rows with
a margin, labels of several kinds and a weight) and LI (line items as features with missing values and a made-up label).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom import dataset, interop, shap
from gradloom.dataset import Dataset, SparseDataset
from gradloom.estimator import Boosting
from gradloom.folders import shared_dir
from gradloom.functions import gain, metrics, objectives, ranking
from gradloom.model import BoostedModel, Linear
from gradloom.operators import binning, trees
from gradloom.params import TrainingParams
from gradloom.plans import boost, cv, linear
from gradloom.plans.kernel import Tree
from gradloom.oracle import LOGISTIC, dart_rounds, rounds, sampled_columns, tree
from gradloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c.cast("double"), digits) + 0.0


def ev(spark: SparkSession, sf: str) -> DataFrame:
    e, i = _t(spark, sf, "events"), F.col("event_id")
    return e.select(
        "event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"), ((i % 17) / 8.0 - 1.0).alias("m"), (F.col("value") / 50.0).alias("y"), F.when(i % 3 == 0, 1.0).otherwise(0.0).alias("yb"),
        (i % 5).cast("double").alias("yc"), (1.0 + (i % 4) / 2.0).alias("w"), (i % 4).cast("double").alias("yr"), (((i * 7919) % 1009) / 1009.0).alias("s"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value, CAST(event_id % 17 AS DOUBLE) / CAST(8 AS DOUBLE) - CAST(1 AS DOUBLE) AS m, value / CAST(50 AS DOUBLE) AS y,
 CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS yb, CAST(event_id % 5 AS DOUBLE) AS yc, 1e0 + CAST(event_id % 4 AS DOUBLE) / 2e0 AS w, CAST(event_id % 4 AS DOUBLE) AS yr,
 CAST((event_id * 7919) % 1009 AS DOUBLE) / 1009e0 AS s FROM events)"""


def li(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "lineitem")
    label = 2.0 * (F.col("l_quantity") / 50.0) - 30.0 * F.col("l_discount") * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("float").alias("f0"), F.col("l_discount").cast("float").alias("f1"), F.nullif(F.col("l_tax"), F.lit(0.0)).cast("float").alias("f2"), label.alias("y"))


LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS FLOAT) AS f0, CAST(l_discount AS FLOAT) AS f1, CAST(nullif(l_tax, 0e0) AS FLOAT) AS f2,
 2e0 * (l_quantity / 50e0) - 30e0 * l_discount * l_discount + CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS y FROM lineitem)"""
LONG = "cells AS (SELECT *, 0 AS feature, f0 AS value FROM li WHERE f0 IS NOT NULL UNION ALL SELECT *, 1, f1 FROM li WHERE f1 IS NOT NULL UNION ALL SELECT *, 2, f2 FROM li WHERE f2 IS NOT NULL)"


def cells(frame: DataFrame, *keep: str) -> DataFrame:
    a = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"f{k}").alias("value")) for k in range(3)])
    return frame.select(*keep, F.inline(a)).where(F.col("value").isNotNull())


# sources and the training table


@query("scan_dense", "SELECT event_id, CAST(value AS FLOAT)::DOUBLE AS f0, CAST(user_id AS FLOAT)::DOUBLE AS f1 FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset.of(_t(spark, sf, "events").select("event_id", "value", "user_id"), ["value", "user_id"], "event_id")
    return d.frame.select("event_id", F.col("value").cast("double").alias("f0"), F.col("user_id").cast("double").alias("f1"))


@query("scan_missing_sentinel", "SELECT count(*)::BIGINT AS n, count(nullif(CAST(l_tax AS FLOAT), CAST(0.04 AS FLOAT)))::BIGINT AS present FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset.of(_t(spark, sf, "lineitem").select("l_orderkey", "l_tax"), ["l_tax"], "l_orderkey", missing=0.04)
    return d.frame.agg(F.count("*").alias("n"), F.count("l_tax").alias("present"))


@query("scan_sparse_long", f"WITH {LI}, {LONG} SELECT feature, count(*)::BIGINT AS n, round(sum(value::DOUBLE), 3) + 0e0 AS total FROM cells GROUP BY feature")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset(li(spark, sf), ("f0", "f1", "f2"), "l_orderkey")
    return d.long().groupBy("feature").agg(F.count("*").alias("n"), _r(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query("sparse_to_wide", "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::FLOAT::DOUBLE END AS f0, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::FLOAT::DOUBLE END AS f1 FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("feature"), F.col("o_custkey").alias("value"))
    return dataset.from_long(o, 2).select("row_id", F.col("f0").cast("double").alias("f0"), F.col("f1").cast("double").alias("f1"))


@query("select_rows_fold", "SELECT (floor(((event_id * 2654435761) % 4294967296) / 8)::BIGINT % 5)::BIGINT AS fold, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("fold", trees.fold_of(F.col("event_id"), 5))
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("row_sample_hash", "SELECT event_id FROM events WHERE (event_id * 2654435761 + 40503 * 3 + 9973 * 2 + 12345) % 4294967296 < CAST(floor(0.3 * 4294967296) AS BIGINT)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").where(trees.keeps_row(F.col("event_id"), 0.3, 3, 2)).select("event_id")


@query("group_ptr", 'SELECT user_id, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS "start", (sum(n) OVER (ORDER BY user_id))::BIGINT AS "end" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)')
def _(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return dataset.group_pointers(sizes, "user_id", "n")


@query("cell_access", "SELECT event_id % 100 AS rest, event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(event_id % 5 AS FLOAT) AS DOUBLE) END AS cell, CAST(CAST(nullif(user_id, 0) AS FLOAT) AS DOUBLE) AS other FROM events WHERE event_id % 5 <> 0 OR user_id <> 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's cells, through the long form and back: one that may be missing and one that never is."""
    e = _t(spark, sf, "events").select("event_id", (F.col("event_id") % 5).alias("f0"), F.col("user_id").alias("f1"))
    cells = Dataset.of(e, ["f0", "f1"], "event_id", missing=0.0).long()
    wide = dataset.from_long(cells, 2)
    return wide.select((F.col("row_id") % 100).alias("rest"), F.col("row_id").alias("event_id"), F.col("f0").cast("double").alias("cell"), F.col("f1").cast("double").alias("other"))


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_dir(spark)}/gradloom-{uuid.uuid4().hex}"


_FILE_SQL = "SELECT count(*)::BIGINT AS n, round(sum((event_id % 3)::DOUBLE), 2) AS labels, round(sum(user_id::DOUBLE), 2) AS f0, count(nullif(event_id % 5, 0))::BIGINT AS present FROM events"


def _file_sums(frame: DataFrame) -> DataFrame:
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 2)
    return frame.agg(F.count("*").alias("n"), total("label").alias("labels"), total("f0").alias("f0"), F.count("f1").alias("present"))


@query("csv_source", _FILE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, i = _scratch(spark), F.col("event_id")
    _t(spark, sf, "events").select((i % 3).alias("y"), "user_id", F.nullif(i % 5, F.lit(0)).alias("f1")).write.csv(path, nullValue="NA")
    return _file_sums(files.read_csv(spark, path).frame)


@query("libsvm_source", _FILE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, i = _scratch(spark), F.col("event_id")
    line = F.concat_ws(" ", i % 3, F.concat(F.lit("0:"), F.col("user_id")), F.when(i % 5 != 0, F.concat(F.lit("1:"), i % 5)))
    _t(spark, sf, "events").select(line.cast("string").alias("value")).write.text(path)
    return _file_sums(files.read_libsvm(spark, path).frame)


# objectives


def _objective(name: str, label: str, grad: str, hess: str, transform: str, base: str) -> None:
    p = TrainingParams(objective=name)
    short = name.partition(":")[2]
    body = f"SELECT event_id, round(CAST({grad} AS FLOAT)::DOUBLE, 4) + 0e0 AS g, round(CAST({hess} AS FLOAT)::DOUBLE, 4) + 0e0 AS h FROM ev"

    @query(f"grad_{short}", f"WITH {EV} {body}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        g, h = objectives.create(p).gradient(F.col("m"), F.col(label), F.col("w"))
        return ev(spark, sf).select("event_id", _r(g, 4).alias("g"), _r(h, 4).alias("h"))

    @query(f"transform_{short}", f"WITH {EV} SELECT event_id, round({transform}, 8) + 0e0 AS p FROM ev")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return ev(spark, sf).select("event_id", _r(objectives.create(p).predict(F.col("m")), 8).alias("p"))

    @query(f"base_margin_{short}", f"WITH {EV}, a AS (SELECT sum({label} * w) / sum(w) AS mean FROM ev) SELECT round({base}, 8) + 0e0 AS margin FROM a")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        mean = ev(spark, sf).agg(objectives.weighted_mean(ev(spark, sf), label, "w").alias("mean")).collect()[0]["mean"]
        return spark.createDataFrame([(objectives.create(p).base_margin(mean),)], "margin double").select(_r(F.col("margin"), 8).alias("margin"))


_SIG = "1e0 / (1e0 + exp(-m))"
_LOGM = "ln(greatest(mean, 1e-6))"
_objective("reg:squarederror", "y", "(m - y) * w", "w", "m", "mean")
_objective("reg:pseudohubererror", "y", "w * (m - y) / sqrt(1e0 + (m - y) * (m - y))", "w / ((1e0 + (m - y) * (m - y)) * sqrt(1e0 + (m - y) * (m - y)))", "m", "mean")
_objective("binary:logistic", "yb", f"({_SIG} - yb) * w", f"{_SIG} * (1e0 - {_SIG}) * w", _SIG, "ln(mean / (1e0 - mean))")
_objective("count:poisson", "yc", "(exp(m) - yc) * w", "exp(m + 7e-1) * w", "exp(m)", _LOGM)
_objective("reg:gamma", "y", "(1e0 - y * exp(-m)) * w", "y * exp(-m) * w", "exp(m)", _LOGM)
_objective("reg:tweedie", "yc", "(exp(5e-1 * m) - yc * exp(-5e-1 * m)) * w", "(5e-1 * exp(5e-1 * m) + yc * 5e-1 * exp(-5e-1 * m)) * w", "exp(m)", _LOGM)


@query("grad_scale_pos_weight", f"WITH {EV} SELECT event_id, round(CAST(({_SIG} - yb) * CASE WHEN yb = 1 THEN 3e0 ELSE 1e0 END AS FLOAT)::DOUBLE, 4) + 0e0 AS g FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g, _h = objectives.create(TrainingParams(objective="binary:logistic", scale_pos_weight=3.0)).gradient(F.col("m"), F.col("yb"))
    return ev(spark, sf).select("event_id", _r(g, 4).alias("g"))


_SOFT = "sm AS (SELECT event_id, yc, w, m AS m0, -m AS m1, m / 2e0 AS m2, exp(m) + exp(-m) + exp(m / 2e0) AS z FROM ev)"


def _soft(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).withColumn("ms", F.array(F.col("m"), -F.col("m"), F.col("m") / 2.0)).withColumn("k", F.col("yc") % 3)


@query(
    "grad_softmax",
    f"WITH {EV}, {_SOFT} " + "SELECT event_id, " + ", ".join(f"round(CAST((exp(m{k}) / z - CASE WHEN yc::INT % 3 = {k} THEN 1e0 ELSE 0e0 END) * w AS FLOAT)::DOUBLE, 4) + 0e0 AS g{k}, round(CAST(2e0 * (exp(m{k}) / z) * (1e0 - exp(m{k}) / z) * w AS FLOAT)::DOUBLE, 4) + 0e0 AS h{k}" for k in range(3)) + " FROM sm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    g, h = objectives.create(TrainingParams(objective="multi:softprob", num_class=3)).gradient(F.col("ms"), F.col("k"), F.col("w"))
    s = _soft(spark, sf).select("event_id", g.alias("g"), h.alias("h"))
    return s.select("event_id", *[_r(F.col(c)[k], 4).alias(f"{c}{k}") for k in range(3) for c in ("g", "h")])


@query("transform_softmax", f"WITH {EV}, {_SOFT} SELECT event_id, round(exp(m0) / z, 8) AS p0, round(exp(m1) / z, 8) AS p1, round(exp(m2) / z, 8) AS p2 FROM sm")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = _soft(spark, sf).select("event_id", objectives.softmax(F.col("ms")).alias("p"))
    return s.select("event_id", *[_r(F.col("p")[k], 8).alias(f"p{k}") for k in range(3)])


@query("grad_custom", f"WITH {EV} SELECT event_id, round(CAST(4e0 * (m - y) * (m - y) * (m - y) * w AS FLOAT)::DOUBLE, 2) + 0e0 AS g, round(CAST(12e0 * (m - y) * (m - y) * w AS FLOAT)::DOUBLE, 2) + 0e0 AS h FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = objectives.custom("quartic", lambda x, m, y, w: (4.0 * (m - y) * (m - y) * (m - y) * w, 12.0 * (m - y) * (m - y) * w))
    g, h = o.gradient(F.col("m"), F.col("y"), F.col("w"))
    return ev(spark, sf).select("event_id", _r(g, 2).alias("g"), _r(h, 2).alias("h"))


# ranking: queries are users, relevance is yr, scores are s (distinct within a user up to the modulus; ties by id)

_RANK = f"""WITH {EV}, b AS (SELECT user_id AS q, event_id AS r, s AS m, yr AS y, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) - 1 AS pos,
 row_number() OVER (PARTITION BY user_id ORDER BY yr DESC, event_id) - 1 AS best FROM ev),
 i AS (SELECT *, sum((pow(2, y) - 1) / log2(best + 2)) OVER (PARTITION BY q) AS ideal, CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END AS rel,
 sum(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY q ORDER BY pos) AS hits, sum(CASE WHEN y > 0 THEN 1e0 / (pos + 1) ELSE 0e0 END) OVER (PARTITION BY q ORDER BY pos) AS part,
 sum(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY q) AS total FROM b),
 p AS (SELECT h.r AS a, l.r AS b, 1e0 / (1e0 + exp(h.m - l.m)) AS rho, {{delta}} AS d FROM i h JOIN i l ON h.q = l.q AND h.y > l.y),
 e AS (SELECT a AS r, -rho * d AS g, greatest(rho * (1 - rho) * d, 1e-16) AS h FROM p WHERE d <> 0 UNION ALL SELECT b, rho * d, greatest(rho * (1 - rho) * d, 1e-16) FROM p WHERE d <> 0)
 SELECT event_id, round(CAST(coalesce(sum(g), 0e0) AS FLOAT)::DOUBLE, 3) + 0e0 AS g, round(CAST(coalesce(sum(h), 0e0) AS FLOAT)::DOUBLE, 3) + 0e0 AS h FROM ev LEFT JOIN e ON r = event_id GROUP BY event_id"""
_SWAP = """CASE WHEN h.rel = 1 AND l.rel = 0 THEN abs(
 CASE WHEN h.pos < l.pos THEN (l.hits / (l.pos + 1)) - (h.hits / (h.pos + 1)) - (l.part - h.part)
 ELSE (l.hits + 1e0) / (l.pos + 1) - h.hits / (h.pos + 1) + (h.part - l.part - 1e0 / (h.pos + 1)) END) / h.total ELSE 0e0 END"""


def _ranked(kind: str, delta: str) -> None:
    @query(f"rank_{kind}_grad", _RANK.replace("{delta}", delta))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        got = ranking.lambda_gradients(ev(spark, sf), kind, "user_id", "event_id", "s", "yr", max_pairs=None)
        return got.select("event_id", _r(F.col("g"), 3).alias("g"), _r(F.col("h"), 3).alias("h"))


_ranked("pairwise", "1e0")
_ranked("ndcg", "CASE WHEN h.ideal > 0 THEN abs((pow(2, h.y) - pow(2, l.y)) * (1e0 / log2(h.pos + 2) - 1e0 / log2(l.pos + 2))) / h.ideal ELSE 0e0 END")
_ranked("map", _SWAP)


_MIX = "((xor({v}, {v} >> 16) * 73244475) & 4294967295)"
_DRAWN = _RANK[: _RANK.index(" p AS (")] + f""" k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r) - 1 AS rk, count(*) OVER (PARTITION BY q) AS n FROM i),
 t AS (SELECT q, r, rk, n, unnest(range(0, (rk + 1) * 20 // n - rk * 20 // n)) AS turn FROM k WHERE n * (n - 1) / 2 > 20), u AS (SELECT q, r, rk, n, (rk * 2654435761 + turn * 40503 + 5 * 9973 + 12345) & 4294967295 AS v FROM t),
 u1 AS (SELECT q, r, rk, n, {_MIX.format(v="v")} AS v FROM u), u2 AS (SELECT q, r, rk, n, {_MIX.format(v="v")} AS v FROM u1), o AS (SELECT u2.q, u2.r AS ra, k.r AS rb FROM u2 JOIN k ON k.q = u2.q AND k.rk = (u2.rk + 1 + xor(u2.v, u2.v >> 16) % (u2.n - 1)) % u2.n),
 pp AS (SELECT h.r AS a, l.r AS b FROM o JOIN k h ON h.q = o.q AND h.r IN (o.ra, o.rb) JOIN k l ON l.q = o.q AND l.r IN (o.ra, o.rb) AND h.y > l.y UNION ALL SELECT h.r, l.r FROM k h JOIN k l ON h.q = l.q AND h.y > l.y WHERE h.n * (h.n - 1) / 2 <= 20),
 p AS (SELECT h.r AS a, l.r AS b, 1e0 / (1e0 + exp(h.m - l.m)) AS rho, {{delta}} AS d FROM pp JOIN i h ON h.r = pp.a JOIN i l ON l.r = pp.b),
""" + _RANK[_RANK.index(" e AS (") :]


@query("rank_ndcg_grad_sampled", _DRAWN.replace("{delta}", "CASE WHEN h.ideal > 0 THEN abs((pow(2, h.y) - pow(2, l.y)) * (1e0 / log2(h.pos + 2) - 1e0 / log2(l.pos + 2))) / h.ideal ELSE 0e0 END"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = ranking.lambda_gradients(ev(spark, sf), "ndcg", "user_id", "event_id", "s", "yr", max_pairs=20, seed=5)
    return got.select("event_id", _r(F.col("g"), 3).alias("g"), _r(F.col("h"), 3).alias("h"))


# metrics


def _metric(name: str, prediction: str, label: str, weight: str | None, sql: str, group: str | None = None) -> None:
    @query(f"metric_{name.replace('-', '_').replace('@', '_at_').replace('.', '_')}", f"WITH {EV} {sql}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        frame = ev(spark, sf).withColumn("pl", F.exp("m")).withColumn("ps", F.array(F.col("s") / 2, F.lit(0.3), 0.7 - F.col("s") / 2)).withColumn("k", (F.col("yc") % 3))
        return metrics.create(name).of(frame, prediction, label, weight, group, "event_id").select(_r(F.col("value"), 7).alias("value"))


def _mean_of(e: str, weighted: bool = True) -> str:
    return f"sum(({e}) * w) / sum(w)" if weighted else f"avg({e})"


_metric("rmse", "m", "y", "w", f"SELECT round(sqrt({_mean_of('(m - y) * (m - y)')}), 7) AS value FROM ev")
_metric("mae", "m", "y", "w", f"SELECT round({_mean_of('abs(m - y)')}, 7) AS value FROM ev")
_metric("logloss", "s", "yb", "w", f"SELECT round({_mean_of('-(yb * ln(least(greatest(s, 1e-15), 1e0 - 1e-15)) + (1 - yb) * ln(1 - least(greatest(s, 1e-15), 1e0 - 1e-15)))')}, 7) AS value FROM ev")
_metric("error", "s", "yb", "w", f"SELECT round({_mean_of('CASE WHEN (s > 0.5) <> (yb > 0.5) THEN 1e0 ELSE 0e0 END')}, 7) AS value FROM ev")
_metric("poisson-nloglik", "pl", "yc", "w", f"SELECT round({_mean_of('exp(m) - yc * m')}, 7) AS value FROM ev")
_metric("gamma-nloglik", "pl", "y", "w", f"SELECT round({_mean_of('y / exp(m) + m')}, 7) AS value FROM ev")
_metric("tweedie-nloglik", "pl", "y", "w", f"SELECT round({_mean_of('-y * pow(exp(m), -5e-1) / -5e-1 + pow(exp(m), 5e-1) / 5e-1')}, 7) AS value FROM ev")
_metric("tweedie-nloglik@1.2", "pl", "y", "w", f"SELECT round({_mean_of('-y * pow(exp(m), -2e-1) / -2e-1 + pow(exp(m), 8e-1) / 8e-1')}, 7) AS value FROM ev")
_metric("mlogloss", "ps", "k", "w", f"SELECT round({_mean_of('-ln(greatest(CASE yc::INT % 3 WHEN 0 THEN s / 2 WHEN 1 THEN 3e-1 ELSE 7e-1 - s / 2 END, 1e-15))')}, 7) AS value FROM ev")
_metric("merror", "ps", "k", "w", f"SELECT round({_mean_of('CASE WHEN (CASE WHEN s / 2 >= 3e-1 AND s / 2 >= 7e-1 - s / 2 THEN 0 WHEN 3e-1 >= 7e-1 - s / 2 THEN 1 ELSE 2 END) <> yc::INT % 3 THEN 1e0 ELSE 0e0 END')}, 7) AS value FROM ev")
_metric("auc", "s", "yb", None, "SELECT round((sum(CASE WHEN yb > 0.5 THEN rk ELSE 0e0 END) - any_value(np) * (any_value(np) + 1) / 2e0) / (any_value(np) * any_value(nn)), 7) AS value FROM (SELECT yb, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rk, sum(yb) OVER () AS np, sum(1 - yb) OVER () AS nn FROM ev)")
_metric("aucpr", "s", "yb", "w", ", g AS (SELECT s, sum(w * yb) AS p, sum(w * (1 - yb)) AS n FROM ev GROUP BY s), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS tot FROM g), x AS (SELECT s, tp / (tp + fp) AS prec, tp / tot AS rec FROM c), z AS (SELECT prec, rec, lag(rec, 1, 0e0) OVER (ORDER BY s DESC) AS r0, coalesce(lag(prec) OVER (ORDER BY s DESC), prec) AS p0 FROM x) SELECT round(sum((rec - r0) * (prec + p0) / 2e0), 7) AS value FROM z")


def _ndcg_sql(k: int) -> str:
    return f", r AS (SELECT user_id, yr, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY yr DESC, event_id) AS b FROM ev), d AS (SELECT user_id, sum(CASE WHEN a <= {k} THEN (pow(2, yr) - 1) / log2(a + 1) ELSE 0e0 END) AS dcg, sum(CASE WHEN b <= {k} THEN (pow(2, yr) - 1) / log2(b + 1) ELSE 0e0 END) AS ideal FROM r GROUP BY user_id) SELECT round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0e0 END), 7) AS value FROM d"


def _map_sql(k: int) -> str:
    return f", r AS (SELECT user_id, CASE WHEN yr > 0 THEN 1e0 ELSE 0e0 END AS rel, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS a FROM ev), h AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY a) AS hits FROM r), d AS (SELECT user_id, sum(CASE WHEN rel = 1 AND a <= {k} THEN hits / a ELSE 0e0 END) AS x, sum(rel) AS n FROM h GROUP BY user_id) SELECT round(avg(CASE WHEN n > 0 THEN x / n ELSE 0e0 END), 7) AS value FROM d"


for _name, _k in (("ndcg", 10**9), ("ndcg@5", 5), ("ndcg@1", 1)):
    _metric(_name, "s", "yr", None, _ndcg_sql(_k), "user_id")
for _name, _k in (("map", 10**9), ("map@3", 3)):
    _metric(_name, "s", "yr", None, _map_sql(_k), "user_id")


@query("metric_custom", f"WITH {EV} SELECT round(max(abs(m - y)), 7) AS value FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    worst = metrics.custom("worst", lambda d: d.agg(F.max(F.abs(F.col("p") - F.col("y"))).alias("value")))
    return worst.of(ev(spark, sf), "m", "y").select(_r(F.col("value"), 7).alias("value"))


# cuts and bins


def _counts(spark: SparkSession, sf: str, hess: bool = False) -> DataFrame:
    c = cells(li(spark, sf).withColumn("h", 1.0 + F.col("l_linenumber") / 4.0), "h")
    return binning.value_counts(c, "h" if hess else None)


@query("cuts_distinct", f"WITH {LI}, {LONG} SELECT DISTINCT feature, value::DOUBLE AS cut FROM cells")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return binning.quantile_cuts(_counts(spark, sf), 256).where(~F.col("sentinel")).select("feature", F.col("cut").cast("double").alias("cut"))


_PRICE = "v AS (SELECT CAST(l_extendedprice AS FLOAT) AS value, count(*) AS n, sum(1e0 + l_linenumber / 4e0) AS h FROM lineitem GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total, sum(h) OVER (ORDER BY value) AS hupto, sum(h) OVER () AS htotal FROM v), b AS (SELECT unnest(range(1, 32)) AS b)"


def _price(spark: SparkSession, sf: str, hess: bool) -> DataFrame:
    t = _t(spark, sf, "lineitem").select(F.lit(0).alias("feature"), F.col("l_extendedprice").cast("float").alias("value"), (1.0 + F.col("l_linenumber") / 4.0).alias("h"))
    return binning.quantile_cuts(binning.value_counts(t, "h" if hess else None), 32, hess).where(~F.col("sentinel")).select(F.col("cut").cast("double").alias("cut"))


@query("cuts_quantile", f"WITH {_PRICE} SELECT DISTINCT (SELECT min(value) FROM u WHERE upto * 32 >= b.b * total)::DOUBLE AS cut FROM b")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _price(spark, sf, False)


@query("cuts_weighted", f"WITH {_PRICE} SELECT DISTINCT (SELECT min(value) FROM u WHERE hupto + 1e-12 >= b.b * htotal / 32)::DOUBLE AS cut FROM b")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _price(spark, sf, True)


@query("cuts_sentinel", f"WITH {LI}, {LONG} SELECT feature, max(value)::DOUBLE AS top, true AS above, true AS tight FROM cells GROUP BY feature")
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    tops = counts.groupBy("feature").agg(F.max("value").alias("top"))
    s = binning.quantile_cuts(counts, 256).where("sentinel").join(tops, "feature")
    half = ((F.col("cut").cast("double") + F.col("top").cast("double")) / 2).cast("float")
    return s.select("feature", F.col("top").cast("double").alias("top"), (F.col("cut") > F.col("top")).alias("above"), half.isin(F.col("cut"), F.col("top")).alias("tight"))


@query("cuts_categorical", "SELECT DISTINCT (event_id % 7)::DOUBLE AS cut FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "events").select(F.lit(0).alias("feature"), (F.col("event_id") % 7).cast("float").alias("value"))
    return binning.categorical_cuts(binning.value_counts(c)).select(F.col("cut").cast("double").alias("cut"))


@query("bin_dataset", f"WITH {LI}, {LONG}, c AS (SELECT DISTINCT feature, value FROM cells), b AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS bin FROM c) SELECT b.feature, b.bin::BIGINT AS bin, count(*)::BIGINT AS n FROM cells JOIN b ON b.feature = cells.feature AND b.value = cells.value GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cuts = binning.quantile_cuts(_counts(spark, sf), 256)
    return binning.bin_cells(cells(li(spark, sf)), cuts).groupBy("feature", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("bin_lookup", "SELECT l_quantity::DOUBLE AS v, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS bin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("v"))
    return t.groupBy("v", binning.bin_of(F.col("v"), np.array([10.0, 20.0, 30.0], np.float32)).alias("bin")).agg(F.count("*").alias("n"))


# tree kernels: one round of squared error on LI with margins at the mean; node is 0 or 1 by line number

_HIST = f"WITH {LI}, {LONG}, mean AS (SELECT avg(y) AS mu FROM li), rows_ AS (SELECT l_linenumber % 2 AS node, feature, value AS bin, mu - y AS g, 1e0 AS h FROM cells, mean), hist AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM rows_ GROUP BY 1, 2, 3), tot AS (SELECT l_linenumber % 2 AS node, sum(mu - y) AS gt, count(*)::DOUBLE AS ht FROM li, mean GROUP BY 1)"


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    frame = li(spark, sf)
    mu = frame.agg(F.avg("y")).collect()[0][0]
    return frame.withColumn("node", F.col("l_linenumber") % 2).withColumn("g", F.lit(mu) - F.col("y")).withColumn("h", F.lit(1.0))


def _hist(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _graded(spark, sf)
    hist = trees.histogram(cells(rows, "node", "g", "h").withColumnRenamed("value", "bin"), "node")
    return hist, trees.root_stats(rows, "node").select("node", F.col("g").alias("gt"), F.col("h").alias("ht"))


@query("root_stats", f"{_HIST} SELECT node, round(gt, 4) + 0e0 AS g, ht AS h FROM tot")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return trees.root_stats(_graded(spark, sf), "node").select("node", _r(F.col("g"), 4).alias("g"), "h")


@query("hist_build", f"{_HIST} SELECT node, feature, bin::DOUBLE AS bin, round(g, 4) + 0e0 AS g, h, n::BIGINT AS n FROM hist")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _hist(spark, sf)[0].select("node", "feature", F.col("bin").cast("double").alias("bin"), _r(F.col("g"), 4).alias("g"), "h", "n")


@query("hist_subtract", f"{_HIST} SELECT feature, bin::DOUBLE AS bin, round(sum(CASE WHEN node = 1 THEN g ELSE 0e0 END), 4) + 0e0 AS g, sum(CASE WHEN node = 1 THEN h ELSE 0e0 END) AS h FROM hist GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)[0]
    parent = hist.groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return trees.subtract(parent, hist.where("node = 0")).select("feature", F.col("bin").cast("double").alias("bin"), _r(F.col("g"), 4).alias("g"), "h")


_SCORE = "CASE WHEN {h} < 1 OR {h} <= 0 THEN 0e0 ELSE {g} * {g} / ({h} + 1e0) END"
_SCAN = (
    f"{_HIST}, d AS (SELECT node, feature, bin, dense_rank() OVER (PARTITION BY feature ORDER BY bin) AS k, g, h FROM hist), s AS (SELECT node, feature, k, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, feature) AS gp, sum(h) OVER (PARTITION BY node, feature) AS hp, max(k) OVER (PARTITION BY node, feature) AS last FROM d WINDOW w AS (PARTITION BY node, feature ORDER BY k)), "
    "z AS (SELECT DISTINCT node, feature, 0 AS k, 0e0 AS gl, 0e0 AS hl, gp, hp, last FROM s UNION ALL SELECT * FROM s), m AS (SELECT z.*, gt, ht, gt - gp AS gm, ht - hp AS hm FROM z JOIN tot USING (node) WHERE k < last), "
    "two AS (SELECT node, feature, k, false AS dl, gl, hl, gt, ht FROM m UNION ALL SELECT node, feature, k, true, gl + gm, hl + hm, gt, ht FROM m WHERE hm > 1e-6), "
    f"c AS (SELECT *, {_SCORE.format(g='gl', h='hl')} + {_SCORE.format(g='(gt - gl)', h='(ht - hl)')} - {_SCORE.format(g='gt', h='ht')} AS gain FROM two WHERE hl >= 1 AND ht - hl >= 1)"
)


def _scan(spark: SparkSession, sf: str, p: TrainingParams, **more: Column) -> DataFrame:
    hist, totals = _hist(spark, sf)
    ranked = hist.withColumn("bin", F.dense_rank().over(Window.partitionBy("feature").orderBy("bin")))
    return trees.numeric_splits(ranked, totals, p, **more)


@query("split_scan_numeric", f"{_SCAN} SELECT node, feature, k::INT AS bin, dl AS default_left, round(gain / ht, 7) + 0e0 AS gain FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf, TrainingParams()).select("node", "feature", "bin", "default_left", _r(F.col("gain") / F.col("ht"), 7).alias("gain"))


@query("best_split", f"{_SCAN}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, feature, k, dl) AS rn FROM c WHERE gain > 1e-6) SELECT node, feature, k::INT AS bin, dl AS default_left, round(gain / ht, 7) + 0e0 AS gain FROM r WHERE rn = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = TrainingParams()
    return trees.best_splits(_scan(spark, sf, p), p).select("node", "feature", "bin", "default_left", _r(F.col("gain") / F.col("ht"), 7).alias("gain"))


@query(
    "monotone_candidates",
    f"{_SCAN}, w AS (SELECT *, least(greatest(-gl / (hl + 1e0), -5e-1), 5e-1) AS wl, least(greatest(-(gt - gl) / (ht - hl + 1e0), -5e-1), 5e-1) AS wr, least(greatest(-gt / (ht + 1e0), -5e-1), 5e-1) AS wt FROM c) "
    "SELECT node, feature, k::INT AS bin, dl AS default_left, round((-(2e0 * gl * wl + (hl + 1e0) * wl * wl) - (2e0 * (gt - gl) * wr + (ht - hl + 1e0) * wr * wr) + (2e0 * gt * wt + (ht + 1e0) * wt * wt)) / ht, 7) + 0e0 AS gain FROM w WHERE CASE feature WHEN 0 THEN wl <= wr WHEN 1 THEN wl >= wr ELSE true END",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    way = F.when(F.col("feature") == 0, 1).when(F.col("feature") == 1, -1).otherwise(0)
    got = _scan(spark, sf, TrainingParams(), low=F.lit(-0.5), high=F.lit(0.5), direction=way)
    return got.select("node", "feature", "bin", "default_left", _r(F.col("gain") / F.col("ht"), 7).alias("gain"))


@query("interaction_mask", f"{_SCAN} SELECT count(*)::BIGINT AS n, min(feature) AS lo, max(feature) AS hi FROM c WHERE feature IN (0, 2)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    allowed = sorted(trees.allowed_features([0], [[0, 2], [1]], 3))
    return _scan(spark, sf, TrainingParams()).where(F.col("feature").isin(allowed)).agg(F.count("*").alias("n"), F.min("feature").alias("lo"), F.max("feature").alias("hi"))


@query(
    "exact_best_split",
    f"{_HIST}, s AS (SELECT node, feature, bin AS v, lead(bin) OVER w AS nx, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, feature) AS gp, sum(h) OVER (PARTITION BY node, feature) AS hp FROM hist WINDOW w AS (PARTITION BY node, feature ORDER BY bin)), m AS (SELECT s.*, gt, ht, gt - gp AS gm, ht - hp AS hm FROM s JOIN tot USING (node) WHERE nx IS NOT NULL), two AS (SELECT node, feature, v, nx, false AS dl, gl, hl, gt, ht FROM m UNION ALL SELECT node, feature, v, nx, true, gl + gm, hl + hm, gt, ht FROM m WHERE hm > 1e-6), "
    f"c AS (SELECT *, {_SCORE.format(g='gl', h='hl')} + {_SCORE.format(g='(gt - gl)', h='(ht - hl)')} - {_SCORE.format(g='gt', h='ht')} AS gain FROM two WHERE hl >= 1 AND ht - hl >= 1), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, feature, v, dl) AS rn FROM c) SELECT node, feature, round(CAST((v::DOUBLE + nx::DOUBLE) / 2e0 AS FLOAT)::DOUBLE, 6) AS threshold, dl AS default_left, round(gain / ht, 7) + 0e0 AS gain FROM r WHERE rn = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hist, totals = _hist(spark, sf)
    p = TrainingParams(tree_method="exact")
    best = trees.best_splits(trees.exact_splits(hist.withColumnRenamed("bin", "value"), totals, p), p, "value")
    return best.select("node", "feature", _r(F.col("threshold"), 6).alias("threshold"), "default_left", _r(F.col("gain") / F.col("ht"), 7).alias("gain"))


_CAT = f"WITH {EV}, mean AS (SELECT avg(y) AS mu FROM ev), h AS (SELECT (event_id % 7)::INT AS bin, sum(mu - y) AS g, count(*)::DOUBLE AS h FROM ev, mean GROUP BY 1), t AS (SELECT sum(g) AS gt, sum(h) AS ht FROM h), s AS (SELECT row_number() OVER w AS place, count(*) OVER () AS n, sum(g) OVER w AS gl, sum(h) OVER w AS hl, list_sort(list(bin) OVER w) AS ls FROM h WINDOW w AS (ORDER BY g / (h + 1e0), bin))"


@query("split_scan_categorical", f"{_CAT} SELECT place::INT AS place, array_to_string(ls, ',') AS left_set, round(({_SCORE.format(g='gl', h='hl')} + {_SCORE.format(g='(gt - gl)', h='(ht - hl)')} - {_SCORE.format(g='gt', h='ht')}) / ht, 7) + 0e0 AS gain FROM s, t WHERE place < n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    mu = e.agg(F.avg("y")).collect()[0][0]
    rows = e.select(F.lit(0).alias("node"), F.lit(0).alias("feature"), (F.col("event_id") % 7).cast("int").alias("bin"), (F.lit(mu) - F.col("y")).alias("g"), F.lit(1.0).alias("h"))
    totals = trees.root_stats(rows, "node").select("node", F.col("g").alias("gt"), F.col("h").alias("ht"))
    got = trees.categorical_splits(trees.histogram(rows, "node"), totals, TrainingParams())
    return got.select("place", F.array_join("left_set", ",").alias("left_set"), _r(F.col("gain") / F.col("ht"), 7).alias("gain"))


@query("soft_threshold", f"WITH {EV} SELECT event_id, round(CASE WHEN m > 3e-1 THEN m - 3e-1 WHEN m < -3e-1 THEN m + 3e-1 ELSE 0e0 END, 8) + 0e0 AS t FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).select("event_id", _r(gain.soft_threshold(F.col("m"), 0.3), 8).alias("t"))


_W = "CASE WHEN w < 12e-1 THEN 0e0 ELSE least(greatest(-(sign(m) * greatest(abs(m) - 1e-1, 0e0)) / (w + 2e0), -2e-1), 2e-1) END"


@query("leaf_weight_l1_l2_mds", f"WITH {EV} SELECT event_id, round({_W}, 8) + 0e0 AS weight, round(CASE WHEN w < 12e-1 THEN 0e0 ELSE -(2e0 * (sign(m) * greatest(abs(m) - 1e-1, 0e0)) * ({_W}) + (w + 2e0) * ({_W}) * ({_W})) END, 8) + 0e0 AS score FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = TrainingParams(alpha=0.1, reg_lambda=2.0, max_delta_step=0.2, min_child_weight=1.2)
    return ev(spark, sf).select("event_id", _r(gain.leaf_weight(F.col("m"), F.col("w"), p), 8).alias("weight"), _r(gain.structure_score(F.col("m"), F.col("w"), p), 8).alias("score"))


@query("split_gain", f"WITH {EV} SELECT event_id, round(m * m / (w + 1e0) + s * s / (w + 2e0) - (m + s) * (m + s) / (w + w + 1e0 + 1e0), 8) + 0e0 AS gain FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("w")
    return ev(spark, sf).select("event_id", _r(gain.split_gain(F.col("m"), w, F.col("s"), w + 1, TrainingParams()), 8).alias("gain"))


@query("route_rows", f"WITH {LI} SELECT CASE WHEN f2 IS NULL THEN true ELSE f2 < CAST(0.05 AS FLOAT) END AS numeric_left, coalesce(greatest(floor(f0)::INT, 0) IN (1, 5, 9), false) AS set_left, count(*)::BIGINT AS n FROM li GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return li(spark, sf).groupBy(trees.goes_left(F.col("f2"), 0.05, True).alias("numeric_left"), trees.in_set(F.col("f0"), [1, 5, 9]).alias("set_left")).agg(F.count("*").alias("n"))


# boosting rounds on LI: cuts are all distinct values, so bins are ranks

_STUMP = (
    f"{_HIST}, h0 AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h FROM hist GROUP BY 1, 2), t0 AS (SELECT sum(gt) AS gt, sum(ht) AS ht FROM tot), s AS (SELECT feature, bin, lead(bin) OVER w AS nx, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gp, sum(h) OVER (PARTITION BY feature) AS hp FROM h0 WINDOW w AS (PARTITION BY feature ORDER BY bin)), "
    "z AS (SELECT feature, min(bin) AS nx, 0e0 AS gl, 0e0 AS hl, any_value(gp) AS gp, any_value(hp) AS hp FROM s GROUP BY 1 UNION ALL SELECT feature, nx, gl, hl, gp, hp FROM s WHERE nx IS NOT NULL), m AS (SELECT z.*, gt, ht, gt - gp AS gm, ht - hp AS hm FROM z, t0), "
    "two AS (SELECT feature, nx, false AS dl, gl, hl, gt, ht FROM m UNION ALL SELECT feature, nx, true, gl + gm, hl + hm, gt, ht FROM m WHERE hm > 1e-6), "
    f"c AS (SELECT *, {_SCORE.format(g='gl', h='hl')} + {_SCORE.format(g='(gt - gl)', h='(ht - hl)')} - {_SCORE.format(g='gt', h='ht')} AS gain FROM two WHERE hl >= 1 AND ht - hl >= 1), best AS (SELECT * FROM c ORDER BY round(gain, 6) DESC, feature, nx, dl LIMIT 1), "
    "pred AS (SELECT y, mu + 3e-1 * CASE WHEN coalesce(CASE b.feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END < b.nx, b.dl) THEN -gl / (hl + 1e0) ELSE -(gt - gl) / (ht - hl + 1e0) END AS p, b.feature, b.nx, b.dl FROM li, mean, best b)"
)


def _stump(spark: SparkSession, sf: str, depth: int = 1, turns: int = 1, backend: str = "arrow", **more: object) -> tuple[BoostedModel, Dataset]:
    frame = li(spark, sf).select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), "f0", "f1", "f2", "y")
    d = Dataset(frame, ("f0", "f1", "f2"), label="y")
    return boost.train(TrainingParams(**({"max_depth": depth} | more)), d, turns, backend=backend).model, d


@query("boost_stump_round", f"{_STUMP} SELECT feature, round(nx::DOUBLE, 5) AS threshold, dl AS default_left, round(p, 4) AS prediction, count(*)::BIGINT AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse FROM pred GROUP BY 1, 2, 3, 4")
def boost_stump_round(spark: SparkSession, sf: str) -> DataFrame:
    """One round of depth 1 from table to predictions."""
    model, d = _stump(spark, sf)
    t = model.trees[0]
    p = model.predict(d, ("row_id", "y")).withColumn("prediction", _r(F.col("prediction"), 6))
    by = p.groupBy(_r(F.col("prediction"), 4).alias("prediction")).agg(F.count("*").alias("n"), _r(F.sqrt(F.avg((F.col("prediction") - F.col("y")) * (F.col("prediction") - F.col("y")))), 4).alias("rmse"))
    return by.select(F.lit(int(t.feature[0])).alias("feature"), F.lit(round(float(np.float32(t.threshold[0])), 5)).alias("threshold"), F.lit(bool(t.default_left[0])).alias("default_left"), "prediction", "n", "rmse")


@query("boost_rmse_never_rises", "SELECT true AS falls, 6::BIGINT AS rounds")
def _(spark: SparkSession, sf: str) -> DataFrame:
    frame = li(spark, sf).select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), "f0", "f1", "f2", "y")
    d = Dataset(frame, ("f0", "f1", "f2"), label="y")
    got = boost.train(TrainingParams(max_depth=3), d, 6, [("train", d)], backend="arrow").history_frame(spark)
    step = got.withColumn("before", F.lag("value").over(Window.orderBy("iteration")))
    return step.agg(F.min(F.coalesce(F.col("value") <= F.col("before"), F.lit(True))).alias("falls"), F.count("*").alias("rounds"))


#: Rows of LI as training rows; row_id only has to be a number.
_LD = f"{LI}, d AS (SELECT f0, f1, f2, y, true AS tr FROM li)"
_SUMMARY = "SELECT count(*)::BIGINT AS n, round(avg(m), 4) AS mean, round(sqrt(avg((m - y) * (m - y))), 4) AS rmse FROM {}"


def _rounds_query(name: str, depth: int = 3, turns: int = 3, grown: dict | None = None, oracle: int | None = None, sql: list[str] | None = None, **params: object) -> None:
    """A query of the predictions' summary after some rounds; grown: what the SQL's trees are told; oracle: its rounds, if not as many; sql: what makes r in their place."""
    own = turns if oracle is None else oracle
    ctes = sql or rounds("r", "d", ("f0", "f1", "f2"), depth, own, **(grown or {}))

    @query(name, f"WITH {_LD}, {', '.join(ctes)} {_SUMMARY.format('r' if sql else f'r_{own}')}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        model, d = _stump(spark, sf, depth, turns, **params)
        p, y = F.col("prediction"), F.col("y")
        return model.predict(d, ("row_id", "y")).agg(F.count("*").alias("n"), _r(F.avg(p), 4).alias("mean"), _r(F.sqrt(F.avg((p - y) * (p - y))), 4).alias("rmse"))


_rounds_query("boost_depth2", depth=2)
_rounds_query("boost_depth3")
_rounds_query("boost_exact", depth=2, tree_method="exact", grown={"exact": True})
_rounds_query("boost_approx", depth=2, tree_method="approx")
_rounds_query("boost_lossguide", depth=2, grow_policy="lossguide", max_leaves=3, max_depth=0, grown={"leaves": 3})
_rounds_query("boost_monotone", depth=3, turns=2, monotone_constraints=(1, 1, -1), grown={"monotone": (1, 1, -1)})
_rounds_query("boost_interaction", turns=2, interaction_constraints=((0, 2), (1,)), grown={"groups": ((0, 2), (1,))})
# With a rate of 1 every tree so far is dropped, so all are the first one's like and share its weight.
_rounds_query("boost_dart", depth=2, booster="dart", rate_drop=1.0, oracle=1)


_rounds_query("boost_dart_half", depth=2, turns=5, booster="dart", rate_drop=0.5, skip_drop=0.3, seed=4, sql=dart_rounds("d", ("f0", "f1", "f2"), 2, 5, 0.5, 0.3, 4))
_rounds_query("boost_columns_sampled", turns=4, colsample_bytree=0.7, colsample_bynode=0.5, seed=3, grown={"columns": sampled_columns(3, 3, 0.7, 0.5)})
# The other backends over the same rows.
_rounds_query("boost_catalyst_depth3", turns=2, backend="catalyst")
_rounds_query("boost_catalyst_monotone", turns=1, monotone_constraints=(1, 1, -1), grown={"monotone": (1, 1, -1)}, backend="catalyst")
_rounds_query("boost_task_depth3", backend="task")


@query("ml_pipeline_depth2", f"WITH {_LD}, {', '.join(rounds('r', 'd', ('f0', 'f1', 'f2'), 2, 2))} {_SUMMARY.format('r_2')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A pipeline of pyspark.ml, fitted, saved to the shared folder and loaded again."""
    frame, folder = li(spark, sf).select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), "f0", "f1", "f2", "y"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    Pipeline(stages=[Boosting(featuresCols=["f0", "f1", "f2"], labelCol="y", rounds=2, maxDepth=2, backend="arrow")]).fit(frame).save(folder)
    p, y = F.col("prediction"), F.col("y")
    got = PipelineModel.load(folder).transform(frame)
    return got.agg(F.count("*").alias("n"), _r(F.avg(p), 4).alias("mean"), _r(F.sqrt(F.avg((p - y) * (p - y))), 4).alias("rmse"))


@query("boost_sparse_depth3", f"WITH {_LD}, {', '.join(rounds('r', 'd', ('f0', 'f1', 'f2'), 3, 3))} {_SUMMARY.format('r_3')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The cells that are there, in arrays, give the trees of the table."""
    cells = F.array_compact(F.array(*[F.when(F.col(f"f{k}").isNotNull(), F.struct(F.lit(k).alias("i"), F.col(f"f{k}").alias("v"))) for k in range(3)]))
    frame = li(spark, sf).select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), "y", cells.alias("c"))
    d = SparseDataset(frame.select("row_id", "y", F.col("c.i").alias("indices"), F.col("c.v").alias("values")), 3, label="y")
    p, y = F.col("prediction"), F.col("y")
    got = boost.train(TrainingParams(max_depth=3), d, 3).model.predict(d, ("row_id", "y"))
    return got.agg(F.count("*").alias("n"), _r(F.avg(p), 4).alias("mean"), _r(F.sqrt(F.avg((p - y) * (p - y))), 4).alias("rmse"))


def _ev_data(spark: SparkSession, sf: str, label: str, *more: str) -> Dataset:
    return Dataset(ev(spark, sf).select("event_id", *more, F.col("s").cast("float").alias("f0"), F.col("m").cast("float").alias("f1"), F.col(label).alias("y")), ("f0", "f1"), "event_id", "y")


_EX = "CAST(s AS FLOAT) AS f0, CAST(m AS FLOAT) AS f1"
_FOLD = "floor(((event_id * 2654435761 + {seed} * 40503) % 4294967296) / 8e0)::BIGINT % {folds}"
_KEEP = "(event_id * 2654435761 + (3 * 40503 + {turn} * 9973 + 12345)) % 4294967296 < 3006477107"


@query("boost_sampled", f"WITH {EV}, d AS (SELECT event_id, y, {_EX}, true AS tr FROM ev), {', '.join(rounds('r', 'd', ('f0', 'f1'), 2, 3, sampled=_KEEP, margin='avg(y)'))} SELECT event_id, round(m, 4) AS prediction FROM r_3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = _ev_data(spark, sf, "y")
    model = boost.train(TrainingParams(max_depth=2, subsample=0.7, seed=3, max_bin=1 << 11), d, 3, backend="arrow").model
    return model.predict(d, ("event_id",)).select("event_id", _r(F.col("prediction"), 4).alias("prediction"))


_LOSS = "-(y * ln(least(greatest(1e0 / (1e0 + exp(-m)), 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(1e0 / (1e0 + exp(-m)), 1e-15), 1 - 1e-15)))"
_HISTORY = " UNION ALL ".join(f"SELECT {t}::INT AS iteration, avg({_LOSS}) AS value FROM r_{t + 1} WHERE NOT tr" for t in range(5))


@query(
    "boost_early_stop",
    f"WITH {EV}, d AS (SELECT event_id, yb AS y, {_EX}, {_FOLD.format(seed=0, folds=4)} <> 0 AS tr FROM ev), {', '.join(rounds('r', 'd', ('f0', 'f1'), 2, 5, LOGISTIC, 'ln(avg(y) / (1e0 - avg(y)))'))}, h AS ({_HISTORY}), "
    "k AS (SELECT *, min(value) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM h), f AS (SELECT *, min(CASE WHEN value = low THEN iteration END) OVER (PARTITION BY low) AS best FROM k), "
    "e AS (SELECT coalesce(min(iteration), 99) AS last FROM f WHERE iteration - best >= 2) SELECT iteration, round(value, 5) AS value FROM f, e WHERE iteration <= last",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = _ev_data(spark, sf, "yb")
    fold = trees.fold_of(F.col("event_id"), 4)
    p = TrainingParams(objective="binary:logistic", max_depth=2, max_bin=1 << 11)
    got = boost.train(p, d.select_rows(fold != 0), 5, [("test", d.select_rows(fold == 0))], patience=2, backend="arrow")
    return got.history_frame(spark).select("iteration", _r(F.col("value"), 5).alias("value"))


_SOFT = [c for k in range(3) for c in tree(f"t{k}", "d", f"1e0 / 3e0 - CASE WHEN y = {k} THEN 1e0 ELSE 0e0 END", "2e0 * (1e0 / 3e0) * (1e0 - 1e0 / 3e0)", ("f0", "f1"), 2)]


@query(
    "boost_softmax",
    f"WITH {EV}, d AS (SELECT event_id, CAST(CAST(yc AS INT) % 3 AS DOUBLE) AS y, {_EX}, true AS tr FROM ev), {', '.join(_SOFT)}, a AS (SELECT event_id, exp(3e-1 * t0.lw) AS e0, exp(3e-1 * t1.lw) AS e1, exp(3e-1 * t2.lw) AS e2 FROM t0 JOIN t1 USING (event_id) JOIN t2 USING (event_id)) "
    "SELECT event_id, round(e0 / (e0 + e1 + e2), 4) AS p0, round(e1 / (e0 + e1 + e2), 4) AS p1, round(e2 / (e0 + e1 + e2), 4) AS p2 FROM a",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = _ev_data(spark, sf, "yc")
    d = d.with_(frame=d.frame.withColumn("y", F.col("y") % 3))
    model = boost.train(TrainingParams(objective="multi:softprob", num_class=3, max_depth=2, max_bin=1 << 11), d, 1, backend="arrow").model
    p = F.col("prediction")
    return model.predict(d, ("event_id",)).select("event_id", *[_r(p[k], 4).alias(f"p{k}") for k in range(3)])


@query("boost_rank_ndcg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = _ev_data(spark, sf, "yr", "user_id").with_(qid="user_id")
    return boost.train(TrainingParams(objective="rank:ndcg", max_depth=2), d, 3, [("train", d)], backend="arrow").history_frame(spark)


_FOLDS = [c for k in range(3) for c in (f"d{k} AS (SELECT event_id, y, {_EX}, {_FOLD.format(seed=0, folds=3)} <> {k} AS tr FROM ev)", *rounds(f"k{k}", f"d{k}", ("f0", "f1"), 2, 2))]
_SCORES = " UNION ALL ".join(f"SELECT {t}::INT AS iteration, sqrt(avg((m - y) * (m - y))) AS value FROM k{k}_{t + 1} WHERE NOT tr" for k in range(3) for t in range(2))


@query("cv_folds", f"WITH {EV}, {', '.join(_FOLDS)}, h AS ({_SCORES}) SELECT 'rmse' AS metric, iteration, round(avg(value), 4) AS test_mean, round(stddev_pop(value), 4) AS test_std FROM h GROUP BY iteration")
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = cv.cross_validate(spark, TrainingParams(max_depth=2, max_bin=1 << 11), _ev_data(spark, sf, "y"), 2, 3)
    return got.select("metric", "iteration", _r(F.col("test_mean"), 4).alias("test_mean"), _r(F.col("test_std"), 4).alias("test_std"))


@query("cv_agg", f"WITH {EV}, h AS (SELECT (event_id % 5)::INT AS fold, 'rmse' AS metric, (event_id % 3)::INT AS iteration, avg(y) AS value FROM ev GROUP BY 1, 2, 3) SELECT metric, iteration, round(avg(value), 7) AS test_mean, round(stddev_pop(value), 7) AS test_std FROM h GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    h = ev(spark, sf).groupBy((i % 5).cast("int").alias("fold"), F.lit("rmse").alias("metric"), (i % 3).cast("int").alias("iteration")).agg(F.avg("y").alias("value"))
    return cv.aggregate(h).select("metric", "iteration", _r(F.col("test_mean"), 7).alias("test_mean"), _r(F.col("test_std"), 7).alias("test_std"))


def _linear(p: TrainingParams, d: Dataset | SparseDataset, cells: int = linear.CELLS) -> DataFrame:
    """(feature, weight) of one round of the linear booster from 0.5 on; -1 is the intercept."""
    o = objectives.create(p)
    got = linear.fit_linear(p, o, boost._prepared(p, [d], 1), len(d.features), 1, 0.5, cells)
    found = [(-1, float(got.bias[0])), *[(int(f), float(got.weights[f, 0])) for f in np.flatnonzero(got.weights[:, 0])]]
    return d.frame.sparkSession.createDataFrame(found, "feature int, weight double").select("feature", _r(F.col("weight")).alias("weight"))


_LINEAR_ROUND = f"""WITH {LI}, x AS (SELECT f0::DOUBLE AS a, f1::DOUBLE AS b, coalesce(f2, 0)::DOUBLE AS c, (5e-1 - y)::FLOAT::DOUBLE AS g FROM li),
 s AS (SELECT count(*)::DOUBLE AS n, sum(g) AS g, sum(g * a) AS ga, sum(g * b) AS gb, sum(g * c) AS gc, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM x),
 s0 AS (SELECT *, -5e-1 * g / n AS d FROM s), u1 AS (SELECT *, -(ga + d * a) AS u FROM s0), s1 AS (SELECT * EXCLUDE (u), 5e-1 * sign(u) * greatest(abs(u) - 5e0, 0e0) / (aa + 1e0) AS wa FROM u1),
 u2 AS (SELECT *, -(gb + d * b + wa * ab) AS u FROM s1), s2 AS (SELECT * EXCLUDE (u), 5e-1 * sign(u) * greatest(abs(u) - 5e0, 0e0) / (bb + 1e0) AS wb FROM u2),
 u3 AS (SELECT *, -(gc + d * c + wa * ac + wb * bc) AS u FROM s2), s3 AS (SELECT *, 5e-1 * sign(u) * greatest(abs(u) - 5e0, 0e0) / (cc + 1e0) AS wc FROM u3)"""


def _linear_sql(*features: int) -> str:
    columns = zip((-1, *features), ("d", "wa", "wb", "wc"), strict=True)
    return f"{_LINEAR_ROUND} {' UNION ALL '.join(f'SELECT {f}::INT AS feature, round({c}, 6) + 0e0 AS weight FROM s3' for f, c in columns)}"


@query(
    "gblinear_round",
    f"WITH {EV}, x AS (SELECT (s::FLOAT)::DOUBLE AS s, y, avg(y) OVER () AS mu FROM ev), a AS (SELECT sum((mu - y)::FLOAT::DOUBLE) AS g0, count(*)::DOUBLE AS h0, sum((mu - y)::FLOAT::DOUBLE * s) AS g1, sum(s) AS h01, sum(s * s) AS h11 FROM x), b AS (SELECT *, -5e-1 * g0 / h0 AS bias FROM a) SELECT round(bias, 6) + 0e0 AS bias, round(-5e-1 * (g1 + h01 * bias) / (h11 + 1e0), 6) + 0e0 AS weight FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset.of(ev(spark, sf).select("event_id", "y", "s"), ["s"], "event_id", label="y")
    fitted = boost.train(TrainingParams(booster="gblinear", eta=0.5), d, 1).model.linear
    return spark.createDataFrame([(float(fitted.bias[0]), float(fitted.weights[0, 0]))], "bias double, weight double").select(_r(F.col("bias")).alias("bias"), _r(F.col("weight")).alias("weight"))


@query("gblinear_blocks", _linear_sql(0, 1, 2))
def _(spark: SparkSession, sf: str) -> DataFrame:
    # a block of two coordinates at a time
    d = Dataset(li(spark, sf).withColumn("row_id", F.col("l_orderkey")), ("f0", "f1", "f2"), label="y")
    return _linear(TrainingParams(booster="gblinear", eta=0.5, alpha=5.0), d, 4)


@query("gblinear_sparse", _linear_sql(7, 50_000, 99_999))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf).select(F.col("l_orderkey").alias("row_id"), "y", F.array(*[F.lit(f) for f in (99_999, 7, 50_000)]).alias("indices"), F.array("f2", "f0", "f1").alias("values"))
    return _linear(TrainingParams(booster="gblinear", eta=0.5, alpha=5.0), SparseDataset(rows, 100_000, label="y"))


@query("dart_weights", "SELECT 2 AS dropped, round(1e0 / 3, 9) AS new_weight, round(2e0 / 3, 9) AS kept_share")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Every tree is dropped in every round, so the third round drops two.
    was, now = (_stump(spark, sf, 1, n, booster="dart", rate_drop=1.0)[0].weights for n in (2, 3))
    dropped = sum(a != b for a, b in zip(was, now))
    return spark.createDataFrame([(dropped, now[2], now[0] / was[0])], "dropped int, new_weight double, kept_share double").select("dropped", _r(F.col("new_weight"), 9).alias("new_weight"), _r(F.col("kept_share"), 9).alias("kept_share"))


# prediction by a model written down here: two trees on (f0, f1, f2)


def fixed_model(objective: str = "binary:logistic") -> BoostedModel:
    a = Tree([0, 0, 2, 0, 0], [26.0, 0.0, 0.05, 0.0, 0.0], [False, False, True, False, False], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, -0.4, 0.0, 0.3, 0.7], [100.0, 50.0, 50.0, 30.0, 20.0], [9.0, 0.0, 4.0, 0.0, 0.0])
    b = Tree([1, 0, 0], [0.06, 0.0, 0.0], [True, False, False], [1, -1, -1], [2, -1, -1], [0.0, 0.25, -0.5], [100.0, 60.0, 40.0], [5.0, 0.0, 0.0])
    for t in (a, b):
        t.categories, t.left_bins, t.bin = [None] * len(t), [None] * len(t), [0] * len(t)
    p = TrainingParams(objective=objective)
    return BoostedModel(p, objectives.create(p), 3, 0.1, [a, b], [1.0, 0.5])


_LEAF = "CASE WHEN coalesce(f0 < CAST(26 AS FLOAT), false) THEN 1 ELSE CASE WHEN coalesce(f2 < CAST(0.05 AS FLOAT), true) THEN 3 ELSE 4 END END AS a, CASE WHEN coalesce(f1 < CAST(0.06 AS FLOAT), true) THEN 1 ELSE 2 END AS b"
_FIXED = f"WITH {LI}, l AS (SELECT *, {_LEAF} FROM li), p AS (SELECT *, 1e-1 + CASE a WHEN 1 THEN -4e-1 WHEN 3 THEN 3e-1 ELSE 7e-1 END + 5e-1 * CASE b WHEN 1 THEN 25e-2 ELSE -5e-1 END AS m FROM l)"
_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "f0")


def _li_data(spark: SparkSession, sf: str) -> Dataset:
    return Dataset(li(spark, sf), ("f0", "f1", "f2"), "l_orderkey")


@query("predict_margin", f"{_FIXED} SELECT l_orderkey, l_partkey, round(m, 5) AS margin FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_model().predict_margin(_li_data(spark, sf), ("l_orderkey", "l_partkey")).select("l_orderkey", "l_partkey", _r(F.col("margin"), 5).alias("margin"))


@query("predict_margin_limited", f"{_FIXED} SELECT round(m - 5e-1 * CASE b WHEN 1 THEN 25e-2 ELSE -5e-1 END, 5) AS margin, count(*)::BIGINT AS n FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_model().predict_margin(_li_data(spark, sf), limit=1).groupBy(_r(F.col("margin"), 5).alias("margin")).agg(F.count("*").alias("n"))


@query("predict_prob", f"{_FIXED} SELECT round(1e0 / (1e0 + exp(-m)), 5) AS prediction, count(*)::BIGINT AS n FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_model().predict(_li_data(spark, sf)).groupBy(_r(F.col("prediction"), 5).alias("prediction")).agg(F.count("*").alias("n"))


@query("predict_class", f"{_FIXED} SELECT CASE WHEN m > 0 THEN 1 ELSE 0 END AS class, count(*)::BIGINT AS n FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_model().predict_class(_li_data(spark, sf)).groupBy("class").agg(F.count("*").alias("n"))


@query("predict_leaf", f"{_FIXED} SELECT a, b, count(*)::BIGINT AS n FROM p GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = fixed_model().predict_leaf(_li_data(spark, sf))
    return got.groupBy(F.col("leaves")[0].alias("a"), F.col("leaves")[1].alias("b")).agg(F.count("*").alias("n"))


@query("predict_array_walk", f"{_FIXED} SELECT l_orderkey, l_partkey, round(m, 5) AS margin FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fixed_model()
    got = m._mapped(_li_data(spark, sf), "margin", m._shape(), lambda mm, x, b: mm.np_margin(x, b)[:, 0], ("l_orderkey", "l_partkey"))
    return got.select("l_orderkey", "l_partkey", _r(F.col("margin"), 5).alias("margin"))


@query("predict_linear", f"WITH {LI} SELECT l_orderkey, l_partkey, round(5e-1 + 1e-1 + 2e-2 * f0 - 3e0 * f1 + coalesce(f2, 0), 3) + 0e0 AS margin FROM li")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fixed_model("reg:squarederror")
    m.trees, m.weights, m.base_score, m.linear = [], [], 0.5, Linear(np.array([[0.02], [-3.0], [1.0]]), np.array([0.1]))
    got = m.predict_margin(_li_data(spark, sf), ("l_orderkey", "l_partkey"))
    return got.select("l_orderkey", "l_partkey", _r(F.col("margin"), 3).alias("margin"))


_INNER = " UNION ALL ".join(f"SELECT feature, gain AS g, hl + hr AS h FROM r_{t}t_b{k}" for t in range(3) for k in range(2))
_GROWN = f"WITH {_LD}, {', '.join(rounds('r', 'd', ('f0', 'f1', 'f2'), 2, 3, eta='1e0'))}, n AS ({_INNER})"
for _kind, _e in (("weight", "count(*)::DOUBLE"), ("gain", "avg(g)"), ("cover", "avg(h)"), ("total_gain", "sum(g)"), ("total_cover", "sum(h)")):

    def _imp(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        return _stump(spark, sf, 2, 3, eta=1.0)[0].importance(spark, kind).select("feature", _r(F.col("importance"), 3).alias("importance"))

    query(f"importance_{_kind}", f"{_GROWN} SELECT feature, round({_e}, 3) AS importance FROM n GROUP BY feature")(_imp)


@query("model_accessors", f"{_GROWN} SELECT 3 AS trees, 1 AS outputs, 3 AS rounds, 3 AS features, (3 + 2 * count(*))::BIGINT AS nodes, (3 + count(*))::BIGINT AS leaves FROM n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = _stump(spark, sf, 2, 3, eta=1.0)
    return m.nodes_frame(spark).agg(F.lit(len(m.trees)).alias("trees"), F.lit(m.outputs).alias("outputs"), F.lit(m.rounds).alias("rounds"), F.lit(m.n_features).alias("features"), F.count("*").alias("nodes"), F.sum((F.col("left") < 0).cast("long")).alias("leaves"))


@query("model_round_trip", f"{_FIXED} SELECT round(m, 5) AS margin, count(*)::BIGINT AS n FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = BoostedModel.from_bytes(BoostedModel.from_json(fixed_model().to_json()).to_bytes())
    return m.predict_margin(_li_data(spark, sf)).groupBy(_r(F.col("margin"), 5).alias("margin")).agg(F.count("*").alias("n"))


@query("xgboost_json_round_trip", f"{_FIXED} SELECT round(m + 5e-1 * CASE b WHEN 1 THEN 25e-2 ELSE -5e-1 END, 5) AS margin, count(*)::BIGINT AS n FROM p GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fixed_model()
    m.weights = [1.0, 1.0]
    back = interop.import_json(interop.export_json(m))
    return back.predict_margin(_li_data(spark, sf)).groupBy(_r(F.col("margin"), 5).alias("margin")).agg(F.count("*").alias("n"))


@query("shap_stump", f"{_FIXED} SELECT l_orderkey, l_partkey, round(5e-1 * (CASE b WHEN 1 THEN 25e-2 ELSE -5e-1 END - (25e-2 * 6e-1 - 5e-1 * 4e-1)), 6) AS phi, round(1e-1 + 5e-1 * (25e-2 * 6e-1 - 5e-1 * 4e-1), 6) AS bias FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fixed_model()
    m.trees, m.weights = m.trees[1:], m.weights[1:]
    got = m.contributions(_li_data(spark, sf), ("l_orderkey", "l_partkey"))
    return got.select("l_orderkey", "l_partkey", _r(F.col("contributions")[0][1]).alias("phi"), _r(F.col("contributions")[0][3]).alias("bias"))


@query("shap_additivity", f"{_FIXED} SELECT l_orderkey, l_partkey, round(m, 5) AS total FROM p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = fixed_model().contributions(_li_data(spark, sf), ("l_orderkey", "l_partkey"))
    return got.select("l_orderkey", "l_partkey", _r(F.aggregate(F.col("contributions")[0], F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    "shap_interaction_rows",
    f"WITH {LI}, x AS (SELECT l_orderkey, l_partkey, f0 < CAST(26 AS FLOAT) AS a, coalesce(f2 < CAST(0.05 AS FLOAT), true) AS c FROM li), "
    # v of each set of known features; the split on f0 covers 50 to 50 rows, the one on f2 30 to 20
    "v AS (SELECT *, CASE WHEN c THEN 3e-1 ELSE 7e-1 END AS deep, 6e-1 * 3e-1 + 4e-1 * 7e-1 AS flat FROM x), "
    "g AS (SELECT l_orderkey, l_partkey, 5e-1 * -4e-1 + 5e-1 * flat AS v0, CASE WHEN a THEN -4e-1 ELSE flat END AS va, 5e-1 * -4e-1 + 5e-1 * deep AS vc, CASE WHEN a THEN -4e-1 ELSE deep END AS vac FROM v) "
    "SELECT l_orderkey, l_partkey, round((vac - va - vc + v0) / 2e0, 5) + 0e0 AS pair, round((va - v0 + vac - vc) / 2e0 - (vac - va - vc + v0) / 2e0, 5) + 0e0 AS own FROM g",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fixed_model()
    m.trees, m.weights = m.trees[:1], m.weights[:1]
    shape = T.ArrayType(T.FloatType())
    got = m._mapped(_li_data(spark, sf), "both", shape, lambda mm, x, b: shap.interactions(mm, x)[:, 0, 0, [0, 2]].astype(np.float32), ("l_orderkey", "l_partkey"))
    return got.select("l_orderkey", "l_partkey", _r(F.col("both")[1], 5).alias("pair"), _r(F.col("both")[0], 5).alias("own"))


@query(
    "dense_array_features",
    "SELECT vec_id, round(CASE WHEN embedding[1] < 0 THEN -1e0 ELSE 1e0 END + CASE WHEN embedding[31] < 0 THEN -2e0 ELSE 2e0 END + CASE WHEN embedding[64] < 0 THEN -4e0 ELSE 4e0 END, 3) AS side FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A model over all numbers of a vector, whose trees split on the first, one inside and the last."""
    names = [f"f{k}" for k in range(64)]
    e = _t(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[k].alias(f) for k, f in enumerate(names)])
    m = fixed_model("reg:squarederror")
    m.trees = [Tree([f, 0, 0], [0.0, 0.0, 0.0], [False] * 3, [1, -1, -1], [2, -1, -1], [0.0, -w, w], [2.0, 1.0, 1.0], [1.0, 0.0, 0.0], [None] * 3, [0] * 3, [None] * 3) for f, w in ((0, 1.0), (30, 2.0), (63, 4.0))]
    m.weights, m.n_features, m.base_score = [1.0] * 3, 64, 0.0
    return m.predict_margin(Dataset(e, tuple(names), "vec_id")).select("vec_id", _r(F.col("margin"), 3).alias("side"))
