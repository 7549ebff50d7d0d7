"""Evaluation metrics as DataFrame aggregates, one row out, over columns of predictions, labels and weights.

Predictions are on the output scale. Weighted means are 0 where the weights sum to nothing. Ranking metrics take groups
from `group`; without one all rows are one group. Null predictions raise: a metric of a part would mislead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.errors import GradloomError, UnknownName
from gradloom.operators.running import running_sums


@dataclass(frozen=True)
class Metric:
    """frame(df of p, y, w, r, and q where there are groups) gives a DataFrame of one row and the column value."""

    name: str
    frame: Callable[[DataFrame], DataFrame]
    maximize: bool = False

    def of(self, df: DataFrame, prediction: str, label: str, weight: str | None = None, group: str | None = None, order: str | None = None) -> DataFrame:
        """One row, column value. order settles ties of ranking metrics: the row's place in the data."""
        w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
        q = [] if group is None else [F.col(group).alias("q")]
        r = F.monotonically_increasing_id() if order is None else F.col(order)
        return self.frame(df.select(F.col(prediction).alias("p"), F.col(label).cast("double").alias("y"), w.alias("w"), *q, r.alias("r")))

    def value(self, *args: object, **named: object) -> float:
        got = self.of(*args, **named).collect()[0]["value"]
        if got is None:
            raise GradloomError(f"{self.name} isn't defined for these predictions")
        return float(got)


def _mean(loss: Callable[[], Column], finish: Callable[[Column], Column] = lambda c: c) -> Callable[[DataFrame], DataFrame]:
    def frame(df: DataFrame) -> DataFrame:
        total = F.sum("w")
        return df.agg(finish(F.when(total > 0, F.sum(loss() * F.col("w")) / total).otherwise(F.lit(0.0))).alias("value"))

    return frame


def _p() -> Column:
    return F.col("p").cast("double")


def _clamped(low: float, high: float | None) -> Column:
    p = F.greatest(_p(), F.lit(low))
    return p if high is None else F.least(p, F.lit(high))


def _logloss() -> Column:
    p = _clamped(1e-15, 1 - 1e-15)
    return -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))


def _mlogloss() -> Column:
    p = F.element_at(F.col("p").cast("array<double>"), (F.col("y") + 1).cast("int"))
    return -F.ln(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0)))


def _merror() -> Column:
    p = F.col("p").cast("array<double>")
    return (F.array_position(p, F.array_max(p)) - 1 != F.col("y").cast("long")).cast("double")


def _tweedie(rho: float) -> Callable[[], Column]:
    def loss() -> Column:
        p = _clamped(1e-8, None)
        return -F.col("y") * F.pow(p, F.lit(1 - rho)) / (1 - rho) + F.pow(p, F.lit(2 - rho)) / (2 - rho)

    return loss


def _auc(df: DataFrame) -> DataFrame:
    # By distinct prediction: how many of either label, and how many negatives below. No row of the data is sorted.
    by = df.groupBy("p").agg(F.sum((F.col("y") > 0.5).cast("long")).alias("pos"), F.sum((F.col("y") <= 0.5).cast("long")).alias("neg"))
    upto = running_sums(by, "p", {"upto": "neg"})
    s = upto.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return s.select(F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.lit(0.5)).otherwise(F.col("u") / (F.col("pos").cast("double") * F.col("neg"))).alias("value"))


def _aucpr(df: DataFrame) -> DataFrame:
    by = df.groupBy("p").agg(F.sum(F.when(F.col("y") > 0.5, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") > 0.5, 0.0).otherwise(F.col("w"))).alias("neg"))
    by = by.where((F.col("pos") > 0) | (F.col("neg") > 0))
    run = running_sums(by, "p", {"tp": "pos", "fp": "neg"}, ascending=False)
    # The point before: what the sums were without this prediction's own rows. The first has no precision of its own, and takes this one's.
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 1e-12 * (F.col("tp") + F.col("fp")), tp0 / (tp0 + fp0)).otherwise(precision)
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return run.agg(F.when(both, F.sum(F.col("pos") * (precision + before) / 2.0) / F.sum("pos")).otherwise(F.lit(0.0)).alias("value"))


def _ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with the place, from 1, of each row in its group by descending `by`, then r. Groups sort in tasks of their own; rows that have no groups in buckets."""
    if not _one_list(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), F.asc("r"))))
    return running_sums(df, by, {name: F.lit(1)}, ascending=False, order=[F.asc("r")])


def _one_list(df: DataFrame) -> bool:
    return "q" not in df.columns


def _group(df: DataFrame) -> list[str]:
    return [] if _one_list(df) else ["q"]


def _ndcg(k: int | None) -> Callable[[DataFrame], DataFrame]:
    def frame(df: DataFrame) -> DataFrame:
        ranked = _ranked(_ranked(df, "p", "at"), "y", "best")
        gain = F.pow(F.lit(2.0), F.col("y")) - 1
        within = lambda c: (F.col(c) <= k) if k else F.lit(True)
        term = lambda c: F.sum(F.when(within(c), gain / F.log2(F.col(c) + 1.0)).otherwise(0.0))
        per = ranked.groupBy(*_group(df)).agg(term("at").alias("dcg"), term("best").alias("ideal"))
        return per.agg(F.coalesce(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)), F.lit(0.0)).alias("value"))

    return frame


def _map(k: int | None) -> Callable[[DataFrame], DataFrame]:
    def frame(df: DataFrame) -> DataFrame:
        hit = (F.col("y") > 0).cast("int")
        ranked = _ranked(df.withColumn("hit", hit), "p", "at")
        if _one_list(df):
            ranked = running_sums(ranked, "at", {"hits": "hit"})
        else:
            ranked = ranked.withColumn("hits", F.sum("hit").over(Window.partitionBy("q").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        use = (F.col("hit") == 1) & ((F.col("at") <= k) if k else F.lit(True))
        per = ranked.groupBy(*_group(df)).agg(F.sum(F.when(use, F.col("hits") / F.col("at")).otherwise(0.0)).alias("s"), F.sum("hit").alias("n"))
        return per.agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)), F.lit(0.0)).alias("value"))

    return frame


#: Metrics that are means by weight: rows that are equal may count as one of all their weight.
MEANS = frozenset({"rmse", "mae", "logloss", "error", "mlogloss", "merror", "poisson-nloglik", "gamma-nloglik", "tweedie-nloglik"})

_PLAIN: dict[str, Callable[[], Metric]] = {
    "rmse": lambda: Metric("rmse", _mean(lambda: F.pow(_p() - F.col("y"), F.lit(2.0)), F.sqrt)),
    "mae": lambda: Metric("mae", _mean(lambda: F.abs(_p() - F.col("y")))),
    "logloss": lambda: Metric("logloss", _mean(_logloss)),
    "error": lambda: Metric("error", _mean(lambda: ((_p() > 0.5) != (F.col("y") > 0.5)).cast("double"))),
    "auc": lambda: Metric("auc", _auc, True),
    "aucpr": lambda: Metric("aucpr", _aucpr, True),
    "mlogloss": lambda: Metric("mlogloss", _mean(_mlogloss)),
    "merror": lambda: Metric("merror", _mean(_merror)),
    "poisson-nloglik": lambda: Metric("poisson-nloglik", _mean(lambda: _clamped(1e-8, None) - F.col("y") * F.ln(_clamped(1e-8, None)))),
    "gamma-nloglik": lambda: Metric("gamma-nloglik", _mean(lambda: F.col("y") / _clamped(1e-8, None) + F.ln(_clamped(1e-8, None)))),
}


def create(name: str) -> Metric:
    """The metric of a name, which may carry a parameter: ndcg@5, map@3, tweedie-nloglik@1.2."""
    base, _, given = name.partition("@")
    if base in _PLAIN and not given:
        return _PLAIN[base]()
    try:
        if base == "tweedie-nloglik":
            return Metric(base, _mean(_tweedie(float(given) if given else 1.5)))
        if base == "ndcg":
            return Metric(base, _ndcg(int(given) if given else None), True)
        if base == "map":
            return Metric(base, _map(int(given) if given else None), True)
    except ValueError:
        pass
    raise UnknownName(f"metric {name}")


def custom(name: str, frame: Callable[[DataFrame], DataFrame], maximize: bool = False) -> Metric:
    """A metric of one's own: frame takes (p, y, w, q, r) and gives one row with the column value."""
    return Metric(name, frame, maximize)
