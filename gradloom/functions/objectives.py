"""Objectives: gradients, hessians, transforms and starting margins.

Each formula is written once over a small set of operations that both Columns and numpy arrays have.
Margins are numbers, or arrays of num_class numbers for the softmax objectives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.errors import InvalidParameter, UnknownName
from gradloom.params import TrainingParams

MIN_HESS = 1e-16
POISSON_STEP = 0.7


class ColumnOps:
    exp, sqrt, log = staticmethod(F.exp), staticmethod(F.sqrt), staticmethod(F.ln)

    @staticmethod
    def where(c: Column, a: Any, b: Any) -> Column:
        return F.when(c, a).otherwise(b)

    @staticmethod
    def maximum(a: Column, b: float) -> Column:
        return F.greatest(a, F.lit(b))

    @staticmethod
    def ones(a: Column) -> Column:
        return F.lit(1.0)


class ArrayOps:
    exp, sqrt, log, where, maximum = np.exp, np.sqrt, np.log, np.where, np.maximum

    @staticmethod
    def ones(a: np.ndarray) -> np.ndarray:
        return np.ones_like(a, dtype=float)


def sigmoid(x: Any, m: Any) -> Any:
    """1 / (1 + exp(-m)) without overflow on either side."""
    e = x.exp(x.where(m >= 0, -m, m))
    return x.where(m >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


@dataclass(frozen=True)
class Objective:
    """grad(ops, margin, label, weight) gives (gradient, hessian); mean_margin maps the weighted mean of the labels to the starting margin."""

    name: str
    metric: str
    grad: Callable | None
    transform: Callable = lambda x, m: m
    mean_margin: Callable[[float], float] = lambda mean: mean
    score_margin: Callable[[float], float] = lambda s: s
    margin_score: Callable[[float], float] = lambda m: m
    outputs: int = 1
    rank: str = ""

    def gradient(self, margin: Column, label: Column, weight: Column | None = None) -> tuple[Column, Column]:
        """(gradient, hessian) as float Columns, or arrays of them for several outputs."""
        w = F.lit(1.0) if weight is None else weight.cast("double")
        if self.outputs > 1:
            prob = softmax(margin.cast("array<double>"))
            hit = lambda i: F.when(label == i, 1.0).otherwise(0.0)
            g = F.transform(prob, lambda p, i: ((p - hit(i)) * w).cast("float"))
            return g, F.transform(prob, lambda p: F.greatest(2.0 * p * (1.0 - p) * w, F.lit(MIN_HESS)).cast("float"))
        g, h = self.grad(ColumnOps, margin.cast("double"), label.cast("double"), w)
        return g.cast("float"), h.cast("float")

    def np_gradient(self, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for arrays; margins of several outputs are rows x outputs."""
        if self.outputs > 1:
            p = np_softmax(margin)
            y = np.arange(self.outputs)[None] == label[:, None]
            g, h = (p - y) * weight[:, None], np.maximum(2 * p * (1 - p) * weight[:, None], MIN_HESS)
        else:
            g, h = self.grad(ArrayOps, margin, label, weight)
        return np.asarray(g, np.float32).astype(float), np.asarray(h, np.float32).astype(float)

    def predict(self, margin: Column) -> Column:
        """Margins as predictions."""
        return softmax(margin) if self.outputs > 1 else self.transform(ColumnOps, margin)

    def np_predict(self, margin: np.ndarray) -> np.ndarray:
        return np_softmax(margin) if self.outputs > 1 else self.transform(ArrayOps, margin)

    def base_margin(self, mean: float) -> float:
        """The starting margin for labels of this weighted mean."""
        return 0.0 if self.outputs > 1 or self.rank else float(self.mean_margin(mean))


def softmax(margin: Column) -> Column:
    """An array of margins as probabilities."""
    e = F.transform(margin, lambda v: F.exp(v - F.array_max(margin)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def np_softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _squared(x: Any, m: Any, y: Any, w: Any) -> tuple:
    return (m - y) * w, x.ones(m) * w


def _pseudo_huber(x: Any, m: Any, y: Any, w: Any) -> tuple:
    d = m - y
    s = 1.0 + d * d
    return w * d / x.sqrt(s), w / (s * x.sqrt(s))


def _logistic(positive: float) -> Callable:
    def grad(x: Any, m: Any, y: Any, w: Any) -> tuple:
        p = sigmoid(x, m)
        w = x.where(y == 1.0, positive, 1.0) * w
        return (p - y) * w, x.maximum(p * (1.0 - p), MIN_HESS) * w

    return grad


def _poisson(x: Any, m: Any, y: Any, w: Any) -> tuple:
    return (x.exp(m) - y) * w, x.exp(m + POISSON_STEP) * w


def _gamma(x: Any, m: Any, y: Any, w: Any) -> tuple:
    e = y * x.exp(-m)
    return (1.0 - e) * w, e * w


def _tweedie(rho: float) -> Callable:
    def grad(x: Any, m: Any, y: Any, w: Any) -> tuple:
        a, b = x.exp((1.0 - rho) * m), x.exp((2.0 - rho) * m)
        return (b - y * a) * w, ((2.0 - rho) * b - y * (1.0 - rho) * a) * w

    return grad


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _log_mean(mean: float) -> float:
    return float(np.log(max(mean, 1e-6)))


def _exp(x: Any, m: Any) -> Any:
    return x.exp(m)


def create(params: TrainingParams) -> Objective:
    """The objective that params name."""
    name = params.objective
    if params.num_class > 1 and not name.startswith("multi:"):
        raise InvalidParameter(f"{name} has one output; num_class is for the softmax objectives")
    if name in ("reg:squarederror", "reg:linear"):
        return Objective("reg:squarederror", "rmse", _squared)
    if name == "reg:pseudohubererror":
        return Objective(name, "mae", _pseudo_huber)
    if name in ("binary:logistic", "reg:logistic"):
        sig = lambda v: float(1 / (1 + np.exp(-v)))
        return Objective(name, "logloss", _logistic(params.scale_pos_weight), sigmoid, _logit, _logit, sig)
    if name in ("multi:softprob", "multi:softmax"):
        if params.num_class < 2:
            raise InvalidParameter("the softmax objectives need num_class of at least 2")
        return Objective(name, "mlogloss", None, outputs=params.num_class)
    if name in ("count:poisson", "reg:gamma", "reg:tweedie"):
        grad, metric = {"count:poisson": (_poisson, "poisson-nloglik"), "reg:gamma": (_gamma, "gamma-nloglik"), "reg:tweedie": (_tweedie(params.tweedie_variance_power), "tweedie-nloglik")}[name]
        return Objective(name, metric, grad, _exp, _log_mean)
    if name in ("rank:pairwise", "rank:ndcg", "rank:map"):
        return Objective(name, {"rank:ndcg": "ndcg"}.get(name, "map"), None, rank=name[5:])
    raise UnknownName(f"objective {name}")


def custom(name: str, grad: Callable, metric: str = "rmse", transform: Callable | None = None, base: float = 0.0) -> Objective:
    """An objective of one's own; grad(ops, margin, label, weight) and transform(ops, margin) work on Columns and arrays alike."""
    return Objective(name, metric, grad, transform or (lambda x, m: m), lambda mean: base)


def weighted_mean(df: DataFrame, label: str, weight: str | None = None) -> Column:
    """The labels' weighted mean as an aggregate; 0 without weight."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    total = F.sum(w)
    return F.when(total > 0, F.sum(F.col(label).cast("double") * w) / total).otherwise(F.lit(0.0))
