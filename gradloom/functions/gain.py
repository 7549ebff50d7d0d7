"""Leaf weights and gains, once for Columns and once for numpy; the two are tested against each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradloom.params import TrainingParams

#: A split must gain more than this.
EPS = 1e-6


def soft_threshold(g: Column, alpha: float) -> Column:
    """g moved towards 0 by alpha, and 0 within alpha."""
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def leaf_weight(g: Column, h: Column, p: TrainingParams) -> Column:
    """The best weight of a leaf with these sums; 0 where the hessian is too small."""
    w = -soft_threshold(g, p.alpha) / (h + p.reg_lambda)
    if p.max_delta_step > 0:
        w = F.least(F.greatest(w, F.lit(-p.max_delta_step)), F.lit(p.max_delta_step))
    return F.when((h < p.min_child_weight) | (h <= 0), F.lit(0.0)).otherwise(w)


def structure_score(g: Column, h: Column, p: TrainingParams) -> Column:
    """What a leaf takes off the loss, times two."""
    t = soft_threshold(g, p.alpha)
    if p.max_delta_step == 0:
        score = t * t / (h + p.reg_lambda)
    else:
        w = leaf_weight(g, h, p)
        score = -(2 * t * w + (h + p.reg_lambda) * w * w)
    return F.when((h < p.min_child_weight) | (h <= 0), F.lit(0.0)).otherwise(score)


def score_at(g: Column, h: Column, w: Column, p: TrainingParams) -> Column:
    """structure_score of a leaf whose weight is w."""
    t = soft_threshold(g, p.alpha)
    return F.when((h < p.min_child_weight) | (h <= 0), F.lit(0.0)).otherwise(-(2 * t * w + (h + p.reg_lambda) * w * w))


def split_gain(gl: Column, hl: Column, gr: Column, hr: Column, p: TrainingParams) -> Column:
    """What splitting a leaf in two gains."""
    return structure_score(gl, hl, p) + structure_score(gr, hr, p) - structure_score(gl + gr, hl + hr, p)


def np_threshold(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def np_weight(g: np.ndarray, h: np.ndarray, p: TrainingParams, low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf) -> np.ndarray:
    """leaf_weight, kept within bounds."""
    ok = (h >= p.min_child_weight) & (h > 0)
    w = np.where(ok, -np_threshold(g, p.alpha) / np.where(ok, h + p.reg_lambda, 1.0), 0.0)
    if p.max_delta_step > 0:
        w = np.clip(w, -p.max_delta_step, p.max_delta_step)
    return np.clip(w, low, high)


def np_score(g: np.ndarray, h: np.ndarray, p: TrainingParams) -> np.ndarray:
    ok = (h >= p.min_child_weight) & (h > 0)
    if p.max_delta_step == 0:
        t = np_threshold(g, p.alpha)
        return np.where(ok, t * t / np.where(ok, h + p.reg_lambda, 1.0), 0.0)
    return np_score_at(g, h, np_weight(g, h, p), p)


def np_score_at(g: np.ndarray, h: np.ndarray, w: np.ndarray, p: TrainingParams) -> np.ndarray:
    t = np_threshold(g, p.alpha)
    return np.where((h >= p.min_child_weight) & (h > 0), -(2 * t * w + (h + p.reg_lambda) * w * w), 0.0)
