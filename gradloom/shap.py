"""Shapley values of trees, path-dependent: by leaf, over the distinct features on its path, for all rows at once.

For a leaf, feature j on its path has o_j (1 if the row meets all of the path's conditions on j, else 0) and z_j (the product of the
shares of training weight that those conditions let through). The leaf's part of the expectation given a set S of
known features is value * prod of o over S * prod of z over the rest, so its Shapley value for j is value * (o_j - z_j)
times a weighted sum over the sets of the other features, which a polynomial in the set's size collects.

The o of a row are the bits of a number that grows along the path, shared by all leaves below. A leaf's values are worked out once for each such number: the polynomial of all the path's features is extended
along the path once, and each feature in turn is divided out of it again. Rows then look their number up.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial
from typing import TYPE_CHECKING

import numpy as np

from gradloom.plans.bins import Sparse
from gradloom.plans.kernel import Tree

if TYPE_CHECKING:
    from gradloom.model import BoostedModel

#: Paths of at most so many features have a table of all numbers; on longer ones only the rows' own are worked out.
TABLE = 10


def _leaves(tree: Tree, x: np.ndarray | Sparse) -> Iterator[tuple[float, list[int], np.ndarray, np.ndarray]]:
    """For each leaf: value, the distinct features on its path, each row's o as bits in that order, z."""
    rows = np.arange(len(x))
    stack = [(0, [], np.zeros(len(x), np.int64), [])]
    while stack:
        node, features, bits, shares = stack.pop()
        if tree.left[node] < 0:
            yield float(tree.value[node]), features, bits, np.array(shares)
            continue
        f = tree.feature[node]
        v = x[rows, np.full(len(x), f)] if isinstance(x, Sparse) else x[:, f]
        if tree.categories[node] is not None:
            left = np.isin(np.maximum(np.nan_to_num(v), 0).astype(np.int64), tree.categories[node])
        else:
            left = v < np.float32(tree.threshold[node])
        left = np.where(np.isnan(v), bool(tree.default_left[node]), left)
        total = tree.hess[tree.left[node]] + tree.hess[tree.right[node]]
        for child, goes in ((tree.right[node], ~left), (tree.left[node], left)):
            part = tree.hess[child] / total if total > 0 else 0.5
            if f in features:
                j = features.index(f)
                stack.append((child, features, np.where(goes, bits, bits & ~(1 << j)), [s * part if i == j else s for i, s in enumerate(shares)]))
            else:
                stack.append((child, [*features, f], bits | goes.astype(np.int64) << len(features), [*shares, part]))


def _numbers(bits: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(o of each number that occurs: numbers x m, where each row's number is among them)."""
    if m <= TABLE and 1 << m <= len(bits):
        own, at = np.arange(1 << m), bits
    else:
        own, at = np.unique(bits, return_inverse=True)
    return (own[:, None] >> np.arange(m) & 1).astype(float), at


def _extended(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """By set size (numbers x sizes): the sum over sets S of the features of prod of o over S * prod of z over the rest."""
    poly = np.zeros((len(o), len(z) + 1))
    poly[:, 0] = 1
    for j in range(len(z)):
        poly[:, 1 : j + 2] = poly[:, 1 : j + 2] * z[j] + poly[:, : j + 1] * o[:, j : j + 1]
        poly[:, 0] *= z[j]
    return poly


def _without(poly: np.ndarray, o: np.ndarray, z: float) -> np.ndarray:
    """poly with the feature (o of each number, z) divided out; 0 where both are 0, for such a feature's part is 0."""
    m = poly.shape[1] - 1
    out = np.zeros((len(poly), m))
    met = o > 0
    if m:
        out[:, m - 1] = poly[:, m]
        for k in range(m - 2, -1, -1):
            out[:, k] = poly[:, k + 1] - z * out[:, k + 1]
    if z > 0:
        out[~met] = poly[~met, :m] / z
    else:
        out[~met] = 0
    return out


def expectation(tree: Tree) -> float:
    """The mean of a tree's leaves, weighted by training weight."""
    return float(sum(v * np.prod(z) for v, _, _, z in _leaves(tree, np.zeros((0, max(tree.feature) + 1), np.float32))))


def contributions(model: BoostedModel, x: np.ndarray | Sparse, base: np.ndarray | None = None) -> np.ndarray:
    """rows x outputs x (features + 1)."""
    out = np.zeros((len(x), model.outputs, model.n_features + 1))
    out[:, :, -1] = model.base_score
    if base is not None:
        out[:, :, -1] = np.where(np.isnan(base), out[:, :, -1], base)
    for t in range(model.used_trees()):
        tree, w, k = model.trees[t], model.weights[t], t % model.outputs
        out[:, k, -1] += w * expectation(tree)
        for value, features, bits, z in _leaves(tree, x):
            m = len(features)
            o, at = _numbers(bits, m)
            poly = _extended(o, z)
            share = np.array([factorial(c) * factorial(m - c - 1) / factorial(m) for c in range(m)])
            for j, f in enumerate(features):
                out[:, k, f] += (w * value * (o[:, j] - z[j]) * (_without(poly, o[:, j], z[j]) @ share))[at]
    return out


def interactions(model: BoostedModel, x: np.ndarray | Sparse) -> np.ndarray:
    """rows x outputs x (features + 1) x (features + 1): off the diagonal half of each pair's interaction, on it the rest of the feature's contribution."""
    n = model.n_features
    out = np.zeros((len(x), model.outputs, n + 1, n + 1))
    phi = contributions(model, x)
    for t in range(model.used_trees()):
        tree, w, k = model.trees[t], model.weights[t], t % model.outputs
        out[:, k, n, n] += w * expectation(tree)
        for value, features, bits, z in _leaves(tree, x):
            m = len(features)
            o, at = _numbers(bits, m)
            poly = _extended(o, z)
            share = np.array([factorial(c) * factorial(m - c - 2) / (2 * factorial(m - 1)) for c in range(m - 1)])
            for a in range(m):
                rest = _without(poly, o[:, a], z[a])
                for b in range(a):
                    v = (w * value * (o[:, a] - z[a]) * (o[:, b] - z[b]) * (_without(rest, o[:, b], z[b]) @ share))[at]
                    out[:, k, features[a], features[b]] += v
                    out[:, k, features[b], features[a]] += v
    for f in range(n):
        out[:, :, f, f] = phi[:, :, f] - out[:, :, f, :n].sum(2) + out[:, :, f, f]
    return out
