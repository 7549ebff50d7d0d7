"""The linear booster: coordinate descent on second-order sums, one block of features after another.

Within a round gradients and hessians belong to the margins at its start; a step of one weight moves the gradients of the rows by h x step. A block of
features therefore needs its own sums only: sum g x_f of the gradients as the steps before it left them, and sum h x_f x_j within the block. One job over the
stored rows gives them for all outputs, and the driver sweeps through the block. A block has at most `CELLS` such products over all outputs, whatever
the number of features, in every task and on the driver; the intercept is the first coordinate of the first block, without penalties.
Only features that occur in sparse data are in a block. Missing features count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradloom.errors import FeatureOutOfBounds
from gradloom.functions.gain import np_threshold
from gradloom.functions.objectives import Objective
from gradloom.functions.ranking import lambda_gradients
from gradloom.model import Linear
from gradloom.params import TrainingParams
from gradloom.plans import bins

#: Products of two features that a block has over all outputs.
CELLS = 1 << 22
#: Pairs of cells, or numbers of a dense part, that a task makes at once.
HELD = 1 << 21


def _decoder(names: list[str], n: int):  # noqa: ANN202
    """A function from a batch to its rows over n + 1 coordinates, of which the first is 1 everywhere."""
    if "f" not in names:
        x = names.index("x")

        def dense(batch: pa.RecordBatch) -> np.ndarray:
            own = batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            return np.hstack([np.ones((len(own), 1)), np.nan_to_num(own)])

        return dense
    f, v = names.index("f"), names.index("v")

    def sparse(batch: pa.RecordBatch) -> bins.Sparse:
        off, features = bins.flat(batch.column(f))
        off, features, values = bins.deduplicated(off, features, bins.flat(batch.column(v))[1].astype(np.float32), n)
        start = off[:-1]
        return bins.Sparse(off + np.arange(len(off)), np.insert(features + 1, start, 0), np.insert(values.astype(float), start, 1.0), n + 1, 0.0)

    return sparse


def _dot(rows: np.ndarray | bins.Sparse, weights: np.ndarray) -> np.ndarray:
    if isinstance(rows, bins.Sparse):
        return np.stack([np.bincount(rows.owner, rows.numbers * w[rows.features], len(rows)) for w in weights.T], 1)
    return rows @ weights


def _add_dense(sums: np.ndarray, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    for k in range(len(sums)):
        sums[k, :, :-1] += (x * h[:, k, None]).T @ x
        sums[k, :, -1] += x.T @ g[:, k]


def _add_sparse(sums: np.ndarray, rows: bins.Sparse, block: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """The cells of rows in a block: pairs of a row's cells, or dense parts where nearly every cell is there."""
    b = len(block)
    place = np.minimum(np.searchsorted(block, rows.features), b - 1)
    own = np.flatnonzero(block[place] == rows.features)
    owner, place, value = rows.owner[own], place[own], rows.numbers[own]
    per_row = np.bincount(owner, minlength=len(rows))
    ends = np.cumsum(per_row)
    # cells are ascending by feature, so that a cell meets itself and the later ones of its row: the upper triangle
    later = np.repeat(ends, per_row) - np.arange(len(owner))
    for k in range(len(sums)):
        np.add.at(sums[k, :, -1], place, g[owner, k] * value)
    dense = later.sum() * 16 > len(rows) * b * b
    cost = np.cumsum(np.full(len(rows), b) if dense else np.bincount(owner, later, len(rows)))
    cuts = np.searchsorted(cost, np.arange(1, int(cost[-1] // HELD) + 2) * HELD) if len(cost) else np.zeros(0, int)
    edges = np.unique(np.concatenate([[0], cuts, [len(rows)]]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        s, e = (ends[lo - 1] if lo else 0), ends[hi - 1]
        if s == e:
            continue
        if dense:
            x = np.zeros((hi - lo, b))
            x[owner[s:e] - lo, place[s:e]] = value[s:e]
            for k in range(len(sums)):
                sums[k, :, :-1] += (x * h[lo:hi, k, None]).T @ x
            continue
        first = np.repeat(np.arange(s, e), later[s:e])
        second = first + np.arange(len(first)) - np.repeat(np.cumsum(later[s:e]) - later[s:e], later[s:e])
        for k in range(len(sums)):
            np.add.at(sums[k], (place[first], place[second]), h[owner[first], k] * value[first] * value[second])


def block_sums(frame: DataFrame, o: Objective, n: int, at: np.ndarray, steps: np.ndarray, base: float, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of g x, outputs x block; sum of h x x, outputs x block x block) over frame (y, w and x, or f and v).

    at: the coordinates' weights at the start of the round, where g and h are taken; steps: what they have moved since.
    """
    names, outputs, b = frame.columns, at.shape[1], len(block)
    y_at, w_at, rows_of, given = names.index("y"), names.index("w"), _decoder(names, n), "g" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((outputs, b, b + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = rows_of(batch)
            if given:
                g, h = (batch.column(names.index(c)).to_numpy().astype(float) for c in ("g", "h"))
            else:
                m = base + _dot(rows, at)
                g, h = o.np_gradient(m if o.outputs > 1 else m[:, 0], batch.column(y_at).to_numpy(), batch.column(w_at).to_numpy())
            g, h = g.reshape(len(rows), -1), h.reshape(len(rows), -1)
            g = g + h * _dot(rows, steps)
            if isinstance(rows, bins.Sparse):
                _add_sparse(sums, rows, block, g, h)
            else:
                _add_dense(sums, rows[:, block], g, h)
        sums[:, :, :-1] = np.triu(sums[:, :, :-1])
        flat = sums.ravel()
        found = np.flatnonzero(flat)
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"at": part, "v": flat[part]})

    got = frame.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(outputs * b * (b + 1))
    flat[got["at"].to_numpy()] = got["v"].to_numpy()
    sums = flat.reshape(outputs, b, b + 1)
    upper = sums[:, :, :-1]
    return sums[:, :, -1], upper + np.triu(upper, 1).transpose(0, 2, 1)


def step_of(g: float, h: float, w: float, alpha: float, reg: float) -> float:
    """The step of one coordinate to the least of g d + h d^2 / 2 with both penalties on w + d; none where the curvature vanishes."""
    if h < 1e-5:
        return 0.0
    return float(np_threshold(np.float64(h * w - g), alpha)) / (h + reg) - w


def sweep(g: np.ndarray, gram: np.ndarray, weights: np.ndarray, free: np.ndarray, p: TrainingParams) -> np.ndarray:
    """One output's steps through the coordinates of a block; those in `free` have no penalties."""
    g, steps = g.copy(), np.zeros(len(weights))
    for f in range(len(weights)):
        alpha, reg = (0.0, 0.0) if free[f] else (p.alpha, p.reg_lambda)
        steps[f] = p.eta * step_of(g[f], gram[f, f], weights[f], alpha, reg)
        g += gram[f] * steps[f]
    return steps


def _occurring(frame: DataFrame, n: int) -> np.ndarray:
    """The coordinates that rows have, ascending: 0 is the intercept, a feature's number is one more than its own."""
    if "f" not in frame.columns:
        return np.arange(n + 1)
    f = F.col("f")
    found = frame.select(F.explode("f").alias("f")).select(F.when(f.between(0, n - 1), f).otherwise(-1).alias("f")).distinct().toArrow()["f"].to_numpy()
    if (found < 0).any():
        raise FeatureOutOfBounds(f"a row has a feature that isn't in 0 to {n - 1}")
    return np.append(0, np.sort(found).astype(np.int64) + 1)


def _ranked(p: TrainingParams, o: Objective, frame: DataFrame, n: int, at: np.ndarray, base: float) -> DataFrame:
    """frame with g and h of a ranking objective, whose pairs need joins."""
    names, rows_of = frame.columns, _decoder(frame.columns, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = base + _dot(rows_of(batch), at)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in ("q", "place", "y", "w")], pa.array(m)], ["q", "place", "y", "w", "margin"])

    rows = frame.mapInArrow(run, "q long, place int, y double, w double, margin double").select(F.struct("q", "place").alias("at"), "q", "margin", "y", "w")
    g = lambda_gradients(rows, o.rank, "q", "at", "margin", "y", "w", max_pairs=p.max_pairs or None, seed=p.seed)
    return frame.join(g.select(F.col("at.q").alias("q"), F.col("at.place").alias("place"), "g", "h"), ["q", "place"])


def fit_linear(p: TrainingParams, o: Objective, frame: DataFrame, n: int, rounds: int, base: float, cells: int = CELLS) -> Linear:
    """Weights of n features after some rounds over frame: (row, q, y, w) and x, an array of n floats, or arrays f of features and v of their values."""
    kept = ["y", "w", *(["f", "v"] if "f" in frame.columns else ["x"])]
    if o.rank:  # rows of one id are told apart by what they hold
        frame = frame.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("row", "y", "w")))
        kept += ["q", "place"]
    frame = frame.select(*kept).persist(StorageLevel.MEMORY_AND_DISK)
    order = _occurring(frame, n)
    width = max(1, int(np.sqrt(cells / o.outputs)))
    at = np.zeros((n + 1, o.outputs))
    for _ in range(rounds):
        rows = _ranked(p, o, frame, n, at, base).persist(StorageLevel.MEMORY_AND_DISK) if o.rank else frame
        steps = np.zeros_like(at)
        for i in range(0, len(order), width):
            block = order[i : i + width]
            g, gram = block_sums(rows, o, n, at, steps, base, block)
            for k in range(o.outputs):
                steps[block, k] = sweep(g[k], gram[k], at[block, k], block == 0, p)
        at += steps
        if o.rank:
            rows.unpersist()
    frame.unpersist()
    return Linear(at[1:], at[0])
