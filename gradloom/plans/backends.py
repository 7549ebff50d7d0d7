"""Backends that search the best splits of leaves over a stored table of rows.

A backend is made of an engine and has `best(growths)`: for each growth, which is a tree of one output, the sums of its root where that is asked for and the best split of
each asked leaf. All trees of a round that grow at the same time are searched in the same jobs.

`ArrowBackend`: tasks route their rows through the half-grown trees and add up histograms in numpy; the parts are shuffled by block of features; the task of a block sums them and searches the leaves' splits in
it. A few rows a leaf and block reach the driver: the candidates that can be best, whatever the other blocks have. Dense rows whose leaves' histograms would be too large for a task are searched in several jobs.

`CatalystBackend`: rows carry their leaf; cells, histograms, candidates and best splits are those of `operators.trees`, so Spark's own aggregation, windows and joins do the work. It is the one that has the exact method, over any number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.operators import trees
from gradloom.plans.bins import Sums
from gradloom.plans.growth import Growth
from gradloom.plans.kernel import Cuts, Searcher, Split, pick

#: Cells (leaves x bins) of the dense histogram in a task, and about how many a block of features has.
TASK_CELLS = 1 << 22
BLOCK_CELLS = 1 << 18

Found = list[tuple[tuple[float, float, float] | None, list[Split]]]


class Backend(Protocol):
    def best(self, growths: list[Growth]) -> Found:
        """For each growth ((g, h, rows) of the root if that is asked for, the best split of each of its asked leaves)."""


def blocks_of(sizes: np.ndarray, slots: int) -> np.ndarray:
    """Where blocks of features begin, and the end: each has about BLOCK_CELLS cells, or is one feature."""
    upto = np.cumsum(sizes) * slots
    return np.append(np.unique(np.searchsorted(upto, np.arange(0, upto[-1], BLOCK_CELLS), "right")), len(sizes))


_RECORD = "slot int, numeric boolean, feature int, gain double, bin int, threshold double, default_left boolean, gl double, hl double, gr double, hr double, categories array<int>, left_bins array<int>"


class ArrowBackend:
    def __init__(self, engine) -> None:  # noqa: ANN001
        self.engine = engine

    def best(self, growths: list[Growth]) -> Found:
        e = self.engine
        asked = [(k, leaf) for k, g in enumerate(growths) for leaf in g.asked]
        width = int(e.round_cuts().sizes.sum())
        step = len(asked) if e.sparse else max(1, TASK_CELLS // (width + 1))
        splits: list[Split] = []
        totals: dict[int, tuple[float, float, float]] = {}
        for at in range(0, len(asked), step):
            part, sums = self._search(growths, asked[at : at + step])
            splits += part
            totals |= {at + slot: t for slot, t in sums.items()}
        out, n = [], 0
        for g in growths:
            own = slice(n, n + len(g.asked))
            root = totals.get(n, (0.0, 0.0, 0.0)) if g.asked and g.asked[0] is g.root else None
            out.append((root, splits[own]))
            n += len(g.asked)
        return out

    def _search(self, growths: list[Growth], asked: list[tuple[int, object]]) -> tuple[list[Split], dict[int, tuple[float, float, float]]]:
        e, slots = self.engine, len(asked)
        shadows, outputs = [g.shadow for g in growths], e.outputs_of(len(growths))
        slot_of = [np.full(len(t), -1) for t in shadows]
        for s, (k, leaf) in enumerate(asked):
            slot_of[k][leaf.id] = s
        wanted = sorted({k for k, _ in asked})
        cuts = {k: e.round_cuts(k) for k in wanted}
        sizes = cuts[wanted[0]].sizes  # approx searches one tree at a time, all others share their cuts
        first = blocks_of(sizes, slots)
        base = np.append(0, np.cumsum(sizes))
        width, n, p = int(base[-1]), len(sizes), e.p
        dense = not e.sparse or slots * width <= TASK_CELLS
        masks = [growths[k].mask(leaf) for k, leaf in asked]
        masks = None if all(m is None for m in masks) else np.stack([np.ones(n, bool) if m is None else m for m in masks])
        low, high = np.array([leaf.low for _, leaf in asked]), np.array([leaf.high for _, leaf in asked])
        bounded = bool(growths[0].ways)
        decode, gradients, live_rows, counts = e.decoder(), e.gradients(), e.sampler(), e.counts()

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(slots, sizes, dense)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, live = decode(batch), live_rows(batch)
                grads, times = gradients(batch, bins), counts(batch)
                for k in wanted:
                    at = slot_of[k][shadows[k].advance(np.zeros(batch.num_rows, np.int64), bins)]
                    own = np.flatnonzero(live & (at >= 0))
                    g, h = grads(outputs[k])
                    sums.add(bins, own, at[own], g, h, times)
            at, values = sums.cells()
            if not sums.rows:
                return
            slot, bin_ = np.divmod(at, width)
            block = np.searchsorted(base[first], bin_, "right") - 1
            order = np.argsort(block, kind="stable")
            bounds = np.searchsorted(block[order], np.arange(len(first)))
            for b in range(len(first) - 1):
                own = order[bounds[b] : bounds[b + 1]]
                size = base[first[b + 1]] - base[first[b]]
                local = slot[own] * (size + 1) + bin_[own] - base[first[b]]
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "at": pa.array([local.astype(np.int64).tobytes()], pa.binary()), "sums": pa.array([values[:, own].tobytes()], pa.binary()), "total": pa.array([sums.total.tobytes()], pa.binary())})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, at, values, total in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    size = int(base[first[block + 1]] - base[first[block]])
                    own = held.setdefault(block, np.zeros((3, slots * (size + 1))))
                    at = np.frombuffer(at, np.int64)
                    own[:, at] += np.frombuffer(values, float).reshape(3, -1)
                    own[:, np.arange(slots) * (size + 1) + size] += np.frombuffer(total, float).reshape(slots, 3).T
            for block, own in sorted(held.items()):
                f0, f1 = int(first[block]), int(first[block + 1])
                hists = np.ascontiguousarray(own.reshape(3, slots, -1).transpose(1, 0, 2))
                rows: list[tuple] = [(s, True, -1, 0.0, 0, 0.0, False, *hists[s, :2, -1].tolist(), hists[s, 2, -1], 0.0, None, None) for s in range(slots)] if block == 0 else []
                for k in wanted:
                    mine = [s for s, (j, _) in enumerate(asked_of) if j == k]
                    part = Cuts(cuts[k].cuts[f0:f1], frozenset(f - f0 for f in cuts[k].categorical if f0 <= f < f1), cuts[k].exact)
                    searcher = Searcher(part, p.with_(monotone_constraints=tuple(p.monotone_constraints[f0:f1])))
                    searcher.bounded = bounded
                    allowed = np.ones((len(mine), f1 - f0), bool) if masks is None else masks[mine, f0:f1]
                    for s, found in zip(mine, searcher.records(hists[mine], allowed, low[mine], high[mine]), strict=True):
                        rows += [(s, c.categories is None, c.feature + f0, c.gain, c.bin, c.threshold, c.default_left, *map(float, c.left), *map(float, c.right), c.categories, c.left_bins) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)

        asked_of = [(k, None) for k, _ in asked]
        parts = e.source().mapInArrow(histograms, "block int, at binary, sums binary, total binary")
        got = parts.repartitionById(len(first) - 1, F.col("block")).mapInArrow(search, _RECORD).collect()
        splits, totals = [Split() for _ in asked], {}
        # numeric candidates by feature and bin, then categorical ones by feature: the order of one search over all features
        for r in sorted(enumerate(got), key=lambda r: (r[1]["slot"], not r[1]["numeric"], r[1]["feature"], r[0])):
            r = r[1]  # noqa: PLW2901
            if r["feature"] < 0:
                totals[r["slot"]] = (r["gl"], r["hl"], r["gr"])
            else:
                s = Split(r["gain"], r["feature"], r["bin"], r["threshold"], r["default_left"], r["categories"], r["left_bins"], (r["gl"], r["hl"]), (r["gr"], r["hr"]))
                splits[r["slot"]] = pick([s], splits[r["slot"]])
        return splits, totals


_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_TYPES = [{"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in _RECORD.split(", ")]


class CatalystBackend:
    """engine.frame_of(k) has (node-free) rows with g, h and x, the array of bins, or for the exact method of values; null where missing."""

    def __init__(self, engine) -> None:  # noqa: ANN001
        self.engine = engine

    def best(self, growths: list[Growth]) -> Found:
        return [self._of(k, g) if g.asked else (None, []) for k, g in enumerate(growths)]

    def _of(self, k: int, growth: Growth) -> tuple[tuple[float, float, float] | None, list[Split]]:
        e, p = self.engine, self.engine.p
        spark, cuts = e.spark, e.round_cuts(k)
        exact, cat = cuts.exact, sorted(cuts.categorical)
        rows = self._placed(e.frame_of(k), growth, exact)
        bounds = spark.createDataFrame([(leaf.id, leaf.low, leaf.high) for leaf in growth.asked], "node int, low double, high double")
        rows = rows.join(F.broadcast(bounds), "node")
        totals = rows.groupBy("node").agg(F.sum("g").alias("gt"), F.sum("h").alias("ht"), F.count("*").alias("rows"), F.first("low").alias("low"), F.first("high").alias("high"))
        root = None
        if growth.asked[0] is growth.root:
            got = totals.select("gt", "ht", "rows").collect()
            root = (got[0]["gt"], got[0]["ht"], float(got[0]["rows"])) if got else (0.0, 0.0, 0.0)
        cells = rows.select("node", "g", "h", F.posexplode("x").alias("feature", "value")).where(F.col("value").isNotNull())
        masks = {leaf.id: growth.mask(leaf) for leaf in growth.asked}
        if any(m is not None for m in masks.values()):
            pairs = [(node, int(f)) for node, m in masks.items() if m is not None for f in np.flatnonzero(m)]
            cells = cells.join(F.broadcast(spark.createDataFrame(pairs, "node int, feature int")), ["node", "feature"], "left_semi")
        numeric = cells.where(~F.col("feature").isin(cat)) if cat else cells
        way = F.lit(0)
        for f, w in growth.ways.items():
            way = F.when(F.col("feature") == f, w).otherwise(way)
        limits = (F.col("low"), F.col("high")) if growth.ways else (None, None)
        totals = totals.drop("rows")
        if exact:
            at = "threshold"
            candidates = trees.exact_splits(trees.value_stats(numeric), totals, p, *limits, way, e.ranges)
        else:
            at = "bin"
            candidates = trees.numeric_splits(trees.histogram(numeric.withColumnRenamed("value", "bin"), "node"), totals, p, *limits, way)
        good = p.with_(gamma=0.0)  # growth compares with gamma itself
        best = {r["node"]: r for r in trees.best_splits(candidates, good, at).select("node", "feature", at, "default_left", "gain", "gl", "hl", "gr", "hr").collect()}
        sets: dict[int, list] = {}
        if cat:
            hist = trees.histogram(cells.where(F.col("feature").isin(cat)).withColumnRenamed("value", "bin"), "node")
            found = trees.categorical_splits(hist, totals, p, *limits)
            for f in cat:  # each feature's best candidate, then the features in order
                for r in trees.best_splits(found.where(F.col("feature") == f), good, "place").select("node", "feature", "left_set", "gain", "gl", "hl", "gr", "hr").collect():
                    sets.setdefault(r["node"], []).append(r)
        out = []
        for leaf in growth.asked:
            s = Split()
            if r := best.get(leaf.id):
                threshold = float(r["threshold"]) if exact else float(cuts.cuts[r["feature"]][r["bin"]])
                s = Split(r["gain"], r["feature"], 0 if exact else r["bin"], threshold, r["default_left"], None, None, (r["gl"], r["hl"]), (r["gr"], r["hr"]))
            for r in sets.get(leaf.id, []):
                left = list(r["left_set"])
                values = [int(v) for v in left] if exact else [int(cuts.cuts[r["feature"]][b]) for b in left]
                s = pick([Split(r["gain"], r["feature"], 0, 0.0, False, [max(0, v) for v in values], [int(b) for b in left], (r["gl"], r["hl"]), (r["gr"], r["hr"]))], s)
            out.append(s)
        return root, out

    def _placed(self, rows: DataFrame, growth: Growth, exact: bool) -> DataFrame:
        """rows with node, the leaf of the shadow tree: a join with the splits of each depth, all of one form however large the tree."""
        t = growth.shadow
        rows = rows.withColumn("node", F.lit(0))
        depth = {0: 0}
        levels: list[list[tuple]] = []
        for node in range(len(t)):
            if t.left[node] >= 0:
                d = depth[node]
                depth[t.left[node]] = depth[t.right[node]] = d + 1
                if len(levels) <= d:
                    levels.append([])
                levels[d].append((node, t.feature[node], float(np.float32(t.threshold[node])) if exact else float(t.bin[node]), t.default_left[node], t.left_bins[node], t.left[node], t.right[node]))
        for level in levels:
            splits = self.engine.spark.createDataFrame(level, "node int, _f int, _at double, _default boolean, _set array<int>, _left int, _right int")
            met = rows.join(F.broadcast(splits), "node", "left")
            value = F.get("x", F.col("_f")).cast("double")
            left = F.when(value.isNull(), F.col("_default")).when(F.col("_set").isNotNull(), F.array_contains("_set", value.cast("int"))).otherwise(value < F.col("_at") if exact else value <= F.col("_at"))
            rows = met.withColumn("node", F.when(F.col("_f").isNull(), F.col("node")).when(left, F.col("_left")).otherwise(F.col("_right"))).drop("_f", "_at", "_default", "_set", "_left", "_right")
        return rows
