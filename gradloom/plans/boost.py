"""Boosting: rounds of trees over a stored table of rows, or inside one task where a small table fits.

All backends run the same loop (gradients, dropout, growth, shrinkage, evaluation, early stopping) over an engine that holds the rows.
`SparkEngine` keeps the binned rows and their margins in a stored DataFrame; a backend of `plans.backends` searches the splits of a level of all trees of the round in a job, the driver
sees candidates only. `TaskEngine` holds arrays; the whole run is then one task.

Where a table has few different rows for its size, by an estimate made with the checks of its labels, equal ones are merged before anything else, with n, how many a row stands for: gradients, hessians and counts are
taken times n, so a merged table gives the same sums. Samples of rows and ranking tell rows apart and don't merge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.dataset import Dataset, SparseDataset
from gradloom.errors import DimensionMismatch, EmptyDataset, FeatureOutOfBounds, InvalidParameter
from gradloom.folders import shared_dir
from gradloom.functions import metrics as metric_functions
from gradloom.functions import objectives
from gradloom.functions.objectives import Objective
from gradloom.functions.ranking import lambda_gradients
from gradloom.model import BoostedModel
from gradloom.operators import binning, trees
from gradloom.params import TrainingParams
from gradloom.plans import bins
from gradloom.plans.backends import ArrowBackend, Backend, CatalystBackend
from gradloom.plans.growth import Growth
from gradloom.plans.kernel import MISSING, Columns, Cuts, Tree, dropped_trees, grow, make_cuts, np_lambda, np_metric, partial_histogram

BACKENDS = ("auto", "task", "arrow", "catalyst")
#: Tables of at most so many bytes of features are trained in one task, if the backend is chosen by size.
TASK_BYTES = 32 << 20
#: What one task takes if it is asked for; larger tables are left to the arrow backend, since no task may hold them.
TASK_MOST = 128 << 20
#: Equal rows are merged where there are at least so many times as many rows as different ones.
MERGE_FROM = 4
#: Rounds after which margins are stored in the checkpoint folder, to end their lineage.
STORE_EVERY = 8


@dataclass
class TrainResult:
    """history: (iteration, dataset, metric, value)."""

    model: BoostedModel
    history: list[tuple[int, str, str, float]] = field(default_factory=list)

    def history_frame(self, spark):  # noqa: ANN001, ANN201
        return spark.createDataFrame(self.history, "iteration int, dataset string, metric string, value double")


def hashed(row: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """operators.trees.row_hash for arrays."""
    v = (row.astype(np.uint64) & np.uint64(0x7FFFFFFF)) * np.uint64(2654435761) + np.uint64(seed * 40503 + turn * 9973 + 12345)
    return v & np.uint64(0xFFFFFFFF)


def sampled(row: np.ndarray, ratio: float, seed: int, turn: int, limit: int | None = None) -> np.ndarray:
    """operators.trees.keeps_row for arrays."""
    if ratio >= 1:
        return np.ones(len(row), bool)
    return hashed(row, seed, turn) < np.uint64(int(ratio * (1 << 32)) if limit is None else limit)


class TaskEngine:
    """Rows as arrays; sets[0] is trained on, scored are the numbers of the evaluated sets. Each has x, y, w, base, q, row and n, None where rows aren't merged."""

    def __init__(self, p: TrainingParams, objective: Objective, base_score: float, sets: list[dict], categorical: frozenset[int], scored: list[int]) -> None:
        self.p, self.o, self.sets, self.categorical, self.scored = p, objective, sets, categorical, scored
        for s in sets:
            m = np.full((len(s["y"]), objective.outputs), base_score)
            s["m"] = m if s["base"] is None else np.where(np.isnan(s["base"]), m, np.broadcast_to(s["base"], m.shape))
        self.cuts = None if p.method == "approx" else make_cuts(sets[0]["x"], p.max_bin, categorical, p.method == "exact", times=sets[0]["n"])
        if self.cuts is not None:
            for s in sets:
                s["b"] = self.cuts.bins(s["x"])

    def _leaf(self, s: dict, tree: Tree) -> np.ndarray:
        return np.array(tree.value)[tree.leaves(s["x"])] if self.p.method == "approx" else np.array(tree.value)[tree.advance(np.zeros(len(s["y"]), np.int64), s["b"])]

    def start(self, turn: int, dropped: list[tuple[Tree, int, float, int]]) -> None:
        s = self.sets[0]
        m = s["m"]
        if dropped:
            m = m.copy()
            for tree, k, w, _ in dropped:
                m[:, k] -= w * self._leaf(s, tree)
        if self.o.rank:
            g, h = np_lambda(self.o.rank, m[:, 0], s["y"], s["w"], s["q"], s["row"], self.p.max_pairs, self.p.seed)
        else:
            g, h = self.o.np_gradient(m if self.o.outputs > 1 else m[:, 0], s["y"], s["w"])
        times = 1.0 if s["n"] is None else s["n"][:, None]
        self.g, self.h = g.reshape(len(m), -1) * times, h.reshape(len(m), -1) * times
        self.grown: dict[int, dict[int, np.ndarray] | None] = {}
        self.live = sampled(s["row"], self.p.subsample, self.p.seed, turn)
        if not self.live.any():  # an empty sample keeps the rows of the smallest hash
            h = hashed(s["row"], self.p.seed, turn)
            self.live = h == h.min()

    def grow(self, columns: list[Columns]) -> list[Tree]:
        return [self._grow(c, k) for k, c in enumerate(columns)]

    def _grow(self, columns: Columns, k: int) -> Tree:
        s = self.sets[0]
        g, h = self.g[:, k], self.h[:, k]
        cuts, bins = self.cuts, s.get("b")
        if cuts is None:
            cuts = make_cuts(s["x"], self.p.max_bin, self.categorical, hess=h, times=s["n"])
            bins = cuts.bins(s["x"])
        parts = {0: np.flatnonzero(self.live)}  # the rows of each leaf

        def divide(tree: Tree) -> None:
            while split := [k for k in parts if tree.left[k] >= 0]:
                for k in split:
                    parts[tree.left[k]], parts[tree.right[k]] = tree.sides(k, parts.pop(k), bins)

        def histograms(tree: Tree, nodes: list[int]) -> np.ndarray:
            divide(tree)
            own = [parts[k] for k in nodes]
            return partial_histogram(bins, np.concatenate(own), np.repeat(np.arange(len(nodes)), [len(r) for r in own]), g, h, len(nodes), cuts.sizes, s["n"])

        tree = grow(self.p, cuts, columns, histograms)
        divide(tree)
        # where the rows have ended up needn't be looked for again
        self.grown[id(tree)] = parts if self.live.all() and self.p.method != "approx" else None
        return tree

    def add(self, changes: list[tuple[Tree, int, float, int]]) -> None:
        for s in self.sets:
            for tree, k, w, _ in changes:
                parts = self.grown.get(id(tree)) if s is self.sets[0] else None
                if parts is None:
                    s["m"][:, k] += w * self._leaf(s, tree)
                    continue
                for leaf, rows in parts.items():
                    s["m"][rows, k] += w * tree.value[leaf]
        self.grown.clear()

    def evaluate(self, names: list[str]) -> list[list[float]]:
        out = []
        for s in (self.sets[i] for i in self.scored):
            p = self.o.np_predict(s["m"] if self.o.outputs > 1 else s["m"][:, 0])
            out.append([np_metric(n, p, s["y"], s["w"] if s["n"] is None else s["w"] * s["n"], s["q"]) for n in names])
        return out


def rounds_of(p: TrainingParams, objective: Objective, engine, rounds: int, names: list[str], maximize: list[bool], evals: list[str], patience: int | None, n_features: int):  # noqa: ANN001, ANN201
    """The boosting loop: (trees, weights, best iteration, history)."""
    grown: list[Tree] = []
    weights: list[float] = []
    history: list[tuple[int, str, str, float]] = []
    best, best_at, stopped = None, 0, None
    for turn in range(rounds):
        dropped = dropped_trees(p, turn, len(grown)) if p.booster == "dart" else []
        out = objective.outputs
        engine.start(turn, [(grown[t], t % out, weights[t], t) for t in dropped])
        new = engine.grow([Columns(p, n_features, turn, k) for k in range(out)])
        for tree in new:
            tree.value = [v * p.eta for v in tree.value]
        share = 1.0 / (len(dropped) + 1)
        changes = []
        for t in dropped:
            changes.append((grown[t], t % out, weights[t] * (len(dropped) * share - 1), t))
            weights[t] *= len(dropped) * share
        changes += [(tree, k, share if p.booster == "dart" else 1.0, len(grown) + k) for k, tree in enumerate(new)]
        engine.add(changes)
        grown += new
        weights += [share if p.booster == "dart" else 1.0] * out
        if evals:
            for e, values in zip(evals, engine.evaluate(names), strict=True):
                history += [(turn, e, n.partition("@")[0], v) for n, v in zip(names, values, strict=True)]
            if patience:
                v, up = history[-1][3], maximize[-1]
                if best is None or (v > best if up else v < best):
                    best, best_at = v, turn
                elif turn - best_at >= patience:
                    stopped = best_at
                    break
    return grown, weights, stopped, history


def _prepared(p: TrainingParams, sets: list[Dataset], outputs: int) -> DataFrame:
    """(set, row, y, w, base, q, x) of all sets, one after another."""
    out = None
    for i, d in enumerate(sets):
        if d.label is None:
            raise InvalidParameter("training and evaluation need labels")
        if len(d.features) != len(sets[0].features) or isinstance(d, SparseDataset) != isinstance(sets[0], SparseDataset):
            raise DimensionMismatch("all datasets must have the same features")
        w = F.lit(1.0) if d.weight is None else F.coalesce(F.col(d.weight).cast("double"), F.lit(1.0))
        base = F.lit(None) if d.base_margin is None else F.col(d.base_margin) if isinstance(d.frame.schema[d.base_margin].dataType, T.ArrayType) else F.when(F.col(d.base_margin).isNotNull(), F.array(d.base_margin))
        q = F.lit(0) if d.qid is None else F.col(d.qid)
        if isinstance(d, SparseDataset):
            x = [F.col(d.indices).cast("array<int>").alias("f"), F.col(d.values).cast("array<float>").alias("v")]
        else:
            x = [F.array(*[F.when(~F.isnan(F.col(f)), F.col(f)).cast("float") for f in d.features]).alias("x")]
        one = d.frame.select(F.lit(i).alias("set"), F.col(d.row_id).cast("long").alias("row"), F.col(d.label).cast("double").alias("y"), w.alias("w"), base.cast("array<double>").alias("base"), q.cast("long").alias("q"), *x)
        out = one if out is None else out.unionByName(one)
    return out


def _merged(frame: DataFrame, which: list[int], n: int) -> DataFrame:
    """frame with the equal rows of the sets `which` as one, and n, how many rows a row stands for. Their rows keep no ids and queries of their own."""
    names, dense = frame.columns, "x" in frame.columns
    if dense:
        frame = frame.select("*", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(n)]).drop("x")
    keys = [c for c in frame.columns if c not in ("row", "q")]
    own = F.col("set").isin(which)
    out = frame.where(own).groupBy(*keys).agg(F.min("row").alias("row"), F.min("q").alias("q"), F.count("*").alias("n"))
    out = out.unionByName(frame.where(~own).withColumn("n", F.lit(1).cast("long")))
    if dense:
        out = out.withColumn("x", F.array(*[f"x{k}" for k in range(n)]))
    return out.select(*names, "n")


def _floats(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _base(lists: pa.Array, outputs: int) -> np.ndarray | None:
    if lists.null_count == len(lists):
        return None
    out = np.full((len(lists), outputs), np.nan)
    for i, v in enumerate(lists.to_pylist()):
        if v is not None and len(v) in (1, outputs):
            out[i] = v
    return out


class SparkEngine:
    """Rows as a stored DataFrame (set, row, y, w, q, m, the features, l, n): m is the array of margins, l (dart only) each row's leaf in every tree so far, so that dropping trees is a lookup, n (merged rows only) how many rows a row stands for.

    The features are packed bins (b), for sparse data arrays of features and bins (f, v), for the approximate method raw values (b), and for Catalyst's backend an array (x) of bins, or for the exact method of values.
    """

    def __init__(self, p: TrainingParams, objective: Objective, base_score: float, frame: DataFrame, n_features: int, categorical: frozenset[int], names: list, scored: list[int], backend: str = "arrow") -> None:
        self.p, self.o, self.n, self.categorical, self.scored, self.metrics = p, objective, n_features, categorical, scored, names
        self.spark, self.sparse = frame.sparkSession, "f" in frame.columns
        self.exact, self.approx, self.merged = p.method == "exact", p.method == "approx", "n" in frame.columns
        self.catalyst = (backend == "catalyst" or self.exact) and not self.sparse
        if self.exact and self.sparse:
            raise InvalidParameter("sparse data is trained by histograms; use hist or approx")
        self.backend: Backend = CatalystBackend(self) if self.catalyst else ArrowBackend(self)
        m = F.when(F.size("base") == objective.outputs, F.col("base")).when(F.size("base") == 1, F.array_repeat(F.col("base")[0], objective.outputs))
        frame = frame.withColumn("m", F.coalesce(m, F.array_repeat(F.lit(base_score), objective.outputs))).drop("base")
        if p.booster == "dart":
            frame = frame.withColumn("l", F.array().cast("array<int>"))
        if self.sparse:
            frame = self._sparse_cells(frame)
        if objective.rank:  # rows of one id are told apart by what they hold
            frame = frame.withColumn("place", F.row_number().over(Window.partitionBy("set", "q").orderBy("row", "y", "w")))
        self.cuts = None
        if self.exact:
            self.cuts = Cuts([np.zeros(1, np.float32)] * n_features, categorical, True)
            self.ranges = self._value_ranges(frame)
        elif not self.approx:
            self.cuts = self._cut(self._cells(frame.where("set = 0")), None)
            frame = self._binned(frame, self.cuts, "b")
        elif not self.sparse and not self.catalyst:
            frame = self._binned(frame, None, "b")
        self.kind = self._kind(self.cuts)
        # histograms are a task's sums, so as many tasks as there are cores, each over all its rows
        self.frame = frame.coalesce(self.spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        self.turns, self.limit = 0, None

    def _kind(self, cuts: Cuts | None) -> str:
        """The numbers of packed features."""
        return "float32" if cuts is None else "int16" if cuts.sizes.max(initial=1) < 1 << 15 else "int32"

    def _cells(self, frame: DataFrame, *more: str) -> DataFrame:
        more += ("n",) if self.merged else ()
        if self.sparse:
            return frame.select(F.inline(F.arrays_zip(F.col("f").alias("feature"), F.col("v").alias("value"))), *more)
        return frame.select(F.posexplode("x").alias("feature", "value"), *more).where(F.col("value").isNotNull())

    def _sparse_cells(self, frame: DataFrame) -> DataFrame:
        """f and v sorted by feature, without repeated features and NaN."""
        names, n = frame.columns, self.n
        f, v = names.index("f"), names.index("v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                off, features = bins.flat(batch.column(f))
                if len(features) and not (0 <= features.min() and features.max() < n):
                    raise FeatureOutOfBounds("a cell's feature is beyond the last feature")
                off, features, values = bins.deduplicated(off, features, bins.flat(batch.column(v))[1].astype(np.float32), n)
                own = {f: pa.array(features.astype(np.int32)), v: pa.array(values)}
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), own[i]) if i in own else c for i, c in enumerate(batch.columns)], names)

        return frame.mapInArrow(run, frame.schema)

    def _cut(self, cells: DataFrame, hess: str | None) -> Cuts:
        counts = binning.value_counts(cells, hess, "n" if self.merged else None)
        cat = sorted(self.categorical)
        is_cat = F.col("feature").isin(cat) if cat else F.lit(False)
        cuts = binning.quantile_cuts(counts.where(~is_cat), self.p.max_bin, hess is not None)
        if cat:
            cuts = cuts.union(binning.categorical_cuts(counts.where(is_cat)))
        return Cuts(binning.collect_cuts(cuts, self.n), self.categorical)

    def _value_ranges(self, frame: DataFrame) -> DataFrame:
        """(feature, bounds) of ranges of about equally many distinct values, kept for all rounds, so that no task of the exact method sorts a whole feature."""
        distinct = self._cells(frame.where("set = 0")).select("feature", "value").distinct()
        grid = F.array(*[F.lit(i / trees.RANGES) for i in range(1, trees.RANGES)])
        got = distinct.groupBy("feature").agg(F.percentile_approx("value", grid, F.lit(2000)).alias("bounds"))
        return self.spark.createDataFrame(got.collect(), got.schema)

    def _binned(self, frame: DataFrame, cuts: Cuts | None, to: str) -> DataFrame:
        """frame with its features x packed into column `to`, as bins or without cuts as values; for sparse data v becomes bins; for Catalyst's backend x does."""
        names, n, sparse, catalyst, kind = frame.columns, self.n, self.sparse, self.catalyst, self._kind(cuts)
        own = "v" if sparse else "x"
        x, f, name = names.index(own), names.index("f") if sparse else 0, own if sparse or catalyst else to
        fields = [q for q in frame.schema.fields if q.name != own]
        keep = [names.index(q.name) for q in fields]
        out = T.ArrayType(T.IntegerType()) if sparse or catalyst else T.BinaryType()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if sparse:
                    off, values = bins.flat(batch.column(x))
                    new = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(bins.sparse_bins(bins.flat(batch.column(f))[1], values, cuts)))
                else:
                    rows = _floats(batch.column(x), n)
                    rows = rows if cuts is None else cuts.bins(rows)
                    if catalyst:
                        new = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), pa.array(rows.ravel().astype(np.int32), mask=rows.ravel() == MISSING))
                    else:
                        new = bins.packed(rows.astype(kind))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], new], [*[names[i] for i in keep], name])

        return frame.mapInArrow(run, T.StructType([*fields, T.StructField(name, out)]))

    # what backends ask for

    def round_cuts(self, k: int = 0) -> Cuts:
        return self.own_cuts if self.approx else self.cuts

    def outputs_of(self, n: int) -> list[int]:
        """The output of each of the growing trees."""
        return self.growing

    def source(self) -> DataFrame:
        """The rows to learn from: features, row, y, w, m, l, n and, where they are stored, g and h."""
        own = self.stored if self.stored is not None else self.frame.where("set = 0")
        return own.select(*[c for c in ("f", "v", "b", "row", "y", "w", "m", "l", "n", "g", "h") if c in own.columns])

    def decoder(self, names: list[str] | None = None, raw: bool = False):  # noqa: ANN201
        """From a batch to its features: bins, or raw values."""
        names = names or self.source().columns
        n, kind, sparse, catalyst, exact = self.n, self._kind(None if raw else self.round_cuts()), self.sparse, self.catalyst, self.exact
        at = {c: names.index(c) for c in ("f", "v", "b", "x") if c in names}

        def rows(batch: pa.RecordBatch) -> np.ndarray | bins.Sparse:
            if sparse:
                off, features = bins.flat(batch.column(at["f"]))
                return bins.Sparse(off, features, bins.flat(batch.column(at["v"]))[1], n, np.nan if raw else MISSING)
            if catalyst:
                values = batch.column(at["x"]).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                return values.astype(np.float32) if exact or raw else np.nan_to_num(values, nan=MISSING).astype(np.int64)
            return bins.unpacked(batch.column(at["b"]), np.dtype(kind), n)

        return rows

    def gradients(self):  # noqa: ANN201
        """From a batch to the (g, h) of each output, of all rows that a row stands for."""
        names, o, dropped = self.source().columns, self.o, self.dropped
        at = {c: names.index(c) for c in names}

        def of(batch: pa.RecordBatch, _: object):  # noqa: ANN202
            number = lambda c: batch.column(at[c]).to_numpy(zero_copy_only=False).astype(float)
            if "g" in at:
                g, h = number("g")[:, None], number("h")[:, None]
                return lambda k: (g[:, 0], h[:, 0])
            y, w = number("y"), number("w")
            m = _margins(batch.column(at["m"]), o.outputs)
            if dropped:
                leaf = bins.flat(batch.column(at["l"]))[1].reshape(len(y), -1)
                for tree, k, weight, t in dropped:
                    m[:, k] -= weight * np.array(tree.value)[leaf[:, t]]
            g, h = o.np_gradient(m if o.outputs > 1 else m[:, 0], y, w)
            times = number("n")[:, None] if "n" in at else 1.0
            g, h = g.reshape(len(y), -1) * times, h.reshape(len(y), -1) * times
            return lambda k: (g[:, k], h[:, k])

        return of

    def counts(self):  # noqa: ANN201
        """From a batch to how many rows each of its rows stands for; None: one."""
        at = self.source().columns.index("n") if self.merged else None
        return lambda batch: None if at is None else batch.column(at).to_numpy(zero_copy_only=False).astype(float)

    def sampler(self):  # noqa: ANN201
        """From a batch to which of its rows are in the round's sample."""
        p, turn, limit, at = self.p, self.turn, self.limit, self.source().columns.index("row")
        return lambda batch: sampled(batch.column(at).to_numpy(zero_copy_only=False), p.subsample, p.seed, turn, limit)

    def frame_of(self, k: int) -> DataFrame:
        """For Catalyst's backend: (x, g, h) of the rows in the round's sample."""
        own = self.stored if self.stored is not None else self.frame.where("set = 0")
        own = self._graded(own, self.growing[k])
        return own.where(trees.keeps_row(F.col("row"), self.p.subsample, self.p.seed, self.turn, self.limit)).select("x", F.col("g").cast("double").alias("g"), F.col("h").cast("double").alias("h"))

    # a round

    def start(self, turn: int, dropped: list[tuple[Tree, int, float, int]]) -> None:
        self.turn, self.dropped, self.limit, self.stored = turn, dropped, None, None
        if self.o.rank:  # pairs within queries need joins: their gradients are stored once for the round
            own = self.frame.where("set = 0")
            rows = self._moved(own, [(t, k, -w, at) for t, k, w, at in dropped]).select(F.struct("q", "place").alias("at"), "q", F.col("m")[0].alias("margin"), "y", "w")
            g = lambda_gradients(rows, self.o.rank, "q", "at", "margin", "y", "w", max_pairs=self.p.max_pairs or None, seed=self.p.seed)
            g = g.select(F.col("at.q").alias("q"), F.col("at.place").alias("place"), "g", "h")
            self.stored = own.join(g, ["q", "place"]).persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self, columns: list[Columns]) -> list[Tree]:
        """A tree of each output, all grown in the same jobs, except by the approximate method, whose cuts are each tree's own."""
        if not self.approx:
            return self._grow(columns, list(range(len(columns))))
        out = []
        for k, c in enumerate(columns):
            given = self.stored
            own = self._graded(given if given is not None else self.frame.where("set = 0"), k)
            self.own_cuts = self._cut(self._approx_cells(own), "h")
            self.stored = self._approx_binned(own).persist(StorageLevel.MEMORY_AND_DISK)
            out += self._grow([c], [k])
            self.stored.unpersist()
            self.stored = given
        return out

    def _approx_cells(self, frame: DataFrame) -> DataFrame:
        return self._cells(self._unpacked(frame), "h")

    def _unpacked(self, frame: DataFrame) -> DataFrame:
        """frame with x, the array of values, in place of their packed form."""
        if self.sparse or self.catalyst:
            return frame
        names, rows, n = frame.columns, self.decoder(frame.columns, raw=True), self.n
        at = names.index("b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.ascontiguousarray(rows(batch)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(x, mask=np.isnan(x)))
                yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], ["x" if c == "b" else c for c in names])

        return frame.mapInArrow(run, T.StructType([T.StructField("x", T.ArrayType(T.FloatType())) if q.name == "b" else q for q in frame.schema.fields]))

    def _approx_binned(self, frame: DataFrame) -> DataFrame:
        return self._binned(self._unpacked(frame), self.own_cuts, "b")

    def _grow(self, columns: list[Columns], outputs: list[int]) -> list[Tree]:
        self.growing = outputs
        growths = [Growth(self.p, c, self.n) for c in columns]
        while any(g.asked for g in growths):
            found = self.backend.best(growths)
            if self.p.subsample < 1 and self.limit is None and any(root is not None and not root[2] for root, _ in found):
                # an empty sample keeps the rows of the smallest hash
                least = self.frame.where("set = 0").agg(F.min(trees.row_hash(F.col("row"), self.p.seed, self.turn))).collect()[0][0]
                self.limit = least + 1
                continue
            for g, (root, splits) in zip(growths, found, strict=True):
                if root is not None:
                    g.start(root[0], root[1])
                if g.asked:
                    g.answer(splits)
        return [g.tree() for g in growths]

    def _graded(self, frame: DataFrame, k: int) -> DataFrame:
        """frame with g and h of output k."""
        if "g" in frame.columns:
            return frame
        moved = self._moved(frame, [(t, j, -w, at) for t, j, w, at in self.dropped])
        g, h = self.o.gradient(F.col("m") if self.o.outputs > 1 else F.col("m")[0], F.col("y"), F.col("w"))
        times = lambda c: c * F.col("n").cast("double") if self.merged else c
        return moved.withColumn("g", times(g[k] if self.o.outputs > 1 else g)).withColumn("h", times(h[k] if self.o.outputs > 1 else h))

    def _moved(self, frame: DataFrame, changes: list[tuple[Tree, int, float, int]]) -> DataFrame:
        """frame with weighted leaves of trees added to m, and the leaves of new trees to l. A tree whose leaves are stored isn't walked."""
        if not changes:
            return frame
        names = frame.columns
        m, outputs, raw = names.index("m"), self.o.outputs, self.approx or self.exact
        rows_of, leaves_at = self.decoder(names, raw), names.index("l") if "l" in names else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(batch.columns)
                v = _margins(batch.column(m), outputs)
                rows = None
                leaf = None if leaves_at is None else bins.flat(batch.column(leaves_at))[1].reshape(len(v), -1) if len(v) else np.zeros((0, 0), np.int32)
                for tree, k, w, t in changes:
                    if leaf is not None and t < leaf.shape[1]:
                        at = leaf[:, t]
                    else:
                        rows = rows_of(batch) if rows is None else rows
                        at = tree.leaves(rows) if raw else tree.advance(np.zeros(len(v), np.int64), rows)
                        if leaf is not None:
                            leaf = np.concatenate([leaf, at[:, None].astype(np.int32)], 1)
                    v[:, k] += w * np.array(tree.value)[at]
                columns[m] = _lists(v)
                if leaf is not None:
                    columns[leaves_at] = _lists(leaf.astype(np.int32))
                yield pa.RecordBatch.from_arrays(columns, names)

        return frame.mapInArrow(run, frame.schema)

    def add(self, changes: list[tuple[Tree, int, float, int]]) -> None:
        old = self.frame
        new = self._moved(old, changes)
        self.turns += 1
        if self.turns % STORE_EVERY == 0:
            shared_dir(self.spark)
            new = new.checkpoint(eager=True)
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        self.frame = new
        old.unpersist()
        if self.stored is not None:
            self.stored.unpersist()

    def evaluate(self, names: list[str]) -> list[list[float]]:
        out = []
        for i in self.scored:
            m = F.col("m") if self.o.outputs > 1 else F.col("m")[0]
            w = F.col("w") * F.col("n") if self.merged else F.col("w")
            rows = self.frame.where(F.col("set") == i).select(self.o.predict(m).alias("p"), "y", w.alias("w"), "q", "row")
            out.append([metric.value(rows, "p", "y", "w", "q", "row") for metric in self.metrics])
        return out


def _margins(lists: pa.Array, outputs: int) -> np.ndarray:
    return bins.flat(lists)[1].reshape(-1, outputs).copy()


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _collected(batches: Iterator[pa.RecordBatch], n: int, outputs: int) -> list[dict]:
    table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("set", "q", "row", "y", "w")])
    out = []
    which = table["set"].to_numpy()
    for i in range(int(which.max()) + 1):
        t = table.filter(pa.array(which == i)).combine_chunks()
        one = lambda c, t=t: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        lists = one("x")
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        out.append({"x": _floats(lists, n), "base": _base(one("base"), outputs), "n": t["n"].to_numpy().astype(float) if "n" in t.column_names else None, **{c: t[c].to_numpy() for c in ("y", "w", "q", "row")}})
    return out


def train(params: TrainingParams, data: Dataset, rounds: int, evals: list[tuple[str, Dataset]] | None = None, patience: int | None = None, objective: Objective | None = None, metric: metric_functions.Metric | None = None, backend: str = "auto") -> TrainResult:
    """A model of `rounds` rounds; evals are scored after each, and training stops after `patience` rounds in which the last metric of the last one hasn't improved.

    backend: "arrow" and "catalyst" work over all executors; "task" trains a dense table in one task if it has at most TASK_MOST bytes of features once its equal rows are merged, else it is "arrow"; "auto" is "task" up to TASK_BYTES, else "arrow". All give the same trees.
    """
    p, evals = params, evals or []
    if backend not in BACKENDS:
        raise InvalidParameter(f"backend must be one of {BACKENDS}")
    o = objective or objectives.create(p)
    n = len(data.features)
    names = list(p.eval_metric) or [o.metric]
    found = [metric_functions.create(x) for x in names] if metric is None else [metric]
    names = names if metric is None else [metric.name]
    # samples of rows, pairs within queries and other metrics than means tell equal rows apart
    means = metric is None and all(x.partition("@")[0] in metric_functions.MEANS for x in names)
    # a set that is given twice, or is the training data, is kept once: its margins are the same
    sets, scored = [data], []
    for _, d in evals:
        if not means or d not in sets:
            sets.append(d)
        scored.append(sets.index(d) if means else len(sets) - 1)
    frame = _prepared(p, sets, o.outputs)
    may = [] if o.rank else [i for i in range(len(sets)) if (means if i else p.subsample >= 1)]
    checks = [F.count("*").alias("rows"), F.sum((F.col("y").isNull() | F.isnan("y")).cast("long")).alias("bad"), F.sum((F.col("set") == 0).cast("long")).alias("own"), F.min("y").alias("low"), F.max("y").alias("high")]
    own = F.when(F.col("set") == 0, F.col("w"))
    key = F.xxhash64(*[c for c in frame.columns if c not in ("set", "row", "q")])
    unlike = [x for i in may for x in (F.sum((F.col("set") == i).cast("long")).alias(f"rows{i}"), F.approx_count_distinct(F.when(F.col("set") == i, key)).alias(f"unlike{i}"))]
    s = frame.agg(*checks, F.sum(own).alias("w"), F.sum(own * F.col("y")).alias("wy"), *unlike).collect()[0]
    if not s["own"]:
        raise EmptyDataset("no rows to train on")
    if s["bad"]:
        raise InvalidParameter(f"{s['bad']} rows have no label")
    if o.outputs > 1 and (s["low"] < 0 or s["high"] >= o.outputs):
        raise InvalidParameter(f"labels must be 0 to {o.outputs - 1}")
    if o.outputs > 1 or o.rank:
        base_score = 0.0
    elif p.base_score is not None:
        base_score = o.score_margin(p.base_score)
    else:
        base_score = o.base_margin(s["wy"] / s["w"] if s["w"] and s["w"] > 0 else 0.0)
    model = BoostedModel(p, o, n, base_score)
    if p.booster == "gblinear":
        from gradloom.plans.linear import fit_linear

        model.linear = fit_linear(p, o, frame.where("set = 0"), n, rounds, base_score)
        return TrainResult(model)
    dense = not isinstance(data, SparseDataset)
    if backend == "task" and (metric is not None or not dense):
        raise InvalidParameter("a task trains dense tables with named metrics")
    merge = [i for i in may if MERGE_FROM * s[f"unlike{i}"] <= s[f"rows{i}"] and s[f"rows{i}"]]
    if merge:
        frame = _merged(frame, merge, n)
    size = (s["rows"] - sum(s[f"rows{i}"] - s[f"unlike{i}"] for i in merge)) * (n + 6) * 8
    small = size <= {"task": TASK_MOST, "auto": TASK_BYTES}.get(backend, -1) and dense and metric is None
    args = (rounds, names, [m.maximize for m in found], [e for e, _ in evals], patience, n)
    categorical = data.categorical
    if small:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = TaskEngine(p, o, base_score, _collected(batches, n, o.outputs), categorical, scored)
            trees, weights, stopped, history = rounds_of(p, o, engine, *args)
            fields = [{k: [v.item() if isinstance(v, np.generic) else v for v in getattr(t, k)] for k in t.__dataclass_fields__} for t in trees]
            yield pa.RecordBatch.from_pydict({"out": [json.dumps([fields, weights, stopped, history])]})

        # merged rows are summed in many tasks and only then brought together
        got = json.loads((frame.repartition(1) if merge else frame.coalesce(1)).mapInArrow(run, "out string").collect()[0][0])
        model.trees, model.weights, model.best_iteration = [Tree(**t) for t in got[0]], got[1], got[2]
        return TrainResult(model, [tuple(h) for h in got[3]])
    if merge:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)  # it is read for the cuts and again for the bins
    engine = SparkEngine(p, o, base_score, frame, n, categorical, found, scored, backend)
    model.trees, model.weights, model.best_iteration, history = rounds_of(p, o, engine, *args)
    engine.frame.unpersist()
    if merge:
        frame.unpersist()
    return TrainResult(model, history)
