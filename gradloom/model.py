"""A trained model: prediction, leaf ids, importance, storage."""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.dataset import Dataset, SparseDataset
from gradloom.errors import DimensionMismatch, ModelFormatError, UnknownName
from gradloom.functions import objectives
from gradloom.functions.objectives import Objective
from gradloom.params import TrainingParams
from gradloom.plans import bins
from gradloom.plans.kernel import Tree

NODE_SCHEMA = "tree_id int, output int, node_id int, split_feature int, split_cond float, default_left boolean, left int, right int, leaf_value double, sum_hess double, split_gain double, is_categorical boolean, categories array<int>, weight double"
#: Trees of a model that a CASE expression may hold; beyond, prediction walks arrays.
CASE_TREES = 8


def _is_array(data: Dataset | SparseDataset) -> bool:
    return isinstance(data.frame.schema[data.base_margin].dataType, T.ArrayType)


def _cell(data: Dataset | SparseDataset, f: int) -> Column:
    """Feature f of a row, null where it is missing; of a sparse row's repeated cells the first."""
    if isinstance(data, Dataset):
        return F.col(data.features[f])
    kind = data.frame.schema[data.indices].dataType.elementType
    return F.get(data.values, F.array_position(data.indices, F.lit(f).cast(kind)).cast("int") - 1).cast("float")


@dataclass
class Linear:
    """weights: features x outputs; bias per output."""

    weights: np.ndarray
    bias: np.ndarray


@dataclass
class BoostedModel:
    """Trees (tree t adds to output t mod outputs) or a linear model, on top of base_score in margin space."""

    params: TrainingParams
    objective: Objective
    n_features: int
    base_score: float
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    best_iteration: int | None = None
    linear: Linear | None = None

    @property
    def outputs(self) -> int:
        return self.objective.outputs

    @property
    def rounds(self) -> int:
        return len(self.trees) // self.outputs

    def used_trees(self, limit: int | None = None) -> int:
        """Trees that prediction uses: all, those up to the best iteration, or the first `limit` (0: all)."""
        if limit is not None:
            return min(limit, len(self.trees)) if limit > 0 else len(self.trees)
        return len(self.trees) if self.best_iteration is None else min(len(self.trees), (self.best_iteration + 1) * self.outputs)

    # arrays

    def np_margin(self, x: np.ndarray, base: np.ndarray | None = None, limit: int | None = None) -> np.ndarray:
        """Margins (rows x outputs) of raw features, NaN where missing."""
        out = np.full((len(x), self.outputs), self.base_score)
        if self.linear is not None:
            if isinstance(x, bins.Sparse):
                return out + self.linear.bias + np.stack([np.bincount(x.owner, x.numbers * w[x.features], len(x)) for w in self.linear.weights.T], 1)
            return out + self.linear.bias + np.nan_to_num(x) @ self.linear.weights
        if base is not None:
            own = base.reshape(len(x), -1)
            out = np.where(np.isnan(own), out, np.broadcast_to(own, out.shape))
        for t in range(self.used_trees(limit)):
            tree = self.trees[t]
            out[:, t % self.outputs] += self.weights[t] * np.array(tree.value)[tree.leaves(x)]
        return out

    # DataFrames

    def _checked(self, data: Dataset | SparseDataset) -> Dataset | SparseDataset:
        if len(data.features) != self.n_features:
            raise DimensionMismatch(f"the model has {self.n_features} features, the data {len(data.features)}")
        return data

    def _mapped(self, data: Dataset, name: str, kind: T.DataType, row, keep: tuple[str, ...]) -> DataFrame:  # noqa: ANN001
        """keep and column `name`, which row gives from (model, features, base margins) of a batch."""
        self._checked(data)
        model = self  # goes with the function: objectives of one's own are code
        base = F.lit(None) if data.base_margin is None else F.col(data.base_margin) if _is_array(data) else F.array(data.base_margin)
        base = base.cast("array<double>")
        n, width, outputs, sparse = len(keep), self.n_features, self.outputs, isinstance(data, SparseDataset)
        schema = T.StructType([*data.frame.select(*keep).schema.fields, T.StructField(name, kind)])

        def of(t: T.DataType, got: np.ndarray) -> pa.Array:
            """got as an Arrow array; its further axes become lists."""
            if not isinstance(t, T.ArrayType):
                return pa.array(got.ravel(), {"float": pa.float32(), "int": pa.int32(), "double": pa.float64()}[t.simpleString()])
            inner = of(t.elementType, got.reshape(-1, *got.shape[2:]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), inner)

        def features(batch: pa.RecordBatch) -> np.ndarray | bins.Sparse:
            if sparse:
                off, f = bins.flat(batch.column(n))
                return bins.Sparse(*bins.deduplicated(off, f, bins.flat(batch.column(n + 1))[1].astype(np.float32), width), width, np.nan)
            return np.stack([batch.column(n + f).to_numpy(zero_copy_only=False).astype(np.float32) for f in range(width)], 1) if batch.num_rows else np.zeros((0, width), np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, b = features(batch), None
                given = batch.column(batch.num_columns - 1)
                if given.null_count < len(given):
                    b = np.full((len(given), outputs), np.nan)
                    for i, v in enumerate(given.to_pylist()):
                        if v is not None and len(v) in (1, outputs):
                            b[i] = v
                got = row(model, x, b)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], of(kind, got)], [*batch.schema.names[:n], name])

        own = [F.col(data.indices).cast("array<int>"), F.col(data.values).cast("array<float>")] if sparse else [F.col(f).cast("float") for f in data.features]
        return data.frame.select(*keep, *own, base.alias("_base")).mapInArrow(run, schema)

    def _shape(self) -> T.DataType:
        return T.FloatType() if self.outputs == 1 else T.ArrayType(T.FloatType())

    def predict_margin(self, data: Dataset, keep: tuple[str, ...] | None = None, limit: int | None = None, name: str = "margin") -> DataFrame:
        """The row id (or keep) and each row's margin: a number, or an array for several outputs."""
        keep = keep or (data.row_id,)
        if self.linear is None and self.outputs == 1 and self.used_trees(limit) <= CASE_TREES:
            return self._checked(data).frame.select(*keep, self.margin_column(data, limit).cast("float").alias(name))
        many = self.outputs > 1
        return self._mapped(data, name, self._shape(), lambda m, x, b: m.np_margin(x, b, limit) if many else m.np_margin(x, b, limit)[:, 0], keep)

    def margin_column(self, data: Dataset | SparseDataset, limit: int | None = None) -> Column:
        """The margin as one expression of nested CASEs, for few trees."""
        base = F.lit(self.base_score)
        if data.base_margin is not None:
            own = F.col(data.base_margin)
            own = (F.when(F.size(own) == 1, F.get(own, F.lit(0))) if _is_array(data) else own).cast("double")
            base = F.when(own.isNull() | F.isnan(own), base).otherwise(own)
        for t in range(self.used_trees(limit)):
            base = base + self.weights[t] * self.leaf_column(data, t, value=True)
        return base

    def leaf_column(self, data: Dataset | SparseDataset, t: int, value: bool = False) -> Column:
        """A tree's leaf id, or value, as nested CASEs."""
        from gradloom.operators.trees import goes_left, in_set

        tree = self.trees[t]

        def at(k: int) -> Column:
            if tree.left[k] < 0:
                return F.lit(float(tree.value[k])) if value else F.lit(k)
            c = _cell(data, tree.feature[k])
            left = in_set(c, tree.categories[k], bool(tree.default_left[k])) if tree.categories[k] is not None else goes_left(c.cast("float"), float(np.float32(tree.threshold[k])), bool(tree.default_left[k]))
            return F.when(left, at(tree.left[k])).otherwise(at(tree.right[k]))

        return at(0)

    def predict(self, data: Dataset, keep: tuple[str, ...] | None = None, name: str = "prediction") -> DataFrame:
        """Margins on the output scale, by the model's own objective."""
        keep = keep or (data.row_id,)
        m = self.predict_margin(data, keep, name="_margin")
        value = self.objective.predict(F.col("_margin").cast("array<double>" if self.outputs > 1 else "double"))
        return m.select(*keep, value.cast(self._shape().simpleString()).alias(name))

    def predict_class(self, data: Dataset, keep: tuple[str, ...] | None = None) -> DataFrame:
        """0 or 1 by probability over one half; of several outputs the first largest."""
        keep = keep or (data.row_id,)
        p = self.predict(data, keep, "_p")
        pick = (F.array_position("_p", F.array_max("_p")) - 1).cast("int") if self.outputs > 1 else (F.col("_p") > 0.5).cast("int")
        return p.select(*keep, pick.alias("class"))

    def predict_leaf(self, data: Dataset, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The leaf id of each row in each tree."""
        return self._mapped(data, "leaves", T.ArrayType(T.IntegerType()), lambda m, x, b: np.stack([t.leaves(x) for t in m.trees], 1).astype(np.int32), keep or (data.row_id,))

    def contributions(self, data: Dataset | SparseDataset, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Shapley contributions by output: features and, last, the bias; they add up to the margin."""
        from gradloom import shap

        self._tree_model()
        return self._mapped(data, "contributions", T.ArrayType(T.ArrayType(T.DoubleType())), lambda m, x, b: shap.contributions(m, x, b), keep or (data.row_id,))

    def interactions(self, data: Dataset, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Shapley interactions by output; rows add up to the contributions, the bias cell is the trees' expectation."""
        from gradloom import shap

        self._tree_model()
        return self._mapped(data, "interactions", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))), lambda m, x, b: shap.interactions(m, x), keep or (data.row_id,))

    def _tree_model(self) -> None:
        if self.linear is not None:
            raise ModelFormatError("a linear model has no tree explanations")

    def nodes(self) -> list[tuple]:
        """Rows of NODE_SCHEMA."""
        return [
            (t, t % self.outputs, k, x.feature[k], float(np.float32(x.threshold[k])), bool(x.default_left[k]), x.left[k], x.right[k], float(x.value[k]), float(x.hess[k]), float(x.gain[k]), x.categories[k] is not None, x.categories[k], self.weights[t])
            for t, x in enumerate(self.trees)
            for k in range(len(x))
        ]

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes(), NODE_SCHEMA)

    def importance(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        return importance(self.nodes_frame(spark), kind)

    # storage

    def to_bytes(self) -> bytes:
        return zlib.compress(self.to_json().encode())

    @staticmethod
    def from_bytes(data: bytes, objective: Objective | None = None, trust: bool = False) -> BoostedModel:
        try:
            return BoostedModel.from_json(zlib.decompress(data).decode(), objective, trust)
        except zlib.error as e:
            raise ModelFormatError("not a stored model") from e

    def to_json(self) -> str:
        import dataclasses

        p = {k: v for k, v in dataclasses.asdict(self.params).items() if v == v}
        own = {"format": "gradloom-1", "params": p, "objective": self.objective.name, "n_features": self.n_features, "base_score": self.base_score, "best_iteration": self.best_iteration, "weights": self.weights}
        own["trees"] = [{k: [v.item() if isinstance(v, np.generic) else v for v in getattr(t, k)] for k in t.__dataclass_fields__} for t in self.trees]
        own["linear"] = None if self.linear is None else {"weights": self.linear.weights.tolist(), "bias": self.linear.bias.tolist()}
        try:
            objectives.create(self.params)
        except UnknownName:  # an objective of one's own is kept as code
            from pyspark import cloudpickle

            own["code"] = cloudpickle.dumps(self.objective).hex()
        return json.dumps(own, indent=1)

    @staticmethod
    def from_json(text: str, objective: Objective | None = None, trust: bool = False) -> BoostedModel:
        """A stored objective of one's own is code: it is replaced by `objective`, or run if trust is given, or else this raises."""
        try:
            d = json.loads(text)
            if d.get("format") != "gradloom-1":
                raise ModelFormatError("not a stored model")
            p = {k: (tuple(map(tuple, v)) if k == "interaction_constraints" else tuple(v)) if isinstance(v, list) else v for k, v in d["params"].items()}
            params = TrainingParams(**p)
            if objective is None and "code" in d and not trust:
                raise ModelFormatError("the model has an objective of its own, which is code: give the objective, or trust=True to run what is stored")
            if objective is None:
                objective = pickle.loads(bytes.fromhex(d["code"])) if "code" in d else objectives.create(params)  # noqa: S301
            linear = d["linear"] and Linear(np.array(d["linear"]["weights"]), np.array(d["linear"]["bias"]))
            return BoostedModel(params, objective, d["n_features"], d["base_score"], [Tree(**t) for t in d["trees"]], d["weights"], d["best_iteration"], linear)
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ModelFormatError(f"not a stored model: {e}") from e

    def save(self, path: str) -> None:
        """As JSON if the name ends in .json, else compressed."""
        Path(path).write_bytes(self.to_json().encode() if path.endswith(".json") else self.to_bytes())

    @staticmethod
    def load(path: str, objective: Objective | None = None, trust: bool = False) -> BoostedModel:
        data = Path(path).read_bytes()
        return BoostedModel.from_json(data.decode(), objective, trust) if path.endswith(".json") else BoostedModel.from_bytes(data, objective, trust)

    def write_table(self, spark: SparkSession, path: str) -> None:
        """The model as Parquet: nodes to query, and its JSON to load."""
        self.nodes_frame(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.to_json(),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def read_table(spark: SparkSession, path: str, objective: Objective | None = None, trust: bool = False) -> BoostedModel:
        return BoostedModel.from_json(spark.read.parquet(f"{path}/model").collect()[0][0], objective, trust)


def importance(nodes: DataFrame, kind: str) -> DataFrame:
    """(feature, importance) over the inner nodes of a node table; features that no node splits on are absent."""
    inner = nodes.where(F.col("left") >= 0).groupBy(F.col("split_feature").alias("feature"))
    agg = {"weight": F.count("*").cast("double"), "gain": F.avg("split_gain"), "cover": F.avg("sum_hess"), "total_gain": F.sum("split_gain"), "total_cover": F.sum("sum_hess")}
    if kind not in agg:
        raise UnknownName(f"importance {kind}")
    return inner.agg(agg[kind].alias("importance"))
