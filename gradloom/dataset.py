"""A training table: which columns of a DataFrame are features, label, weight, margin and query; missing is null."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.errors import DimensionMismatch, EmptyDataset, FeatureOutOfBounds
from gradloom.operators.running import running_sums


def present(c: Column, missing: float = math.nan) -> Column:
    """c as float, null where it is NaN, null or the missing value."""
    v = c.cast("float")
    v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
    return v if math.isnan(missing) else F.nullif(v, F.lit(missing).cast("float"))


@dataclass(frozen=True)
class Dataset:
    """frame has row_id, the feature columns (float, null where missing) and the named others.

    Attached columns are checked to exist; contents are checked where they are used.
    """

    frame: DataFrame
    features: tuple[str, ...]
    row_id: str = "row_id"
    label: str | None = None
    weight: str | None = None
    base_margin: str | None = None
    qid: str | None = None
    categorical: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        if not self.features:
            raise EmptyDataset("no features")
        for c in (self.row_id, *self.features, self.label, self.weight, self.base_margin, self.qid):
            if c is not None and c not in self.frame.columns:
                raise DimensionMismatch(f"there is no column {c}")
        if any(not 0 <= f < len(self.features) for f in self.categorical):
            raise FeatureOutOfBounds("a categorical feature is beyond the last feature")

    @staticmethod
    def of(df: DataFrame, features: list[str], row_id: str, missing: float = math.nan, **columns: object) -> Dataset:
        """A dataset of df, with NaN and the missing value made null."""
        rest = [c for c in df.columns if c not in features]
        named = {f"{k}": v for k, v in columns.items()}
        frame = df.select(*rest, *[present(F.col(f), missing).alias(f) for f in features])
        return Dataset(frame, tuple(features), row_id, **named)

    def with_(self, **changes: object) -> Dataset:
        return replace(self, **changes)

    def select_rows(self, condition: Column) -> Dataset:
        """The rows where condition holds, all columns kept."""
        return replace(self, frame=self.frame.where(condition))

    def long(self) -> DataFrame:
        """(row_id, feature number, value) of every present cell."""
        cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f).alias("value")) for k, f in enumerate(self.features)])
        return self.frame.select(F.col(self.row_id).alias("row_id"), F.inline(cells)).where(F.col("value").isNotNull())


@dataclass(frozen=True)
class SparseDataset:
    """frame has row_id, arrays of feature numbers (from 0) and of their values, and the named others. Cells that aren't there are missing; of a row's repeated ones the first counts.

    No column is made for a feature, so there may be millions of them.
    """

    frame: DataFrame
    n_features: int
    indices: str = "indices"
    values: str = "values"
    row_id: str = "row_id"
    label: str | None = None
    weight: str | None = None
    base_margin: str | None = None
    qid: str | None = None
    categorical: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        if self.n_features < 1:
            raise EmptyDataset("no features")
        for c in (self.row_id, self.indices, self.values, self.label, self.weight, self.base_margin, self.qid):
            if c is not None and c not in self.frame.columns:
                raise DimensionMismatch(f"there is no column {c}")
        if any(not 0 <= f < self.n_features for f in self.categorical):
            raise FeatureOutOfBounds("a categorical feature is beyond the last feature")

    @property
    def features(self) -> range:
        return range(self.n_features)

    def with_(self, **changes: object) -> SparseDataset:
        return replace(self, **changes)

    def select_rows(self, condition: Column) -> SparseDataset:
        """The rows where condition holds, all columns kept."""
        return replace(self, frame=self.frame.where(condition))

    def long(self) -> DataFrame:
        """(row_id, feature, value) of every present cell."""
        cells = self.frame.select(F.col(self.row_id).alias("row_id"), F.inline(F.arrays_zip(F.col(self.indices).alias("feature"), F.col(self.values).cast("array<float>").alias("value"))))
        return cells.where(F.col("value").isNotNull() & ~F.isnan("value"))


def from_long(cells: DataFrame, n_features: int, row: str = "row_id", feature: str = "feature", value: str = "value") -> DataFrame:
    """One row for each row_id with columns f0..f{n-1}; cells that aren't there are null."""
    picks = [F.max(F.when(F.col(feature) == k, F.col(value))).cast("float").alias(f"f{k}") for k in range(n_features)]
    return cells.groupBy(row).agg(*picks)


def group_pointers(sizes: DataFrame, group: str = "gid", size: str = "size") -> DataFrame:
    """(group, start, end): groups of the given sizes one after another."""
    return running_sums(sizes.select(group, size), group, {"end": size}).select(group, (F.col("end") - F.col(size)).alias("start"), "end")
