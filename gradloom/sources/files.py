"""Delimited and libsvm text as Datasets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.dataset import Dataset, SparseDataset, from_long
from gradloom.errors import EmptyDataset
from gradloom.operators.running import running_sums


def read_csv(spark: SparkSession, path: str, header: bool = False, delimiter: str = ",", label_column: int | None = 0, na_value: str = "NA", categorical: frozenset[int] = frozenset()) -> Dataset:
    """A file of numbers without quotes. Empty cells and na_value are missing; ragged rows and other text raise when read.

    Columns are f0, f1, ... in order, without the label's.
    """
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise EmptyDataset(path)
    width = len(first[0][0].split(delimiter))
    schema = T.StructType([T.StructField(f"c{k}", T.FloatType()) for k in range(width)])
    df = spark.read.csv(path, schema=schema, header=header, sep=delimiter, nullValue=na_value, mode="FAILFAST", quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    named, k = [], 0
    for c in range(width):
        if c == label_column:
            bad = F.raise_error("a row has no label").cast("float")
            named.append(F.coalesce(F.col(f"c{c}"), bad).alias("label"))
        else:
            named.append(F.when(F.isnan(f"c{c}"), None).otherwise(F.col(f"c{c}")).alias(f"f{k}"))
            k += 1
    df = df.select(F.monotonically_increasing_id().alias("row_id"), *named)
    return Dataset(df, tuple(f"f{i}" for i in range(k)), "row_id", "label" if label_column is not None else None, categorical=categorical)


def libsvm_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((row_id, label), (row_id, feature, value)) of `label index:value ...` lines; blank lines and lines that begin with # are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select(F.monotonically_increasing_id().alias("row_id"), F.split(F.trim("value"), r"\s+").alias("parts"))
    labels = lines.select("row_id", F.element_at("parts", 1).cast("float").alias("label"))
    pair = lines.select("row_id", F.explode(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).alias("part")).select("row_id", F.split("part", ":").alias("kv"))
    bad = lambda kind: F.raise_error(F.concat(F.lit("not an index:value pair: "), F.concat_ws(":", "kv"))).cast(kind)
    ok = F.size("kv") == 2
    return labels, pair.select("row_id", F.when(ok, F.col("kv")[0].cast("int")).otherwise(bad("int")).alias("feature"), F.when(ok, F.col("kv")[1].cast("float")).otherwise(bad("float")).alias("value"))


def read_libsvm(spark: SparkSession, path: str) -> Dataset:
    """0-based libsvm text; features are f0 to the largest index, absent ones missing."""
    labels, cells = libsvm_cells(spark, path)
    top = cells.agg(F.max("feature")).collect()[0][0]
    if top is None:
        raise EmptyDataset(path)
    wide = labels.join(from_long(cells, top + 1), "row_id", "left")
    return Dataset(wide, tuple(f"f{k}" for k in range(top + 1)), "row_id", "label")


def read_libsvm_sparse(spark: SparkSession, path: str, n_features: int | None = None) -> SparseDataset:
    """0-based libsvm text with a row's cells in two arrays, so that there may be millions of features; n_features: if not all of them occur."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select(F.monotonically_increasing_id().alias("row_id"), F.split(F.trim("value"), r"\s+").alias("parts"))
    cell = lambda kind, k: lambda part: F.coalesce(F.when(F.size(F.split(part, ":")) == 2, F.split(part, ":")[k].cast(kind)), F.raise_error(F.concat(F.lit("not an index:value pair: "), part)).cast(kind))
    cells = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    frame = lines.select("row_id", F.element_at("parts", 1).cast("float").alias("label"), F.transform(cells, cell("int", 0)).alias("indices"), F.transform(cells, cell("float", 1)).alias("values"))
    if n_features is None:
        top = frame.agg(F.max(F.array_max("indices"))).collect()[0][0]
        if top is None:
            raise EmptyDataset(path)
        n_features = top + 1
    return SparseDataset(frame, n_features, label="label")


def from_dense(spark: SparkSession, rows: list[list[float]], missing: float = math.nan) -> Dataset:
    """Rows of numbers held by the driver."""
    if not rows or not rows[0]:
        raise EmptyDataset("no rows or no features")
    names = [f"f{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]))
    return Dataset.of(df, names, "row_id", missing)


def from_csr(spark: SparkSession, indptr: list[int], indices: list[int], values: list[float], n_features: int) -> Dataset:
    """Sparse rows held by the driver; cells that aren't there are missing, not zero, and of repeated ones the first counts."""
    from gradloom.errors import DimensionMismatch, FeatureOutOfBounds

    if len(indptr) < 2 or n_features < 1:
        raise EmptyDataset("no rows or no features")
    if indptr[-1] != len(indices) or len(indices) != len(values):
        raise DimensionMismatch("indptr, indices and values don't fit together")
    if any(not 0 <= i < n_features for i in indices):
        raise FeatureOutOfBounds("an index is beyond the last feature")
    rows = []
    for r in range(len(indptr) - 1):
        got: dict[int, float] = {}
        for k in range(indptr[r], indptr[r + 1]):
            got.setdefault(indices[k], float(values[k]))
        rows.append([got.get(f, math.nan) for f in range(n_features)])
    return from_dense(spark, rows)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with a dense row_id from 0 in the given order; the first of it is a number, and cuts the rows into buckets that are numbered by themselves."""
    run = running_sums(df, order[0], {"row_id": F.lit(1)}, order=[F.col(c) for c in order[1:]])
    return run.withColumn("row_id", (F.col("row_id") - 1).cast("long"))
