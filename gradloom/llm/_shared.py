"""What several operators share: the shared folder, folds, labelled rows, sums over partitions."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys whose sums go in one batch.
SUMS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder where that is unset.

    Only a session in one process (tests) may have neither and gets a temporary folder; on a cluster that raises, because no other machine would see it.
    """
    sc = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not here and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(here or tempfile.mkdtemp(prefix="gradloom-"))
    return here or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder: its lineage ends there and lost executors lose nothing.

    Spark removes the files when df is no longer used, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let the session hand at most `rows` rows at once to Python from now on: for operators whose rows carry binary columns, several workers deep."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(docs: DataFrame) -> Column:
    """All columns of docs, whatever their names, in one: no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def map_whole(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs with `run` applied to its batches, which keep their columns; columns may have any names."""
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def held_out(key: str, n: int, part: int) -> Column:
    """Whether a row is in the held-out fold; a null key counts as learnt from by nobody, so it is held out."""
    return F.coalesce(fold(key, n) == part, F.lit(True))


def unit(key: str, seed: int) -> Column:
    """A number from 0 to 1 by hash of the key, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def labelled(labels: DataFrame, label: str, learn: Column, key: str = "doc_id") -> DataFrame:
    """(key, label) of the rows of labels, all of them, where `learn` holds and the label is 0 or 1; the larger label of a repeated key."""
    return labels.where(learn & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))


def summed(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]], width: int, least: float | None = None, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, a row of sums for each): `add` gives distinct keys and rows of `width` addends for a partition of rows.

    The addends of a key are summed in a task, in order of their partitions, so that equal partitions give equal sums. With `least`, only keys whose first sum is at least that; with `short`, addends travel in single precision.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = add(batches)
        for a in range(0, len(keys), SUMS):
            k, v = keys[a : a + SUMS], np.ascontiguousarray(values[a : a + SUMS], np.float32 if short else np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * width), pa.array(v.ravel()))
            yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int64()), "part": pa.array(np.full(len(k), TaskContext.get().partitionId(), np.int32)), "sums": lists})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        got = pa.Table.from_batches(found).sort_by([("key", "ascending"), ("part", "ascending")])
        key, first = np.unique(got["key"].to_numpy(), return_index=True)
        total = np.add.reduceat(got["sums"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width), first, axis=0)
        if least is not None:
            key, total = key[total[:, 0] >= least], total[total[:, 0] >= least]
        yield pa.RecordBatch.from_pydict({"key": pa.array(key), "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * width), pa.array(total.ravel()))})

    parts = rows.mapInArrow(part, f"key long, part int, sums array<{'float' if short else 'double'}>")
    got = parts.repartition("key").mapInArrow(merge, "key long, sums array<double>").toArrow().sort_by([("key", "ascending")])
    return got["key"].to_numpy(), got["sums"].combine_chunks().flatten().to_numpy().reshape(-1, width)


def ranked(rows: DataFrame, order: list[str | Column], groups: list[str] | None = None) -> DataFrame:
    """rows with rank 1, 2, 3, ... in this order, in each group if there are any.

    Ranges of (groups, order) are sorted each in a task and stored; a row's rank is its place in its range plus the group's rows in the ranges before. So neither all rows nor a group come
    to one task: only a number for each range and group in it does.
    """
    groups = groups or []
    columns = [*[F.col(g).asc() for g in groups], *order]
    sorted_ = cut(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()))
    placed = sorted_.withColumn("_range", F.shiftright("_at", 33))
    per = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_before", F.coalesce(before, F.lit(0)))
    r, p = placed.alias("r"), per.alias("p")
    same = F.col("r._range") == F.col("p._range")
    for g in groups:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}"))
    return r.join(p if groups else F.broadcast(p), same).select(*[f"r.{c}" for c in rows.columns], (F.col("p._before") + F.col("r._at") - F.col("p._first") + 1).alias("rank"))
