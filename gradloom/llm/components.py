"""Connected components of an edge table, by contracting stars until no edge is left."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.llm._shared import cut, remove, shared_dir

#: Contractions more than halve a graph on average, so this many are never used up.
ROUNDS = 60
#: Once at most so many edges are left, one task joins them: each further round costs its jobs, however few edges it has.
LAST = 1 << 13


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the few edges (a, b) that are left: root is the smallest node of node's component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = np.concatenate([edges[c].to_numpy() for c in ("a", "b")])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while (up[a] != up[b]).any():
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[up]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it can reach.

    Each round, a node points to the first of itself and its neighbours in an order by hash (aggregated before the
    shuffle, so that a hub costs one row for each task), and its parent is what that node points to. Edges then join parents, and only distinct edges between
    different parents stay for the next round; so all rounds together handle little more than the first. The last `LAST` edges
    are joined in one task, which gives the same as further rounds; then nodes follow their parents up. Nothing is collected. Each round's tables are written to the shared folder and removed at the end:
    tables, not checkpoints, because their known sizes keep later rounds' estimates small. No edges give no rows.
    """
    spark, folder = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/components-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        left = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        levels: list[DataFrame] = []
        for turn in range(ROUNDS):
            if left.count() <= LAST:
                break
            # a text isn't part of generated code, as a number would be: all rounds share one compilation
            first = lambda c, turn=turn: F.min(F.struct(F.xxhash64(c, F.lit(f"{turn}")).alias("h"), F.col(c).alias("id")))
            near = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(first("b").alias("m"))
            own = F.struct(F.xxhash64("a", F.lit(f"{turn}")).alias("h"), F.col("a").alias("id"))
            near = near.select(F.col("a").alias("node"), F.least(own, "m")["id"].alias("next"))
            above = near.select(F.col("node").alias("next"), F.col("next").alias("parent"))
            levels.append(stored(near.join(above, "next").select("node", "parent"), f"parents{turn}"))
            up = lambda c, level=levels[-1]: level.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
            moved = left.join(up("a"), "a").join(up("b"), "b").where(F.col("pa") != F.col("pb"))
            left = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"edges{turn}")
        kind = left.schema["a"].dataType.simpleString()
        found = left.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}")
        for level in reversed(levels):
            above = found.select(F.col("node").alias("parent"), "root")
            found = level.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        found = stored(found, "roots")
        least = found.groupBy("root").agg(F.min("node").alias("least"))
        return cut(found.join(least, "root").select("node", F.col("least").alias("root")))
    finally:
        remove(spark, folder)
