"""Embedding near-dedup: spherical k-means cells, blocked cosine products, components.

Equal vectors are one class from the start, however many rows they have: rows of one 64-bit key, which a second hash tells apart; where it finds two
vectors under one key, those get keys by another seed until none is shared. Spherical k-means on a bounded
sample of about `SAMPLE` classes, spread over the table by hash, gives the cells' centres; their number grows with the square root of
the classes up to `CELLS`. Every class lives in the cell of its nearest centre (its home) and visits the other cells
whose border is so near that the closer side of a linked pair across it can be there. Home and visits are computed for every class.
No linked pair is missed: of two homes' centres a and b, (a - b)(x - y) is the sum of the two sides' gaps and at most |a - b| |x - y|, so the
side of the smaller gap is within half of that and visits the other's home.

Neighbouring cells form groups of about a block's residents, so that a vector is dealt to a group once, however many of its cells it visits;
larger groups are cut into blocks by hash. A block has `VALUES` numbers or `BLOCK` classes at most, whichever is less. A task takes a block of a
group's residents and a block of its residents and visitors and multiplies them cell by cell, `CHUNK` by `CHUNK`, in double precision.
It gives each vector's count of links and one row to its local component's root, never the pairs. A pair that two cells see is counted in the home of its smaller key.

Defined results: null vectors, empty and zero vectors and vectors with a null or non-finite component link with nothing.
Vectors of different lengths don't link; lengths that the sample lacks have one cell. Rows with equal ids are rows of their own that share a component;
a null id links with nothing. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.llm._shared import cut, unit
from gradloom.llm.components import components

SAMPLE = 8192
CELLS = 4096
BLOCK = 16384
VALUES = 1 << 21
CHUNK = 1024
LEAST = 0.9
#: Vectors that a task compares with all centres at once.
ROWS = 256


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 10, seed: int = 11) -> np.ndarray:
    """k unit centres of the unit rows of x; seeds are spread out, empty cells are dropped."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    at = [int(rng.integers(len(x)))]
    near = x @ x[at[0]]
    while len(at) < k:
        far = np.maximum(1 - near, 0)
        if far.sum() <= 1e-9:
            break
        at.append(int(rng.choice(len(x), p=far / far.sum())))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(steps):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def cells_of(x: np.ndarray, c: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(home of each unit row of x, which cells it is in). Arrays of rows times centres are made, none of centres times centres."""
    s = x @ c.T
    home = s.argmax(1)
    np.subtract(s[np.arange(len(x)), home][:, None], s, out=s)  # the gaps
    border = c[home] @ c.T
    border = np.sqrt(np.maximum(2 - 2 * border, 0), out=border)
    border *= np.sqrt(2 - 2 * least) / 2
    border += 1e-6
    return home, s <= border


def _groups_seen(member: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which groups each row has a cell in."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return np.logical_or.reduceat(member[:, order], starts, axis=1)


def _unit_rows(a: pa.Array) -> np.ndarray:
    """A list array of equal lengths as rows of length 1."""
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _local_roots(r: np.ndarray, c: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of n rows and m columns that r and c link; unlinked ones have a label of their own."""
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        new_c = cols.copy()
        np.minimum.at(new_c, c, rows[r])
        new_r = rows.copy()
        np.minimum.at(new_r, r, new_c[c])
        if (new_c == cols).all() and (new_r == rows).all():
            return rows, cols
        rows, cols = new_r, new_c


def _group_cells(c: np.ndarray, groups: int) -> np.ndarray:
    """Which group each centre is in: neighbours share one."""
    return np.unique((c @ spherical_kmeans(c, groups).T).argmax(1), return_inverse=True)[1]


def _bits(column: pa.Array) -> np.ndarray:
    """A column of equally long bit fields as a boolean matrix."""
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1).astype(bool)


def _block(least: float):  # noqa: ANN202
    kind = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("key", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        live = group.filter(group["resident"]).sort_by([("home", "ascending"), ("key", "ascending")]).combine_chunks()
        meet = group.filter(pa.compute.invert(group["resident"])).sort_by([("home", "ascending"), ("key", "ascending")]).combine_chunks()
        if not len(live) or not len(meet):
            return kind.empty_table()
        one = lambda t, name: t[name].combine_chunks()
        x, y = _unit_rows(one(live, "x")), _unit_rows(one(meet, "x"))
        (xk, xid, xw, xh), (yk, yid, yw, yh) = ([t[name].to_numpy() for name in ("key", "id", "rows", "home")] for t in (live, meet))
        xin, yin = _bits(one(live, "cells")), _bits(one(meet, "cells"))
        left, right = np.zeros(len(xk), np.int64), np.zeros(len(yk), np.int64)
        edges = []
        starts = np.append(np.flatnonzero(np.diff(xh, prepend=-1)), len(xh))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            cell = xh[s]
            guests = np.flatnonzero(yin[:, cell])
            for i in range(s, e, CHUNK):
                own = slice(i, min(i + CHUNK, e))
                for j in range(0, len(guests), CHUNK):
                    at = guests[j : j + CHUNK]
                    near = x[own] @ y[at].T >= least
                    near &= xk[own, None] != yk[None, at]
                    r, c = np.nonzero(near)
                    if not len(r):
                        continue
                    rows, cols = _local_roots(r, c, len(near), len(at))
                    node = np.concatenate([xid[own], yid[at]])
                    root = node[np.concatenate([rows, cols])]
                    edges.append(np.stack([node, root], 1)[node != root])
                    r, c = r + i, at[c]
                    # a pair with a visitor whose home the resident visits too is counted in the home of the smaller key
                    use = (yh[c] == cell) | (xk[r] < yk[c]) | ~xin[r, yh[c]]
                    r, c = r[use], c[use]
                    left += np.bincount(r, yw[c], len(left)).astype(np.int64)
                    visiting = yh[c] != cell
                    right += np.bincount(c[visiting], xw[r[visiting]], len(right)).astype(np.int64)
        pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        # rows with links have no root, rows with a root have no links
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        none = np.zeros(len(pairs), np.int64)
        node, links, key = (np.concatenate(v) for v in ((xid[a], yid[b], pairs[:, 0]), (left[a], right[b], none), (xk[a], yk[b], none)))
        root = np.concatenate([xid[a], yid[b], pairs[:, 1]])
        return pa.table([node, root, links, key], schema=kind)

    return run


def _key(turn: int) -> Column:
    """A hash of x; another one in each turn."""
    return F.xxhash64("x") if turn == 0 else F.xxhash64("x", F.lit(turn))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with key, which is null where x is; (key, id, rows, x) of each different x). No two vectors have one key.

    Keys that two vectors share are collected: of n vectors about n * n / 2^65 are, three among 10^10.
    """
    rows, turn = rows.withColumn("key", F.when(F.col("x").isNotNull(), _key(0))), 0
    while True:
        other = F.xxhash64(F.lit("other"), "x")
        found = cut(rows.where(F.col("x").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("x").alias("x"), F.min(other).alias("lo"), F.max(other).alias("hi")))
        shared = [r["key"] for r in found.where(F.col("lo") != F.col("hi")).select("key").collect()]
        if not shared:
            return rows, found.drop("lo", "hi")
        turn += 1
        rows = rows.withColumn("key", F.when(F.col("key").isin(shared), _key(turn)).otherwise(F.col("key")))


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    # floats are dealt as they are: each task makes doubles of them
    x = F.col(column) if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else F.col(column).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col(key).isNotNull()
    rows, classes = _classes(vectors.select(F.col(key).cast("long").alias("id"), F.when(sound, x).alias("x")))
    whole = rows.where(F.col("x").isNotNull())
    total = classes.count()
    lengths = {r["n"]: r["count"] for r in classes.groupBy(F.size("x").alias("n")).count().collect()}
    picked = classes.where(unit("key", 8) < min(1.0, SAMPLE / max(1, total))).select("key", "x").toArrow().sort_by("key")
    centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = pa.compute.list_value_length(picked["x"]).to_numpy() if len(picked) else np.zeros(0, int)
    for n in np.unique(sizes):
        own = picked.filter(pa.array(sizes == n))["x"].combine_chunks()
        count = lengths[int(n)]
        c = spherical_kmeans(_unit_rows(own), int(np.clip(np.sqrt(count) / 2, 1, CELLS)))
        centres[int(n)] = c, _group_cells(c, int(np.clip(np.ceil(count / min(BLOCK, max(CHUNK, VALUES / n))), 1, len(c))))
    held = spark.sparkContext.broadcast(centres)

    def placed_rows(part: pa.RecordBatch, n: int) -> pa.RecordBatch:
        if (found := held.value.get(n)) is None:
            home, member, group = np.zeros(part.num_rows, np.int64), np.ones((part.num_rows, 1), bool), np.zeros(1, np.int64)
        else:
            home, member = cells_of(_unit_rows(part.column(3)), found[0], least)
            group = found[1]
        seen = _groups_seen(member, group)
        off = np.append(0, np.cumsum(seen.sum(1))).astype(np.int32)
        groups = pa.ListArray.from_arrays(pa.array(off), pa.array(np.nonzero(seen)[1].astype(np.int32)))
        cells = pa.array([v.tobytes() for v in np.packbits(member, axis=1)], pa.binary())
        more = [pa.array(np.full(part.num_rows, n, np.int32)), pa.array(home.astype(np.int32)), cells, pa.array(group[home].astype(np.int32)), groups]
        return pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "length", "home", "cells", "own", "groups"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(3)).to_numpy()
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                for i in range(0, part.num_rows, ROWS):
                    yield placed_rows(part.slice(i, ROWS), int(n))

    kind = f"key long, id long, rows long, x {classes.schema['x'].dataType.simpleString()}, length int, home int, cells binary, own int, groups array<int>"
    placed = cut(classes.mapInArrow(assign, kind))
    # The number of groups is bounded, and so is this table of the blocks that they are cut into.
    group_sizes = placed.select("length", F.explode("groups").alias("group"), "own").groupBy("length", "group").agg(F.sum((F.col("group") == F.col("own")).cast("long")).alias("live"), F.count("*").alias("all"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(CHUNK), VALUES / F.col("length")))
    cut_into = group_sizes.where(F.col("live") > 0).select("length", "group", *[F.ceil(F.col(n) / block).cast("int").alias(f"{n}_blocks") for n in ("live", "all")])
    member = placed.withColumn("group", F.explode("groups")).join(F.broadcast(cut_into), ["length", "group"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    live = member.where(F.col("group") == F.col("own")).withColumn("i", part("live_blocks", 1)).withColumn("j", spread("all_blocks"))
    meet = member.withColumn("j", part("all_blocks", 2)).withColumn("i", spread("live_blocks"))
    columns = ["length", "group", "i", "j", "key", "id", "rows", "x", "home", "cells"]
    dealt = live.select(*columns, F.lit(True).alias("resident")).union(meet.select(*columns, F.lit(False).alias("resident")))
    found = cut(dealt.groupBy("length", "group", "i", "j").applyInArrow(_block(least), "node long, root long, links long, key long"))
    roots = components(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")).union(_shared_ids(whole, classes)))
    counts = found.where(F.col("links") > 0).groupBy("key").agg(F.sum("links").alias("links"))
    c = classes.select("key", "id", "rows")
    c = c.join(counts, "key", "left").join(roots, c["id"] == roots["node"], "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = whole.select("id", "key").join(c, "key").select("id", "n_links", "component_id")
    rest = rows.where(F.col("x").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _shared_ids(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join the classes of ids which have several vectors."""
    several = whole.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where(F.col("lo") != F.col("hi")).select("id")
    return whole.select("id", "key").join(several, "id").join(classes.select("key", F.col("id").alias("a")), "key").select("a", F.col("id").alias("b"))
