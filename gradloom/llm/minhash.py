"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set is its distinct shingles of `WORDS` words (A-Z lower-cased); a shorter text is one shingle of all its words.
The set's signature has `COORDINATES` values, one minimum for each of so many hash functions. Texts with equal sets are one
document from the start.

Each document is posted under its first `POSTED` (coordinate, value) pairs. Two documents of the least wanted similarity s collide at
about s * POSTED of them, and at fewer than `shared` in at most a share `LOSS` of cases; so with each document's pairs ordered
from the rarest to the commonest, both prefixes of POSTED - shared + 1 pairs have one in common (prefix filter). Only the lists of the prefixes
are merged; the commonest pairs, with the long lists, are skipped, and probed for the documents that a merged list has brought together.
Documents that lists of the prefixes connect form a cluster.

Collisions are counted cluster by cluster over all coordinates; pairs at fewer than `matches` (again at most a share `LOSS` of similarity s) are dropped.
First each document's best partner and its block's hub are confirmed on full sets. A cluster of more than `BLOCK` documents (or whose sets are long) is cut into blocks; each meets
itself and `DEPUTIES` documents of the whole cluster, so that this pass makes about as many rows as there are documents. Then, in clusters that
still hold several components, the documents outside the largest one meet all documents, with their full sets, and pairs between components are confirmed in place
until they are joined. A cluster of n documents, r of them outside its largest component, is dealt as about n + 2 r n / BLOCK rows; no task gives more pairs than a few for each document.

Defined results: null, empty and blank texts have no set, n_shingles 0, and are linked with nothing. Rows with
equal ids count as one document with the union of their sets' links. Null ids link with nothing and have a null component.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm import _text
from gradloom.llm._shared import cut, whole
from gradloom.llm.components import components

WORDS = 5
COORDINATES = 128
POSTED = 48
#: Each of the two filters drops at most this share of the pairs that are just similar enough.
LOSS = 1e-6
#: Documents in a block of a large cluster, shingles in it, and about how many documents of small clusters go to a task together.
BLOCK = 2048
BLOCK_KEYS = 1 << 21
TOGETHER = 512
#: Documents that all blocks of a large cluster meet, on average; rows compared at once.
DEPUTIES = 64
TILE = 256
#: Tables of large clusters of at most so many rows are broadcast.
BROADCAST_ROWS = 1 << 20
PIECE = 1 << 17

_rng = np.random.default_rng(20240607)
_MASKS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_SEEDS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_STEPS = [np.uint64(x) for x in _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)]


class Limits(NamedTuple):
    """Linked: whole * intersection >= part * union. Such pairs collide at `shared` of POSTED and `matches` of COORDINATES coordinates, but for LOSS of them."""

    shared: int
    matches: int
    part: int
    whole: int


def limits(similarity: float) -> Limits:
    """What links and filters follow from the least similarity of a link."""
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError(f"similarity {similarity} isn't in (0, 1]")
    s = float(share)

    def least(n: int) -> int:
        """The most collisions of n that all but LOSS of the pairs reach."""
        below = 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
            if below > LOSS:
                return max(k, 1)
        return n

    return Limits(least(POSTED), least(COORDINATES), share.numerator, share.denominator)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, their distinct shingles' hashes in ascending order) of a plain() array."""
    _, off, _, _, h = _text.words(texts, _text.SPACE, lower=True)
    n = len(off) - 1
    size = np.diff(off)
    long = size >= WORDS
    x = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        x = h[: len(h) - WORDS + 1] * _STEPS[0]
        for k in range(1, WORDS):
            x = _text.mix(x) + h[k : len(h) - WORDS + 1 + k] * _STEPS[k]
        x = _text.mix(x)
    doc = _text.owner(off)
    inside = np.arange(len(h)) + WORDS <= off[doc + 1] if len(h) else np.zeros(0, bool)
    inside = inside[: len(x)]
    keys, docs = x[inside], doc[: len(x)][inside]
    short = np.flatnonzero(~long & (size > 0))
    if len(short):  # the whole sequence is one shingle, told apart by its length
        own = []
        for i in short:
            v = np.array([size[i]], np.uint64)
            for k in range(off[i], off[i + 1]):
                v = _text.mix(v) + h[k : k + 1] * _STEPS[0]
            own.append(_text.mix(v)[0])
        keys, docs = np.concatenate([keys, np.array(own, np.uint64)]), np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[first], docs[first]
    return np.searchsorted(docs, np.arange(n + 1)), keys


def digests(off: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """128 bits of each set that isn't empty: sums of mixed keys, which don't depend on order."""
    full = np.flatnonzero(np.diff(off))
    digest = np.empty((len(full), 2), np.uint64)
    if len(full):
        for k in range(2):
            digest[:, k] = np.add.reduceat(_text.mix(keys ^ _SEEDS[k]), off[full]) + np.diff(off)[full].astype(np.uint64)
    return digest


def signatures(off: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """COORDINATES minima, their upper 32 bits, of each set that isn't empty."""
    full = np.flatnonzero(np.diff(off))
    out = np.empty((len(full), COORDINATES), np.int32)
    if len(full):
        starts = off[full]
        for k in range(COORDINATES):
            v = (keys ^ _MASKS[k]) * _SEEDS[k]
            out[:, k] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d0, d1, sig) of each row; d0, d1 and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.plain(batch.column(1))
            for a, b in _text.slices(texts, PIECE):
                off, keys = shingles(texts.slice(a, b - a))
                sig, digest = signatures(off, keys), digests(off, keys)
                n = np.diff(off)
                at = np.cumsum(n > 0) - 1
                none = n == 0
                pick = pa.array(np.where(none, 0, at), mask=none)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "n_shingles": pa.array(n.astype(np.int64)),
                    **{f"d{k}": pa.array(np.ascontiguousarray(digest[:, k]).view(np.int64)).take(pick) for k in range(2)},
                    "sig": pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.ravel())).take(pick),
                })

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d0 long, d1 long, sig array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, d0, d1, keys): the full sets of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.plain(batch.column(1))
            for a, b in _text.slices(texts, PIECE):
                off, keys = shingles(texts.slice(a, b - a))
                some = pa.array(np.diff(off) > 0)
                digest = digests(off, keys).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a).filter(some), "d0": np.ascontiguousarray(digest[:, 0]), "d1": np.ascontiguousarray(digest[:, 1]), "keys": lists.filter(some)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d0 long, d1 long, keys array<long>")


def _prefixes(classes: DataFrame, shared: int) -> DataFrame:
    """(doc, token, at): for each class, the prefix of its posted tokens that some other class has too; at is the token's coordinate."""
    mixed = F.transform(F.slice("sig", 1, POSTED), lambda v, i: F.struct(F.xxhash64(v, i).alias("token"), i.alias("at")))
    tokens = classes.select(F.col("doc_id").alias("doc"), F.explode(mixed).alias("t")).select("doc", "t.token", "t.at")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    # Tokens that no other class has come first in each class's order; so of m that others have, m - (shared - 1) are in the prefix.
    each = tokens.join(often, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token", "at"))).alias("all"))
    each = each.where(F.size("all") >= shared)
    return each.select("doc", F.explode(F.slice("all", F.lit(1), F.size("all") - (shared - 1))).alias("t")).select("doc", "t.token", "t.at")


def collisions(sig: np.ndarray, prefix: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each of rows and cols, the coordinates at which their signatures collide, or 0 if their prefixes (bits of posted coordinates) have no such coordinate in common.

    The lists of the posted coordinates are merged for all; the other lists are probed for the pairs which that has brought together.
    """
    hits, met = np.zeros((len(rows), len(cols)), np.int16), np.zeros((len(rows), len(cols)), bool)
    for k in range(POSTED):
        same = sig[rows, k][:, None] == sig[cols, k][None]
        hits += same
        bit = prefix & (1 << k) != 0
        met |= same & bit[rows][:, None] & bit[cols][None]
    i, j = np.nonzero(met)
    if len(i) * 8 < met.size:
        more = (sig[rows[i], POSTED:] == sig[cols[j], POSTED:]).sum(1)
        found = hits[i, j] + more.astype(np.int16)
        hits[:] = 0
        hits[i, j] = found
        return hits
    for k in range(POSTED, COORDINATES):
        hits += sig[rows, k][:, None] == sig[cols, k][None]
    hits[~met] = 0
    return hits


def _tiles(group: pa.Table, least: Limits) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, rows, columns' rows, collisions at or over least.matches, else 0) for each cluster in a group, TILE rows at once; sizes that can't overlap enough have 0 too."""
    got = group.sort_by([("cluster", "ascending"), ("doc", "ascending")])
    col = {c: got[c].to_numpy() for c in ("cluster", "doc", "comp", "n", "prefix", "left", "meet")}
    sig = got["sig"].combine_chunks()
    sig = (sig.chunk(0) if isinstance(sig, pa.ChunkedArray) else sig).flatten().to_numpy().reshape(got.num_rows, COORDINATES)
    if "keys" in got.column_names:
        col["keys"] = got["keys"].combine_chunks()
    n, doc = col["n"], col["doc"]
    bounds = np.append(np.flatnonzero(np.diff(col["cluster"], prepend=col["cluster"][:1] - 1)), got.num_rows)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        left, cols = s + np.flatnonzero(col["left"][s:e]), s + np.flatnonzero(col["meet"][s:e])
        for at in range(0, len(left) if len(cols) else 0, TILE):
            rows = left[at : at + TILE]
            hits = collisions(sig, col["prefix"], rows, cols)
            small, large = np.minimum(n[rows][:, None], n[cols][None]), np.maximum(n[rows][:, None], n[cols][None])
            hits[(hits < least.matches) | (doc[rows][:, None] == doc[cols][None]) | (least.whole * small < least.part * large)] = 0
            yield col, rows, cols, hits


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.table([pairs[:, 0], pairs[:, 1]], schema=_PAIR)


def _promising(group: pa.Table, least: Limits) -> pa.Table:
    """For a block of clusters' members: each one's best partner, and the partners of each tile's hub."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for col, rows, cols, hits in _tiles(group, least):
        doc = col["doc"]
        best = hits.argmax(1)
        some = np.flatnonzero(hits[np.arange(len(rows)), best])
        found.append((doc[rows[some]], doc[cols[best[some]]]))
        for h, x, y in ((hits, rows, cols), (hits.T, cols, rows)):
            hub = int((h > 0).sum(1).argmax())
            near = np.flatnonzero(h[hub])
            found.append((np.full(len(near), doc[x[hub]]), doc[y[near]]))
    return _pairs(found)


def _joining(group: pa.Table, least: Limits) -> pa.Table:
    """For a block of clusters' members with their full sets: confirmed links that join components, none between those already joined here."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    top: dict[int, int] = {}
    held: dict[int, np.ndarray] = {}

    def root(c: int) -> int:
        while (up := top.get(c, c)) != c:
            c = up
        return c

    for col, rows, cols, hits in _tiles(group, least):
        comp, doc, keys = col["comp"], col["doc"], col["keys"]
        now = np.array([root(c) for c in comp[rows].tolist()]), np.array([root(c) for c in comp[cols].tolist()])
        hits[now[0][:, None] == now[1][None]] = 0
        i, j = np.nonzero(hits)
        for k in np.argsort(-hits[i, j], kind="stable"):  # the likeliest first
            x, y = int(rows[i[k]]), int(cols[j[k]])
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a == b:
                continue
            for at in (x, y):
                if at not in held:
                    held[at] = np.asarray(keys[at].values)
            kx, ky = held[x], held[y]
            both = len(np.intersect1d(kx, ky, assume_unique=True))
            if least.whole * both >= least.part * (len(kx) + len(ky) - both):
                top[max(a, b)] = min(a, b)
                found.append((doc[x : x + 1], doc[y : y + 1]))
    return _pairs(found)


_MEMBER = ["doc", "n", "sig", "prefix", "cluster", "comp"]


def _packed(small: DataFrame, rows: int, *more: str) -> DataFrame:
    """Small clusters whole, about TOGETHER documents to a group (g, i, j)."""
    packs = max(1, -(-rows // TOGETHER))
    return small.select(*_MEMBER, *more, F.lit(True).alias("left"), F.lit(True).alias("meet"), F.pmod(F.xxhash64("cluster", F.lit(3)), F.lit(packs)).alias("g"), F.lit(0).alias("i"), F.lit(-1).alias("j"))


def _spread(seed: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(parts)).cast("int")


def _all(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _compared(parts: list[DataFrame], by: Callable[[pa.Table, Limits], pa.Table], least: Limits) -> DataFrame:
    """What `by` makes of the groups (g, i, j): distinct pairs (a, b)."""
    return reduce(DataFrame.union, parts).groupBy("g", "i", "j").applyInArrow(lambda group: by(group, least), "a long, b long").distinct()


def _first_pass(members: DataFrame, large: DataFrame, least: Limits) -> DataFrame:
    """Pairs (a, b) that are likely links, a few for each of the members (doc, n, sig, prefix, cluster); large: (cluster, size, total) of those to cut."""
    rows = members.count()
    members = members.withColumn("comp", F.col("doc"))
    small = members.join(large, "cluster", "left_anti")
    cut_up = members.join(large, "cluster").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", _spread(0, "blocks"))
    columns = [*_MEMBER, F.col("left"), F.lit(True).alias("meet"), F.col("cluster").alias("g"), "i", F.lit(0).alias("j")]
    own = cut_up.withColumn("left", F.lit(True)).withColumn("i", F.col("own"))
    deputies = cut_up.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.col("size")) < DEPUTIES).withColumn("left", F.lit(False)).withColumn("i", _all("blocks")).where(F.col("i") != F.col("own"))
    return _compared([_packed(small, rows), own.select(*columns), deputies.select(*columns)], _promising, least)


def _second_pass(members: DataFrame, large: DataFrame, sets: DataFrame, least: Limits) -> DataFrame:
    """Links (a, b) that join components of one cluster, from members with comp and all their sets (doc, keys)."""
    apart = F.min("comp") != F.max("comp")
    small = members.join(large, "cluster", "left_anti")
    open_ = small.groupBy("cluster").agg(apart.alias("apart")).where("apart").select("cluster")
    small = cut(small.join(open_, "cluster", "left_semi"))
    sizes = members.join(large.select("cluster", "total"), "cluster").groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.first("total").alias("total"))
    main = sizes.groupBy("cluster").agg(apart.alias("apart"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("size"), F.max("m").alias("most"), F.first("total").alias("total")).where("apart")
    # A block has at most about BLOCK documents and BLOCK_KEYS shingles.
    blocks = lambda rows: F.ceil(F.greatest(rows / BLOCK, F.col("total") * rows / F.col("size") / BLOCK_KEYS)).cast("int")
    main = bounded(main.select("cluster", "main", blocks(F.col("size")).alias("all_blocks"), blocks(F.col("size") - F.col("most")).alias("rest_blocks")))
    cut_up = members.join(main, "cluster").join(sets, "doc")
    columns = [*_MEMBER, "keys", F.col("left"), (~F.col("left")).alias("meet"), F.col("cluster").alias("g"), "i", "j"]
    rest = cut_up.where(F.col("comp") != F.col("main")).withColumn("left", F.lit(True)).withColumn("i", _spread(1, "rest_blocks")).withColumn("j", _all("all_blocks"))
    every = cut_up.withColumn("left", F.lit(False)).withColumn("j", _spread(2, "all_blocks")).withColumn("i", _all("rest_blocks"))
    return _compared([_packed(small.join(sets, "doc"), small.count(), "keys"), rest.select(*columns), every.select(*columns)], _joining, least)


def bounded(rows: DataFrame) -> DataFrame:
    """rows, stored, and to be broadcast if there are at most BROADCAST_ROWS."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _confirmed(pairs: DataFrame, sets: DataFrame, least: Limits) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    keys = lambda c: sets.select(F.col("doc_id").alias(c), F.col("keys").alias(f"k{c}"))
    both, na, nb = F.size(F.array_intersect("ka", "kb")).cast("long"), F.size("ka").cast("long"), F.size("kb").cast("long")
    return pairs.join(keys("a"), "a").join(keys("b"), "b").where(least.whole * both >= least.part * (na + nb - both)).select("a", "b")


def _labelled(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nodes (doc, ...) with column `name`, the component of doc under links (a, b)."""
    roots = components(links)
    return nodes.join(roots, nodes["doc"] == roots["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "doc").alias(name))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs; sets of at least this Jaccard similarity are linked."""
    least = limits(similarity)
    rows = cut(signed(docs, key, text))
    whole = rows.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    # One class for equal sets: its smallest id stands for it.
    classes = whole.groupBy("d0", "d1", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    classes = cut(classes.select("d0", "d1", "n_shingles", F.col("m.doc_id").alias("doc_id"), F.col("m.sig").alias("sig")))
    of = classes.select("d0", "d1", "n_shingles", F.col("doc_id").alias("class"))
    # An id of several texts joins their classes.
    several = whole.groupBy("doc_id").agg(F.min("d0").alias("lo"), F.max("d0").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    twice = whole.drop("sig").join(several, "doc_id").join(of, ["d0", "d1", "n_shingles"]).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    posted = cut(_prefixes(classes, least.shared))
    hubs = posted.groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where(F.col("a") < F.col("z")).select("token", "a")
    joined = posted.join(hubs, "token").where(F.col("doc") != F.col("a")).select("a", F.col("doc").alias("b"))
    cluster = components(joined).select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    prefix = posted.groupBy("doc").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("prefix"))
    members = cut(cluster.join(prefix, "doc").join(classes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig"), "doc"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    large = bounded(sizes.where((F.col("size") > BLOCK) | (F.col("total") > BLOCK_KEYS)))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = _sets(named.join(members.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"))
    sets = cut(sets.join(classes.select("doc_id", "d0", "d1"), ["doc_id", "d0", "d1"], "left_semi").dropDuplicates(["doc_id", "d0", "d1"]).select("doc_id", "keys"))
    links = cut(_confirmed(_first_pass(members, large, least), sets, least))
    labelled = cut(_labelled(members, links, "comp"))
    links = cut(links.union(_second_pass(labelled, large, sets.withColumnRenamed("doc_id", "doc"), least)))
    roots = components(links.union(twice))
    of = of.join(roots, of["class"] == roots["node"], "left").select("d0", "d1", "n_shingles", F.coalesce("root", "class").alias("component_id"))
    found = whole.drop("sig").join(of, ["d0", "d1", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    rest = rows.where(F.col("sig").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(rest).select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.85) -> DataFrame:
    """One row of each component, all columns: of its smallest id, or of a null id where it has no other; of several such rows the one of the longest text.

    Here rows with null ids link by their texts. Those without a set all stay. Columns may have any names.
    """
    # The columns of docs stay together in one, so that no name of theirs meets one of ours.
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), whole(docs).alias("row"))
    known, unknown = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    texts, own = known.select("doc_id", "text"), None
    if unknown.limit(1).count():
        some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        # Equal texts of null ids are one row, with a number after all ids: rows of a partition and partitions in turn.
        own = cut(unknown.where(some).dropDuplicates(["text"]).withColumn("at", F.monotonically_increasing_id()))
        last = texts.agg(F.max("doc_id")).collect()[0][0] or 0
        parts = own.agg(F.max(F.shiftright("at", 33))).collect()[0][0] or 0
        number = F.lit(last) + 1 + F.col("at").bitwiseAND((1 << 33) - 1) * (parts + 1) + F.shiftright("at", 33)
        own = own.withColumn("at", number)
        least = own.agg(F.min("at"), F.max("at")).collect()[0]
        if least[0] is not None and not last < least[0] <= least[1]:
            raise ValueError(f"no numbers are left after the id {last} for rows with null ids")
        texts = texts.union(own.select(F.col("at").alias("doc_id"), "text"))
    marks = cut(near_duplicates(texts, similarity=similarity))
    gone = marks.where(~F.col("kept")).select("doc_id").distinct()
    again = marks.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = known.join(gone.union(again), "doc_id", "left_anti").select("row")
    several = known.join(again, "doc_id", "left_semi")
    one = several.groupBy("doc_id").agg(F.max_by("row", F.struct(F.length("text"), F.col("text"))).alias("row")).select("row")
    once = once.union(one)
    if own is not None:
        once = once.union(own.join(gone, own["at"] == gone["doc_id"], "left_anti").select("row")).union(unknown.where(~some).select("row"))
    return once.select("row.*")
