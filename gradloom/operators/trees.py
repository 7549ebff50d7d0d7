"""The kernels of tree growing as DataFrame operations: histograms, split scans, best splits, routing, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.gain import EPS, leaf_weight, score_at, structure_score
from gradloom.params import TrainingParams


def root_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, g, h): sums of the gradients in double."""
    return rows.groupBy(*keys).agg(F.sum(F.col("g").cast("double")).alias("g"), F.sum(F.col("h").cast("double")).alias("h"))


def histogram(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, bin, g, h, n) from cells (keys, feature, bin, g, h), summed before the shuffle."""
    return cells.groupBy(*keys, "feature", "bin").agg(F.sum(F.col("g").cast("double")).alias("g"), F.sum(F.col("h").cast("double")).alias("h"), F.count("*").alias("n"))


def binned_cells(rows: DataFrame, bins: list[str], *keep: str) -> DataFrame:
    """(keep, feature, bin) for each present bin of rows, whose bins are one column for each feature."""
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(b).alias("bin")) for k, b in enumerate(bins)])
    return rows.select(*keep, F.inline(cells)).where(F.col("bin").isNotNull())


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(feature, bin, g, h): the sibling's histogram."""
    p, c = parent.alias("p"), child.alias("c")
    j = p.join(c, (F.col("p.feature") == F.col("c.feature")) & (F.col("p.bin") == F.col("c.bin")), "left")
    less = lambda n: (F.col(f"p.{n}") - F.coalesce(F.col(f"c.{n}"), F.lit(0.0))).alias(n)
    return j.select("p.feature", "p.bin", less("g"), less("h"))


def _candidates(scan: DataFrame, p: TrainingParams, low: Column | None, high: Column | None, direction: Column) -> DataFrame:
    """Rows (node, feature, at, gl, hl, gr, hr, default_left, gain) of scan that may split; scan has gl, hl, gm, hm, gt, ht."""
    sides = F.array(
        F.struct(F.lit(False).alias("default_left"), F.col("gl").alias("l"), F.col("hl").alias("k")),
        F.struct(F.lit(True).alias("default_left"), (F.col("gl") + F.col("gm")).alias("l"), (F.col("hl") + F.col("hm")).alias("k")),
    )
    two = scan.withColumn("s", F.explode(sides)).where(~F.col("s.default_left") | (F.col("hm") > 1e-6))
    two = two.withColumn("default_left", F.col("s.default_left")).withColumn("gl", F.col("s.l")).withColumn("hl", F.col("s.k")).drop("s")
    two = two.withColumn("gr", F.col("gt") - F.col("gl")).withColumn("hr", F.col("ht") - F.col("hl"))
    gl, hl, gr, hr = (F.col(c) for c in ("gl", "hl", "gr", "hr"))
    if low is None:
        gain = structure_score(gl, hl, p) + structure_score(gr, hr, p) - structure_score(F.col("gt"), F.col("ht"), p)
        ok = F.lit(True)
    else:
        bound = lambda w: F.least(F.greatest(w, low), high)
        wl, wr, wt = bound(leaf_weight(gl, hl, p)), bound(leaf_weight(gr, hr, p)), bound(leaf_weight(F.col("gt"), F.col("ht"), p))
        gain = score_at(gl, hl, wl, p) + score_at(gr, hr, wr, p) - score_at(F.col("gt"), F.col("ht"), wt, p)
        ok = F.when(direction > 0, wl <= wr).when(direction < 0, wl >= wr).otherwise(True)
    fits = (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & ok
    return two.withColumn("gain", gain).where(fits)


def numeric_splits(hist: DataFrame, totals: DataFrame, p: TrainingParams, low: Column | None = None, high: Column | None = None, direction: Column | None = None) -> DataFrame:
    """Candidates of hist (node, feature, bin, g, h) with totals (node, gt, ht): left is all bins up to the candidate's.

    The last bin of a feature has nothing right of it. Missing rows, the total less the present ones, go right, and where there are any also left.
    With low and high, weights are bounded and candidates against the feature's direction go.
    """
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    # the empty bin under the first one: all present rows right, missing ones left
    under = hist.groupBy("node", "feature").agg((F.min("bin") - 1).alias("bin")).where(F.col("bin") >= 0)
    hist = hist.select("node", "feature", "bin", "g", "h").union(under.select("node", "feature", "bin", F.lit(0.0), F.lit(0.0)))
    scan = hist.select("node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(whole).alias("gp"), F.sum("h").over(whole).alias("hp"), F.max("bin").over(whole).alias("last"))
    scan = scan.join(totals, "node").withColumn("gm", F.col("gt") - F.col("gp")).withColumn("hm", F.col("ht") - F.col("hp"))
    return _candidates(scan.where(F.col("bin") < F.col("last")), p, low, high, F.lit(0) if direction is None else direction)


#: Ranges that a feature's values are parted into for the exact method's running sums.
RANGES = 64


def value_stats(cells: DataFrame) -> DataFrame:
    """(node, feature, value, g, h) from cells (node, feature, value, g, h), summed before the shuffle."""
    return cells.groupBy("node", "feature", "value").agg(F.sum(F.col("g").cast("double")).alias("g"), F.sum(F.col("h").cast("double")).alias("h"))


def exact_splits(stats: DataFrame, totals: DataFrame, p: TrainingParams, low: Column | None = None, high: Column | None = None, direction: Column | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Candidates of stats (node, feature, value, g, h): a threshold halfway, in float, between neighbouring values of the node.

    With ranges (feature, bounds), running sums go in two levels, within the ranges of a feature's values and over them, so that no task sorts all values of a feature.
    """
    if ranges is None:
        placed = stats.withColumn("range", F.lit(0))
    else:
        within = F.size(F.filter(F.coalesce("bounds", F.array().cast("array<float>")), lambda b: b < F.col("value")))
        placed = stats.join(F.broadcast(ranges), "feature", "left").withColumn("range", within).drop("bounds")
    # one row for each node, feature and range: the sums before it, and the least value after it
    by = Window.partitionBy("node", "feature").orderBy("range")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("node", "feature")
    per = placed.groupBy("node", "feature", "range").agg(F.sum("g").alias("rg"), F.sum("h").alias("rh"), F.min("value").alias("least"))
    per = per.select("node", "feature", "range", F.coalesce(F.sum("rg").over(before), F.lit(0.0)).alias("g0"), F.coalesce(F.sum("rh").over(before), F.lit(0.0)).alias("h0"), F.sum("rg").over(whole).alias("gp"), F.sum("rh").over(whole).alias("hp"), F.lead("least").over(by).alias("next"))
    order = Window.partitionBy("node", "feature", "range").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    scan = placed.select("node", "feature", "range", "value", F.lead("value").over(order).alias("above"), F.sum("g").over(upto).alias("gr"), F.sum("h").over(upto).alias("hr"))
    scan = scan.join(per, ["node", "feature", "range"]).withColumn("above", F.coalesce("above", "next")).where(F.col("above").isNotNull())
    middle = ((F.col("value").cast("double") + F.col("above").cast("double")) / 2).cast("float")
    scan = scan.select("node", "feature", "value", "above", (F.col("g0") + F.col("gr")).alias("gl"), (F.col("h0") + F.col("hr")).alias("hl"), "gp", "hp", middle.alias("threshold")).join(totals, "node")
    return _candidates(scan.withColumn("gm", F.col("gt") - F.col("gp")).withColumn("hm", F.col("ht") - F.col("hp")), p, low, high, F.lit(0) if direction is None else direction)


def categorical_splits(hist: DataFrame, totals: DataFrame, p: TrainingParams, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Candidates of hist (node, feature, bin, g, h): left is a prefix of the categories by g / (h + lambda), ties by category; missing goes right."""
    ratio = F.col("g") / (F.col("h") + p.reg_lambda)
    order = Window.partitionBy("node", "feature").orderBy("ratio", "bin")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")
    live = hist.where(F.col("h") > 0).withColumn("ratio", ratio)
    scan = live.select("node", "feature", F.row_number().over(order).alias("place"), F.count("*").over(whole).alias("all"), F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.array_sort(F.collect_list("bin").over(upto)).alias("left_set"))
    scan = scan.where(F.col("place") < F.col("all")).join(totals, "node")
    return _candidates(scan.withColumn("gm", F.lit(0.0)).withColumn("hm", F.lit(0.0)), p, low, high, F.lit(0))


def best_splits(candidates: DataFrame, p: TrainingParams, at: str = "bin") -> DataFrame:
    """Each node's candidate of the largest gain over gamma; of equals the first by feature, then place, then missing right."""
    order = Window.partitionBy("node").orderBy(F.desc(F.round("gain", 6)), "feature", at, "default_left")
    good = candidates.where((F.col("gain") > EPS) & (F.col("gain") > p.gamma))
    return good.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def goes_left(value: Column, threshold: Column | float, default_left: Column | bool) -> Column:
    """Numeric routing: below the threshold, missing by default."""
    d = default_left if isinstance(default_left, Column) else F.lit(default_left)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("float")
    return F.when(_missing(value), d).otherwise(value < t)


def in_set(value: Column, categories: list[int], default_left: bool = False) -> Column:
    """Categorical routing: the value cut to a whole number, not under 0, is in the set; unseen ones go right."""
    whole = F.greatest(value.cast("double").cast("long"), F.lit(0))
    return F.when(_missing(value), F.lit(default_left)).otherwise(whole.isin([int(c) for c in categories]))


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def _low(row: Column) -> Column:
    """row modulo 2**31, so that its product with a 32-bit number is a long: ids may be any longs."""
    return F.pmod(row, F.lit(1 << 31))


def row_hash(row: Column, seed: int, turn: int) -> Column:
    """A number under 2**32, the same in every partitioning: multiplicative, so that other engines compute it too."""
    return F.pmod(_low(row) * 2654435761 + (seed * 40503 + turn * 9973 + 12345), F.lit(1 << 32))


def keeps_row(row: Column, ratio: float, seed: int, turn: int, limit: int | None = None) -> Column:
    """Bernoulli sampling by row_hash; limit: keep what is under it instead."""
    if ratio >= 1:
        return F.lit(True)
    return row_hash(row, seed, turn) < (int(ratio * (1 << 32)) if limit is None else limit)


def fold_of(row: Column, folds: int, seed: int = 0) -> Column:
    """A row's fold, by hash."""
    return F.floor(F.pmod(_low(row) * 2654435761 + seed * 40503, F.lit(1 << 32)) / 8).cast("long") % folds


def allowed_features(path: list[int], groups: list[list[int]], n_features: int) -> set[int]:
    """Features that interaction constraints leave for a node whose ancestors split on path."""
    allowed = set(range(n_features))
    for f in path:
        own = set().union(*[g for g in groups if f in g]) if any(f in g for g in groups) else set(range(n_features))
        allowed &= own
    return allowed
