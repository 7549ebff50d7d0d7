"""Quantile cuts and binning as DataFrame operations.

All cuts start from (feature, value) counts, aggregated before any sort, so a feature's values are sorted once each, however many
rows hold them. Running sums over a feature are taken in two levels, within buckets of approximate quantiles and over the
buckets, so that no task sorts a whole feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.folders import shared_dir
from gradloom.plans.kernel import Ragged

#: Buckets that a feature's values are parted into for running sums: a power of two.
BUCKETS = 64


def value_counts(cells: DataFrame, hess: str | None = None, times: str | None = None) -> DataFrame:
    """(feature, value, n, h) from cells (feature, value[, hess][, times: how many rows a cell stands for])."""
    n = F.count("*") if times is None else F.sum(times)
    h = n.cast("double") if hess is None else F.sum(F.col(hess).cast("double"))
    return cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(n.alias("n"), h.alias("h"))


def bucket_of(rows: DataFrame, bounds: str = "bounds", value: str = "value") -> DataFrame:
    """rows with bucket: how many of the BUCKETS - 1 ascending bounds are under the value, by halving."""
    rows, step = rows.withColumn("bucket", F.lit(0)), BUCKETS // 2
    while step:
        rows = rows.withColumn("bucket", F.col("bucket") + F.when(F.get(bounds, F.col("bucket") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return rows


def running(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """counts with upto (rows up to and with the value), hupto, and the feature's total and htotal, for the features of bounds (feature, bounds, total, htotal)."""
    placed = bucket_of(counts.join(F.broadcast(bounds), "feature")).drop("bounds")
    per = placed.groupBy("feature", "bucket").agg(F.sum("n").alias("bn"), F.sum("h").alias("bh"))
    earlier = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("feature", "bucket", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bh").over(earlier), F.lit(0.0)).alias("h0"))
    inside = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(per, ["feature", "bucket"]).select("feature", "value", "n", "h", (F.col("n0") + F.sum("n").over(inside)).alias("upto"), (F.col("h0") + F.sum("h").over(inside)).alias("hupto"), "total", "htotal")


def quantile_cuts(counts: DataFrame, max_bin: int, weighted: bool = False) -> DataFrame:
    """(feature, cut, sentinel): ascending cuts of each feature.

    With at most max_bin distinct values each is a cut. Else cut b of 1 .. max_bin - 1 is the value that holds rank
    max(ceil(b / max_bin * n), 1); weighted by hessians, the first value whose running sum reaches b / max_bin of the total. The sentinel is the
    next number above the largest value where no cut lies above it.

    counts is stored in the checkpoint folder, since it is read several times; only features of many values are summed up, and only their bounds (BUCKETS numbers for each) go through the driver:
    approximate quantiles may differ when computed again, and two uses of them must agree.
    """
    spark = counts.sparkSession
    shared_dir(spark)
    counts = counts.checkpoint(eager=True)
    sizes = counts.groupBy("feature").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), F.sum("h").alias("htotal"), F.max("value").alias("top"))
    grid = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    large = sizes.where(F.col("distinct") > max_bin).select("feature", "total", "htotal")
    found = counts.join(large.select("feature"), "feature", "left_semi").groupBy("feature").agg(F.percentile_approx("value", grid, F.lit(20 * BUCKETS)).alias("bounds")).join(large, "feature")
    bounds = spark.createDataFrame(found.collect(), found.schema)
    r = running(counts, bounds)
    if weighted:
        by_rank = F.floor((F.col("upto")) * max_bin / F.col("total"))
        high = F.when(F.col("htotal") > 0, F.floor((F.col("hupto") + 1e-12) / F.col("htotal") * max_bin)).otherwise(by_rank)
        low = F.when(F.col("htotal") > 0, F.floor((F.col("hupto") - F.col("h") + 1e-12) / F.col("htotal") * max_bin)).otherwise(F.floor((F.col("upto") - F.col("n")) * max_bin / F.col("total")))
    else:
        # ceil(b * n / m) <= upto exactly if b <= floor(upto * m / n)
        high = F.floor(F.col("upto") * max_bin / F.col("total"))
        low = F.floor((F.col("upto") - F.col("n")) * max_bin / F.col("total"))
    takes = F.least(high, F.lit(max_bin - 1)) > low
    few = counts.join(F.broadcast(bounds.select("feature")), "feature", "left_anti").select("feature", "value")
    cut = few.union(r.where(takes).select("feature", "value")).select("feature", F.col("value").alias("cut"), F.lit(False).alias("sentinel"))
    return cut.union(sizes.select("feature", next_up(F.col("top")).alias("cut"), F.lit(True).alias("sentinel")))


def next_up(v: Column) -> Column:
    """The next float above v."""
    x = v.cast("double")
    # the unit in the last place of a float of this exponent; subnormals share the smallest
    exponent = F.floor(F.log2(F.greatest(F.abs(x), F.lit(2.0**-126))))
    exponent = F.when(F.pow(F.lit(2.0), exponent) > F.greatest(F.abs(x), F.lit(2.0**-126)), exponent - 1).otherwise(exponent)
    exponent = F.when(F.pow(F.lit(2.0), exponent + 1) <= F.abs(x), exponent + 1).otherwise(exponent)
    below_power = (x < 0) & (F.pow(F.lit(2.0), exponent) == -x) & (exponent > -126)
    step = F.pow(F.lit(2.0), F.when(below_power, exponent - 1).otherwise(exponent) - 23)
    return F.when(x == 0, F.lit(2.0**-149)).otherwise(x + step).cast("float")


def categorical_cuts(counts: DataFrame) -> DataFrame:
    """(feature, cut, sentinel): the ascending distinct values, no sentinel."""
    return counts.select("feature", F.col("value").alias("cut"), F.lit(False).alias("sentinel"))


def collect_cuts(cuts: DataFrame, n_features: int) -> Ragged:
    """Each feature's cuts, at most max_bin of them, on the driver; a feature without values has the cut 0."""
    got = cuts.select("feature", "cut").toArrow()
    none = np.arange(n_features)  # a cut for each feature, taken out again where there are others
    feature, cut = np.append(got["feature"].to_numpy(), none).astype(np.int64), np.append(got["cut"].to_numpy().astype(np.float32), np.zeros(n_features, np.float32))
    made = np.append(np.zeros(len(feature) - n_features, bool), np.ones(n_features, bool))
    order = np.lexsort((made, cut, feature))
    feature, cut, made = feature[order], cut[order], made[order]
    counts = np.bincount(feature, ~made, n_features)
    keep = ~made | (counts[feature] == 0)
    keep[1:] &= ~((feature[1:] == feature[:-1]) & (cut[1:] == cut[:-1]) & ~made[:-1])
    feature, cut = feature[keep], cut[keep]
    return Ragged(cut, np.searchsorted(feature, np.arange(n_features + 1)))


def bin_of(value: Column, cuts: np.ndarray, categorical: bool = False) -> Column:
    """The bin of a value: how many cuts are at most it, not over the last bin; categories by equality, unseen ones bin 0; null stays null."""
    a = F.array(*[F.lit(float(c)) for c in cuts])
    v = value.cast("double")
    if categorical:
        found = F.greatest(F.array_position(a, v).cast("int") - 1, F.lit(0))
    else:
        found = F.least(F.size(F.filter(a, lambda c: c <= v)), F.lit(len(cuts) - 1))
    return F.when(value.isNotNull(), found)


def bin_cells(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """(…cells, bin) with the cuts as a table: each feature's cuts as one array, bounded by max_bin."""
    arrays = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("cut")).alias("_cuts"))
    at = F.least(F.size(F.filter("_cuts", lambda c: c <= F.col("value"))), F.size("_cuts") - 1)
    return cells.join(arrays, "feature").withColumn("bin", at).drop("_cuts")
