"""Running sums over all rows in two levels, so that no task sorts or reads more than its bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of about equally many rows that a table is cut into.
BUCKETS = 200


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """rows with bucket: which of about BUCKETS ranges of key they are in; equal keys share one. Only the bounds go through the driver."""
    kind = rows.schema[key].dataType
    grid = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = rows.agg(F.percentile_approx(key, F.array(*[F.lit(p) for p in grid]), F.lit(10 * BUCKETS))).collect()[0][0] or []
    at = F.lit(0)
    if bounds:
        limits = F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds))])
        at = F.size(F.filter(limits, lambda b: b < F.col(key)))
    return rows.withColumn("bucket", at)


def running_sums(rows: DataFrame, key: str, sums: dict[str, str | Column], ascending: bool = True, order: list[Column] | None = None) -> DataFrame:
    """rows with, for each name in sums, the sum of its column up to and with the row in order of key (then of `order`)."""
    placed = bucketed(rows, key)
    of = {n: F.sum(F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    by = F.col("bucket") if ascending else -F.col("bucket")
    # A row for each bucket: their running sums are over BUCKETS rows.
    earlier = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("bucket").agg(*[c.alias(f"own_{n}") for n, c in of.items()])
    per = per.select("bucket", *[F.coalesce(F.sum(f"own_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in of])
    first = F.col(key).asc() if ascending else F.col(key).desc()
    inside = Window.partitionBy("bucket").orderBy(first, *(order or [])).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(F.broadcast(per), "bucket")
    for n, c in of.items():
        found = found.withColumn(n, F.col(f"before_{n}") + c.over(inside))
    return found.drop("bucket", *[f"before_{n}" for n in of])
