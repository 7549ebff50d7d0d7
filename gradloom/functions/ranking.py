"""LambdaMART gradients: pairs within a query, weighted by what swapping them would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.errors import UnknownName

MIN_HESS = 1e-16
#: Pairs of a query; of a query with more, so many are drawn.
MAX_PAIRS = 4096


def lambda_gradients(rows: DataFrame, kind: str, qid: str = "qid", row: str = "row_id", margin: str = "margin", label: str = "label", weight: str | None = None, max_pairs: int | None = MAX_PAIRS, seed: int = 0) -> DataFrame:
    """(row, g, h) for every row. kind is pairwise, ndcg or map; ties in score rank by row.

    A query of at most max_pairs pairs joins itself. In a larger one, its rows draw max_pairs partners between them by hash of seed and rank,
    the same in every round, and join those: each pair is drawn equally often on average, and no more rows are made.
    None joins every query to itself. Each side's sums are taken before their shuffle.
    """
    if kind not in ("pairwise", "ndcg", "map"):
        raise UnknownName(f"ranking objective {kind}")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    base = rows.select(F.col(qid).alias("q"), F.col(row).alias("r"), F.col(margin).cast("double").alias("m"), F.col(label).cast("double").alias("y"), w.alias("w"))
    by_score = Window.partitionBy("q").orderBy(F.desc("m"), F.asc("r"))
    one = Window.partitionBy("q")
    ranked = base.withColumn("pos", F.row_number().over(by_score) - 1)
    if kind == "ndcg":
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("y"), F.asc("r"))) - 1
        ideal = F.sum(_gain(F.col("y")) * _discount(F.col("best"))).over(one)
        ranked = ranked.withColumn("best", best).withColumn("ideal", ideal)
    elif kind == "map":
        rel = (F.col("y") > 0).cast("double")
        upto = by_score.rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.withColumn("rel", rel).withColumn("hits", F.sum("rel").over(upto)).withColumn("part", F.sum(F.col("rel") / (F.col("pos") + 1)).over(upto)).withColumn("total", F.sum("rel").over(one))
    hi, lo = (F.struct(*[F.col(f"{side}.{c}") for c in ranked.columns]).alias(side) for side in ("hi", "lo"))
    if max_pairs is None:
        small, drawn = ranked, None
    else:
        sized = ranked.withColumn("n", F.count("*").over(one)).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("r")).cast("long") - 1)
        many = F.col("n") * (F.col("n") - 1) / 2 > max_pairs
        small, drawn = sized.where(~many), sized.where(many)
    pairs = small.alias("hi").join(small.alias("lo"), (F.col("hi.q") == F.col("lo.q")) & (F.col("hi.y") > F.col("lo.y"))).select(hi, lo)
    if drawn is not None:
        pairs = pairs.union(_drawn(drawn, ranked.columns, max_pairs, seed))
    delta = _delta(kind)
    rho = 1.0 / (1.0 + F.exp(F.col("hi.m") - F.col("lo.m")))
    g = rho * F.col("d")
    h = F.greatest(rho * (1.0 - rho) * F.col("d"), F.lit(MIN_HESS))
    weighed = pairs.withColumn("d", delta).where(F.col("d") != 0).select(F.col("hi.r").alias("a"), F.col("lo.r").alias("b"), g.alias("g"), h.alias("h"))
    each = weighed.select(F.col("a").alias("r"), (-F.col("g")).alias("g"), "h").union(weighed.select(F.col("b").alias("r"), "g", "h"))
    sums = each.groupBy("r").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    full = base.select("r", "w").join(sums, "r", "left")
    return full.select(F.col("r").alias(row), (F.coalesce("g", F.lit(0.0)) * F.col("w")).cast("float").alias("g"), (F.coalesce("h", F.lit(0.0)) * F.col("w")).cast("float").alias("h"))


def _drawn(rows: DataFrame, columns: list[str], max_pairs: int, seed: int) -> DataFrame:
    """(hi, lo) of rows (columns, n of the query, rank in it): max_pairs draws of each query, those of unlike labels."""
    rank, n = F.col("rank"), F.col("n")
    times = F.floor((rank + 1) * max_pairs / n) - F.floor(rank * max_pairs / n)
    turned = rows.withColumn("times", times.cast("int")).where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    word = F.lit((1 << 32) - 1)
    v = (rank * 2654435761 + F.col("turn") * 40503 + (seed % (1 << 20) * 9973 + 12345)).bitwiseAND(word)
    for _ in range(2):
        v = (v.bitwiseXOR(F.shiftright(v, 16)) * 73244475).bitwiseAND(word)
    partner = (rank + 1 + v.bitwiseXOR(F.shiftright(v, 16)) % (n - 1)) % n
    own = turned.select("q", partner.alias("partner"), F.struct(*columns).alias("own"))
    other = rows.select(F.col("q").alias("oq"), "rank", F.struct(*columns).alias("other"))
    met = own.join(other, (F.col("q") == F.col("oq")) & (F.col("partner") == F.col("rank"))).where(F.col("own.y") != F.col("other.y"))
    over = F.col("own.y") > F.col("other.y")
    return met.select(F.when(over, F.col("own")).otherwise(F.col("other")).alias("hi"), F.when(over, F.col("other")).otherwise(F.col("own")).alias("lo"))


def _gain(y: Column) -> Column:
    return F.pow(F.lit(2.0), y) - 1


def _discount(pos: Column) -> Column:
    return 1.0 / F.log2(pos + 2.0)


def _delta(kind: str) -> Column:
    """What swapping hi and lo changes."""
    if kind == "pairwise":
        return F.lit(1.0)
    if kind == "ndcg":
        change = F.abs((F.pow(F.lit(2.0), F.col("hi.y")) - F.pow(F.lit(2.0), F.col("lo.y"))) * (_discount(F.col("hi.pos")) - _discount(F.col("lo.pos"))))
        return F.when(F.col("hi.ideal") > 0, change / F.col("hi.ideal")).otherwise(0.0)
    # Average precision before and after: only the two and the relevant rows between them change.
    up = F.col("hi.pos") < F.col("lo.pos")
    pick = lambda c, first: F.when(up == F.lit(first), F.col(f"hi.{c}")).otherwise(F.col(f"lo.{c}"))
    first, last = (lambda c: pick(c, True)), (lambda c: pick(c, False))
    # part counts hits / place only in the sums below, so write the sum of 1 / place over relevant rows strictly between
    between = last("part") - first("part") - last("rel") / (last("pos") + 1)
    before = first("rel") * first("hits") / (first("pos") + 1) + last("rel") * last("hits") / (last("pos") + 1)
    shift = last("rel") - first("rel")
    after = last("rel") * (first("hits") + shift) / (first("pos") + 1) + first("rel") * last("hits") / (last("pos") + 1)
    change = F.abs(after - before + shift * between) / F.col("hi.total")
    return F.when(((F.col("hi.rel") == 1) & (F.col("lo.rel") == 0)) & (F.col("hi.total") > 0), change).otherwise(0.0)
