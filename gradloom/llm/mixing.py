"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate, how often the mix takes it. Among all rates from 0 to 2 that meet the
sources' token constraints sum(size * rate) = target, the mix has those of least relative entropy to
1: rate = min(2, exp(lambda * size / mean size)), one lambda for each source. Newton's method on the convex dual finds
the lambdas, all sources at once, over the counts by source and size, which say all that the dual
needs; a bracket guards each step. Rates then become whole copies from a source's largest size to its
smallest, carrying what rounding leaves over, so that a source's words miss its target by a few words. All
sums over rows are of whole numbers, so neither partitioning nor order changes a result.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating; they share 150 % of all
words. None takes over twice its words; the excess is shared again by weight until none does.

Defined results: a null or empty text has size 0, rate 1 and is taken for 0 words. Rows that
repeat are documents of their own. An empty table gives an empty mix. Other columns are kept by
`mixed_documents` and otherwise never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm._shared import cut, whole

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rates are whole multiples of 2**-ONE.
ONE = 30
#: Documents of one source and size are ranked in groups of about so many.
GROUP = 1000
STEPS = 60
CLOSE = 1e-7
#: Sums of words are of whole parts of a word, this many.
FINE = float(1 << 24)
LN_MOST = math.log(MOST)


def size_of(text: str) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A source is full if the water level (words per weight) reaches MOST * its words / its weight. In the order
    # of that ratio the full ones come first: the k-th is full if sharing what is left after k - 1 fills it.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("rank", rank).withColumn("weight", weight).withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    along = Window.orderBy("ratio", "rank")
    after = along.rowsBetween(0, Window.unboundedFollowing)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * TOTAL
    left = total - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    by = by.withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level_left"))
    return by.withColumn("level_left", level).select("source", "source_size", target.alias("target"))


def rates(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, n, rate as a multiple of 2**-ONE) from counts (source, size, n) and targets()."""
    words = F.col("size").cast("double")
    per = counts.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("filled"))
    g, p = goals.alias("g"), per.alias("p")
    mean = F.greatest(F.col("g.source_size") / F.greatest(F.col("p.filled"), F.lit(1)), F.lit(1.0))
    state = g.join(p, F.col("g.source").eqNullSafe(F.col("p.source"))).select(
        "g.source", "g.source_size", "g.target", mean.alias("mean"),
        # at the upper bound a document of one word is taken MOST times, at the lower one hardly ever
        F.lit(0.0).alias("lam"), (-40.0 * mean).alias("low"), (LN_MOST * mean + 1.0).alias("high"),
        # nothing to balance: no words, or every document twice
        ((F.col("g.source_size") == 0) | (F.col("g.target") >= MOST * F.col("g.source_size"))).alias("done"),
    )
    state = cut(state)
    limit = LN_MOST
    for _ in range(STEPS):
        s, c = state.alias("s"), counts.alias("c")
        x = F.least(F.col("s.lam") * words / F.col("s.mean"), F.lit(limit))
        scaled = lambda v: F.sum(F.round(v * F.col("c.n") * FINE).cast("decimal(38,0)"))
        free = F.when(x < limit, F.exp(x) * words * words / F.col("s.mean")).otherwise(0.0)
        sums = (
            c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")) & ~F.col("s.done"))
            .groupBy(F.col("s.source").alias("source"))
            .agg((scaled(F.exp(x) * words).cast("double") / FINE).alias("got"), (scaled(free).cast("double") / FINE).alias("curve"))
        )
        m = sums.alias("m")
        joined = s.join(m, F.col("s.source").eqNullSafe(F.col("m.source")), "left")
        got, goal, lam = F.coalesce(F.col("m.got"), F.col("s.target")), F.col("s.target"), F.col("s.lam")
        low = F.when(got < goal, lam).otherwise(F.col("s.low"))
        high = F.when(got > goal, lam).otherwise(F.col("s.high"))
        newton = lam + (goal - got) / F.greatest(F.coalesce(F.col("m.curve"), F.lit(0.0)), F.lit(1e-12))
        # for an exponential sum the step on the logarithm is the better one below the goal
        newton = F.when((got > 0) & (F.col("m.curve") > 0), lam + got * F.ln(goal / got) / F.col("m.curve")).otherwise(newton)
        inside = (newton > low) & (newton < high)
        step = F.round(F.when(inside, newton).otherwise((low + high) / 2), 12)
        close = (F.abs(got - goal) <= CLOSE * goal) | (step == lam)
        state = cut(
            joined.select(
                "s.source", "s.source_size", "s.target", "s.mean",
                F.when(F.col("s.done") | close, lam).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), (F.col("s.done") | close).alias("done"),
            )
        )
        if not state.where(~F.col("done")).limit(1).count():
            break
    c, s = counts.alias("c"), state.alias("s")
    full = (F.col("s.target") >= MOST * F.col("s.source_size")) & (F.col("s.source_size") > 0)
    rate = F.when(full, F.lit(float(MOST))).otherwise(F.exp(F.least(F.col("s.lam") * words / F.col("s.mean"), F.lit(limit))))
    return c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "c.size", "c.n", "s.source_size", "s.target", F.least(F.round(rate * float(1 << ONE)), F.lit(float(MOST << ONE))).cast("long").alias("rate"))


def _extra(done: Column, at: Column) -> Column:
    """One step along the sizes: (words still owed, extra copies by size in this stretch, those of the stretches before)."""
    size = at["size"].cast("double")
    owed = (at["rate"] % (1 << ONE)) / float(1 << ONE) * at["n"] * size + done["carry"]
    extra = F.when(size > 0, F.least(F.greatest(F.round(owed / size), F.lit(0.0)), at["n"].cast("double"))).otherwise(F.lit(0.0))
    return F.struct((owed - extra * size).alias("carry"), F.concat(done["extra"], F.array(extra.cast("long"))).alias("extra"), done["before"].alias("before"))


def _extras(sizes: str) -> Column:
    """The extra copies of each of the sizes (size, n, rate), from the first on.

    An array is copied as it grows; so stretches as long as the root of all are filled one by one.
    """
    long = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / long).cast("int")), lambda i: F.slice(sizes, i * long + 1, long))
    none = F.array().cast("array<bigint>")
    fill = lambda done, stretch: F.aggregate(
        stretch,
        F.struct(done["carry"].alias("carry"), none.alias("extra"), done["before"].alias("before")),
        _extra,
        lambda end: F.struct(end["carry"].alias("carry"), F.concat(end["before"], F.array(end["extra"])).alias("before")),
    )
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<array<bigint>>").alias("before"))
    return F.flatten(F.aggregate(stretches, start, fill, lambda end: end["before"]))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source, source_size, target, copies) for each row of docs."""
    sized = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size")))
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    rated = rates(counts, targets(counts.select("source", (F.col("size") * F.col("n")).alias("size"))))
    # Whole copies for all, then the fractions: from the largest size down, each size gets the extra copies that bring the
    # words so far closest to what the rates ask for; the smallest documents settle what is left.
    listed = rated.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("sizes"))
    plan = (
        listed.withColumn("extra", _extras("sizes"))
        .select("source", "source_size", "target", F.explode(F.arrays_zip("sizes", "extra")).alias("z"))
        .select("source", "z.sizes.size", "z.sizes.n", "source_size", "target", F.shiftright("z.sizes.rate", ONE).alias("base"), "z.extra", F.ceil(F.col("z.sizes.n") / GROUP).cast("long").alias("groups"))
    )
    plan = cut(plan)
    p, d = plan.alias("p"), sized.alias("d")
    same = F.col("p.size").eqNullSafe(F.col("d.size")) & F.col("p.source").eqNullSafe(F.col("d.source"))
    dealt = d.join(p, same).select("d.key", "d.size", "d.source", "p.source_size", "p.target", "p.base", "p.extra", "p.n", F.xxhash64("d.key").alias("at"), F.pmod(F.xxhash64(F.col("d.key"), F.lit(1)), F.col("p.groups")).alias("group"))
    # The extra copies of a size go to its groups in proportion to their documents, again by running sums.
    per = dealt.where(F.col("extra") > 0).groupBy("source", "size", "group", "n", "extra").agg(F.count("*").alias("m"))
    run = F.sum("m").over(Window.partitionBy("source", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.floor((x.cast("decimal(20,0)") * F.col("extra")) / F.col("n")).cast("long")
    quota = per.withColumn("run", run).select("source", "size", "group", (share(F.col("run")) - share(F.col("run") - F.col("m"))).alias("quota"))
    q, e = quota.alias("q"), dealt.alias("e")
    match = F.col("q.source").eqNullSafe(F.col("e.source")) & F.col("q.size").eqNullSafe(F.col("e.size")) & F.col("q.group").eqNullSafe(F.col("e.group"))
    place = F.row_number().over(Window.partitionBy("source", "size", "group").orderBy("at", "key"))
    ranked = e.join(q, match, "left").select("e.*", F.coalesce("q.quota", F.lit(0)).alias("quota")).withColumn("place", place)
    copies = F.col("base") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)
    return ranked.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    # Rows of one key may have several counts only if the key repeats; they then share out the sum.
    same = ["key", "source", "size"]
    per = mix(docs, key, text, source).select(F.col(key).alias("key"), F.col(source).alias("source"), "size", "copies").groupBy(*same).agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    # The columns of docs stay together in one, so that no name of theirs meets one of ours.
    d, p = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("hash"), whole(docs).alias("doc")).alias("d"), per.alias("p")
    each = d.join(p, F.col("d.key").eqNullSafe(F.col("p.key")) & F.col("d.source").eqNullSafe(F.col("p.source")) & F.col("d.size").eqNullSafe(F.col("p.size"))).select("d.*", "p.all", "p.rows")
    once = each.where("rows = 1").select("doc", F.col("all").alias("n"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy("hash"))
    share = lambda x: F.floor(x * F.col("all") / F.col("rows"))
    many = each.where("rows > 1").withColumn("place", place).select("doc", (share(F.col("place")) - share(F.col("place") - 1)).alias("n"))
    taken = once.union(many).where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return taken.select("doc.*")
