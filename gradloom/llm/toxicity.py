"""Toxicity: a convolutional text classifier on hashed word embeddings.

Words (runs of letters, digits and characters beyond ASCII; A-Z lower-cased) are hashed to `BUCKETS`
buckets, of which those seen in at least two learnt texts have an embedding. Filters of widths 1, 2 and 3
slide over the embeddings, the largest response of each filter over the whole text is kept, and a
logistic layer joins them; embeddings start from each word's association with the label. On rows kept back
from training (a quarter, by hash of the key), a logistic curve calibrates the score to the label's frequency,
and each language gets the threshold of best F1 there (0.5 where it has fewer than `LEAST` toxic rows).

Nothing is sampled: every labelled row is trained on or kept back, in each of `EPOCHS` passes. A pass is a job: each
task takes Adagrad steps over its rows (about `PART` bytes of text) from the weights of the pass before, and
the tasks' changes are averaged, those of a word's embedding over the tasks that have changed it. The weights of the least loss on the rows
kept back stay. What the driver holds is the network: 8 numbers for each of at most `BUCKETS` words, with as many for Adagrad.

Defined results: a null or empty text, or one without words, scores like a text of unknown words. Labels other
than 0 and 1 are ignored; without labels of both kinds every score is 0. Repeated rows get
equal scores. The language serves only to look up the threshold; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from gradloom.llm import _text
from gradloom.llm._shared import cut, labelled, summed

BUCKETS = 1 << 22
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
LEAST = 20
#: Bytes of text scored at once.
PIECE = 1 << 17
#: Words of learnt texts scored at once.
WORDS = 1 << 15
EPOCHS = 8
#: Bytes of learnt text, and learnt rows, in a task of a pass.
PART, PART_ROWS = 1 << 25, 1 << 14
#: Bits of the field of labelled keys' hashes.
BITS = 1 << 24
_N = FILTERS * len(WIDTHS)


def bucket_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, buckets of their words) of a plain() array."""
    _, off, _, _, h = _text.words(texts, _text.PUNCT, lower=True)
    return off, (h & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Network:
    """known: sorted buckets; embed has a row for each and row 0, all zeros, for the rest. conv[w][k]: DIM x FILTERS at offset k."""

    known: np.ndarray
    embed: np.ndarray
    conv: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.zeros(BUCKETS, np.int32)
            table[self.known] = np.arange(1, len(self.known) + 1)
            self.__dict__["_table"] = table
        return table[buckets]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def pooled(self, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest response of each filter per text, all responses, starts of the texts among them).

        Each text is followed by as many zero rows as the widest filter is wide, less one; a window that
        starts there counts as one of unknown words.
        """
        reach = max(WIDTHS) - 1
        n = len(off) - 1
        at = np.arange(len(rows)) + reach * _text.owner(off)
        padded = np.zeros(len(rows) + reach * n, np.int32)
        padded[at] = rows
        e = self.embed[padded].astype(np.float32)
        by = [np.hstack([self.conv[w][k] for w in range(len(WIDTHS)) if WIDTHS[w] > k]).astype(np.float32) for k in range(max(WIDTHS))]
        z = e @ by[0]
        for k in range(1, max(WIDTHS)):
            first = FILTERS * sum(w <= k for w in WIDTHS)
            z[: len(z) - k, first:] += e[k:] @ by[k]
        starts = off[:-1] + reach * np.arange(n)
        for k in range(reach):
            z[off[1:] + reach * np.arange(n) + k] = 0.0
        z += self.bias.astype(np.float32)
        return np.maximum(np.maximum.reduceat(z, starts, axis=0), 0.0) if n else np.zeros((0, _N), np.float32), z, starts

    def margin(self, texts: pa.Array) -> np.ndarray:
        texts = _text.plain(texts)
        found = [np.zeros(0)]
        for a, b in _text.slices(texts, PIECE):
            off, buckets = bucket_ids(texts.slice(a, b - a))
            found.append(self.pooled(off, self.rows(buckets))[0].astype(np.float64) @ self.out + self.out_bias)
        return np.concatenate(found)

    def margins(self, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of texts given by the embedding rows of their words, some at a time."""
        found, at = [np.zeros(0)], 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + WORDS, "right")) - 1)
            found.append(self.pooled(off[at : to + 1] - off[at], rows[off[at] : off[to]])[0].astype(np.float64) @ self.out + self.out_bias)
            at = to
        return np.concatenate(found)

    def score(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(texts) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def start(known: np.ndarray, df: np.ndarray, pos: np.ndarray, p: int, n: int, seed: int = 1) -> Network:
    """A network whose first embedding dimension is a careful estimate of each word's association with the label.

    df and pos: texts, and toxic texts, that have the word, of p toxic texts and n others.
    """
    p, n = max(1, p), max(1, n)
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((df - pos + 0.5) / (n + 1))
    spread = np.sqrt(1 / (pos + 0.5) + 1 / (df - pos + 0.5))
    rng = np.random.default_rng(seed)
    embed = np.zeros((len(known) + 1, DIM), np.float32)
    embed[1:, 1:] = rng.normal(0, 0.05, (len(known), DIM - 1))
    embed[1:, 0] = np.sign(odds) * np.maximum(np.abs(odds) - 2 * spread, 0)
    conv = [[rng.normal(0, 0.1, (DIM, FILTERS)) for _ in range(w)] for w in WIDTHS]
    conv[0][0][:, 0] = np.eye(DIM)[0]
    out = rng.normal(0, 0.05, _N)
    out[0] = 2.0
    bias = np.zeros(_N)
    bias[0] = -0.5
    return Network(known, embed, conv, bias, out, -2.0)


def _dense(net: Network, squares: dict) -> np.ndarray:
    """What all tasks change, in one vector."""
    return np.concatenate([*[k.ravel() for c in net.conv for k in c], net.bias, net.out, [net.out_bias], *[k.ravel() for c in squares["conv"] for k in c], squares["bias"], squares["out"]])


def _set_dense(net: Network, squares: dict, v: np.ndarray) -> None:
    at = 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return v[at - n : at].copy()

    def filters() -> list[list[np.ndarray]]:
        return [[take(DIM * FILTERS).reshape(DIM, FILTERS) for _ in range(w)] for w in WIDTHS]

    net.conv, net.bias, net.out, net.out_bias = filters(), take(_N), take(_N), float(take(1)[0])
    squares["conv"], squares["bias"], squares["out"] = filters(), take(_N), take(_N)


def descend(net: Network, squares: dict, off: np.ndarray, rows: np.ndarray, y: np.ndarray, learn: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.05, l2: float = 1e-4) -> None:
    """One pass of Adagrad over the texts `learn`, in place."""
    width_of = np.repeat(range(len(WIDTHS)), FILTERS)
    reach = max(WIDTHS) - 1

    def gathered(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = off[docs + 1] - off[docs]
        o = np.append(0, np.cumsum(size))
        return o, rows[np.repeat(off[docs] - o[:-1], size) + np.arange(o[-1])]

    def step(x: np.ndarray, s: np.ndarray, dx: np.ndarray) -> None:
        s += dx * dx
        x -= rate * dx / np.sqrt(s)

    for docs in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
        if not len(docs):
            continue
        o, r = gathered(docs)
        pooled, z, starts = net.pooled(o, r)
        n = len(docs)
        g = (_sigmoid(pooled @ net.out + net.out_bias) - y[docs]) / n
        top = np.empty((n, _N), np.int64)
        ends = np.append(starts[1:], len(z))
        for i in range(n):
            top[i] = z[starts[i] : ends[i]].argmax(0) + starts[i]
        padded = np.zeros(len(z) + reach, np.int32)
        padded[np.arange(len(r)) + reach * _text.owner(o)] = r
        inside = np.zeros(len(z) + reach, bool)
        inside[np.arange(len(r)) + reach * _text.owner(o)] = True
        back = g[:, None] * net.out * (pooled > 0)  # to each filter's best window
        d_embed: dict[str, list] = {"at": [], "by": []}
        for w, width in enumerate(WIDTHS):
            cols = np.flatnonzero(width_of == w)
            t, b = top[:, cols], back[:, cols] * inside[top[:, cols]]
            for k in range(width):
                at = padded[t + k]
                x = net.embed[at]  # n x FILTERS x DIM
                d_embed["at"].append(at.ravel())
                d_embed["by"].append((b[:, :, None] * net.conv[w][k].T[None]).reshape(-1, DIM))
                step(net.conv[w][k], squares["conv"][w][k], np.einsum("nf,nfd->df", b, x) + l2 * net.conv[w][k])
        step(net.bias, squares["bias"], back.sum(0))
        step(net.out, squares["out"], g @ pooled + l2 * net.out)
        net.out_bias -= rate * float(g.sum())
        at, index = np.unique(np.concatenate(d_embed["at"]), return_inverse=True)
        de = np.zeros((len(at), DIM))
        np.add.at(de, index, np.concatenate(d_embed["by"]))
        de[at == 0] = 0  # unknown words stay at zero
        squares["embed"][at] += de * de
        net.embed[at] -= rate * de / np.sqrt(squares["embed"][at])


def _part(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, labels, whether kept back) of a partition of learnt rows."""
    found = [(b.column("ids").value_lengths().to_numpy(zero_copy_only=False), b.column("ids").flatten().to_numpy(), b.column("label").to_numpy(), b.column("check").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not found:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    size, buckets, y, check = (np.concatenate(c) for c in zip(*found, strict=True))
    return np.append(0, np.cumsum(size, dtype=np.int64)), buckets, y.astype(np.int64), check


def learnt_rows(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(ids: buckets of the words, label, lang, order, check: kept back from training) of all labelled texts, in partitions of about PART bytes of text."""
    own = labelled(labels, "toxic", learn, key)
    all_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).collect()[0]
    n = own.count()
    parts = max(1, -(-n // PART_ROWS), int(-(-size * n // (max(1, all_docs) * PART))))

    bits = labelled_bits(own, key)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bits.value[batch.column("order").to_numpy() & (BITS - 1)]))
            texts = _text.plain(batch.column(0))
            for a, b in _text.slices(texts):
                off, buckets = bucket_ids(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (1, 2, 3)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(buckets))], ["key", "lang", "order", "ids"])

    given = docs.where(F.col(key).isNotNull()).select(F.col(text).alias("_text"), F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("order"))
    rows = given.mapInArrow(extract, given.select("key", "lang", "order").schema.add("ids", ArrayType(IntegerType())))
    # Merged by key at any size: the labels grow with the table and are never broadcast.
    joined = rows.join(own.withColumnRenamed(key, "key").hint("merge"), "key").repartition(parts, "order")
    return joined.sortWithinPartitions("order", F.xxhash64("ids")).select("ids", "label", "lang", "order", (F.pmod("order", F.lit(4)) == 3).alias("check"))


def labelled_bits(own: DataFrame, key: str) -> Broadcast:
    """A field of BITS booleans, true at the key hashes of own: rows elsewhere have no label and needn't be shuffled.

    Its size is fixed: many labels fill it, and it prunes less, never wrongly.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    maps = own.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).where("b is not null").collect()
    field = np.zeros(BITS // 8, np.uint8)
    for r in maps:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        field[(r["b"] - 1) * len(m) : r["b"] * len(m)] = m
    return own.sparkSession.sparkContext.broadcast(np.unpackbits(field, bitorder="little").astype(bool))


def first_network(rows: DataFrame) -> Network:
    """start() with the words of all rows that aren't kept back."""

    def add(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        off, buckets, y, check = _part(batches)
        doc = _text.owner(off)
        use = ~check[doc]
        pair = np.unique(buckets[use].astype(np.int64) * (len(y) + 1) + doc[use])
        known, index = np.unique(pair // (len(y) + 1), return_inverse=True)
        return known, np.stack([np.bincount(index, minlength=len(known)), np.bincount(index, y[pair % (len(y) + 1)], minlength=len(known))], 1)

    known, sums = summed(rows, add, 2, least=2)
    counts = {r["label"]: r["count"] for r in rows.where("not check").groupBy("label").count().collect()}
    return start(known, sums[:, 0], sums[:, 1], counts.get(1, 0), counts.get(0, 0))


def train(rows: DataFrame, net: Network, epochs: int = EPOCHS, seed: int = 2) -> Network:
    """Passes over the rows that aren't kept back; the state of least loss on those kept back is returned."""
    sc, width = rows.sparkSession.sparkContext, 2 * DIM + 1
    squares = {"embed": np.full_like(net.embed, 1e-2), "bias": np.full(_N, 1e-2), "out": np.full(_N, 1e-2), "conv": [[np.full((DIM, FILTERS), 1e-2) for _ in c] for c in net.conv]}
    best, best_loss = None, np.inf
    for epoch in range(epochs + 1):
        held = sc.broadcast((net, squares))

        def add(batches: Iterator[pa.RecordBatch], held: Broadcast = held, epoch: int = epoch) -> tuple[np.ndarray, np.ndarray]:
            whole, old = held.value
            off, buckets, y, check = _part(batches)
            words, index = np.unique(buckets, return_inverse=True)
            at = np.minimum(np.searchsorted(whole.known, words), max(0, len(whole.known) - 1))
            row = np.where(whole.known[at] == words, at + 1, 0) if len(whole.known) else np.zeros(len(words), np.int64)
            own, local = np.unique(np.append(0, row), return_inverse=True)  # row 0 comes first
            rows_ = local[1:][index].astype(np.int32)
            mine = Network(own, whole.embed[own].astype(np.float64), whole.conv, whole.bias, whole.out, whole.out_bias)
            state = {"embed": old["embed"][own].astype(np.float64), "conv": old["conv"], "bias": old["bias"], "out": old["out"]}
            before = _dense(mine, state)
            _set_dense(mine, state, before)  # copies: the broadcast stays as it is
            size = np.diff(off)
            kept = np.flatnonzero(check)
            p = np.clip(_sigmoid(mine.margins(np.append(0, np.cumsum(size[kept])), rows_[np.repeat(check, size)])), 1e-7, 1 - 1e-7)
            loss = -np.where(y[kept] == 1, np.log(p), np.log(1 - p)).sum()
            learn = np.flatnonzero(~check)
            keys, values = [np.array([-1])], [np.pad([loss, len(kept), len(learn)], (0, width - 3))[None]]
            if epoch < epochs and len(learn):
                embed, sq = mine.embed.copy(), state["embed"].copy()
                descend(mine, state, off, rows_, y, learn, np.random.default_rng((seed, epoch, TaskContext.get().partitionId())))
                change = np.hstack([mine.embed - embed, state["embed"] - sq, np.ones((len(own), 1))])
                moved = np.flatnonzero((change[:, : 2 * DIM] != 0).any(1))
                v = (_dense(mine, state) - before) * len(learn)
                v = np.pad(v, (0, -len(v) % width)).reshape(-1, width)
                keys += [own[moved], -2 - np.arange(len(v))]
                values += [change[moved], v]
            return np.concatenate(keys), np.concatenate(values)

        keys, sums = summed(rows, add, width, short=True)
        held.destroy()
        loss, kept, learnt = sums[keys == -1][0, :3]
        if best is None or (kept and loss / kept < best_loss):
            best, best_loss = (net.embed.copy(), _dense(net, squares)), loss / kept if kept else -np.inf
        if epoch < epochs and learnt:
            words = keys > 0
            change = sums[words] / sums[words, -1:]
            net.embed[keys[words]] += change[:, :DIM]
            squares["embed"][keys[words]] += change[:, DIM : 2 * DIM]
            dense = _dense(net, squares)
            order = np.argsort(-keys[keys < -1])
            _set_dense(net, squares, dense + sums[keys < -1][order].ravel()[: len(dense)] / learnt)
    net.embed = best[0]
    _set_dense(net, squares, best[1])
    return net


def calibrate(margins: DataFrame, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits label to z best over all rows of margins, each label counted as 1 / (n + 2) uncertain."""
    counts = {r["label"]: r["count"] for r in margins.groupBy("label").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    goal = F.when(F.col("label") == 1, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
    a = np.array([1.0, 0.0])
    for _ in range(steps if n1 + n0 else 0):
        p = _curve(F.col("z"), a[0], a[1])
        at = margins.select("z", (p * (1 - p)).alias("h"), (p - goal).alias("g"), F.spark_partition_id().alias("part"))
        z, h, g = F.col("z"), F.col("h"), F.col("g")
        parts = at.groupBy("part").agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate((h * z * z, h * z, h, g * z, g))]).collect()
        s = np.array([[r[f"s{k}"] for k in range(5)] for r in sorted(parts, key=lambda r: r["part"])]).sum(0)
        d = np.linalg.solve(np.array([[s[0], s[1]], [s[1], s[2]]]) + 1e-6 * np.eye(2), s[3:])
        a = a - d * min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        if np.abs(d).max() < 1e-8:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def _curve(z: Column, slope: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z * float(slope) + float(shift)))))


def best_thresholds(scored: DataFrame) -> dict[str, float]:
    """By language of at least LEAST toxic rows: the middle of the gap between scores that gives the best F1 over all rows of (lang, label, score).

    Scores are counted, sorted by ranges and summed up in two levels, so no language comes to one task.
    """
    by = scored.where("lang is not null").groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    order = [F.col("lang").asc(), F.col("score").desc()]
    by = cut(by.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("lang", "_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by.groupBy("lang", "_range").agg(F.sum("n").alias("_n"), F.sum("t").alias("_t"))
    ranges = ranges.select("lang", "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_t")], F.sum("_t").over(Window.partitionBy("lang")).alias("_all"))
    at = by.withColumn("n", F.sum("n").over(inside)).withColumn("t", F.sum("t").over(inside)).join(ranges, ["lang", "_range"]).where(F.col("_all") >= LEAST)
    f1 = 2 * (F.col("t") + F.col("_t")) / (F.col("n") + F.col("_n") + F.col("_all"))
    best = at.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("b")).select("lang", F.col("b.score").alias("best"))
    lower = by.join(F.broadcast(best), "lang").groupBy("lang", "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    return {r["lang"]: r["best"] if r["next"] is None else (r["best"] + r["next"]) / 2 for r in lower.collect()}


def kept_back(rows: DataFrame, net: Network) -> DataFrame:
    """(z, label, lang) of the rows kept back: z is the margin."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buckets, *_ = _part(iter([batch]))
            yield pa.RecordBatch.from_pydict({"z": pa.array(held.value.margins(off, held.value.rows(buckets))), "label": batch.column("label"), "lang": batch.column("lang")})

    return rows.where("check").mapInArrow(run, "z double, label int, lang string")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Learn from the labelled rows where `learn` (over labels) holds."""
    rows = cut(learnt_rows(docs, labels, learn, key, text, lang))
    if rows.select("label").distinct().count() < 2:
        return Network(np.zeros(0, np.int64), np.zeros((1, DIM)), [[np.zeros((DIM, FILTERS))] * w for w in WIDTHS], np.zeros(_N), np.zeros(_N), -1e9)
    net = train(rows, first_network(rows))
    margins = cut(kept_back(rows, net))
    net.slope, net.shift = calibrate(margins)
    net.thresholds = best_thresholds(margins.select("lang", "label", _curve(F.col("z"), net.slope, net.shift).alias("score")))
    return net


def detect(docs: DataFrame, net: Network, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep` of docs, with score and flagged (score at or above the language's threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*keep).schema.add("score", "double").add("flagged", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = held.value
            s = model.score(batch.column(len(keep)))
            bar = np.array([model.thresholds.get(x, 0.5) for x in batch.column(len(keep) + 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array(s >= bar, pa.bool_())], [*keep, "score", "flagged"])

    return docs.select(*keep, F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).mapInArrow(run, schema)
