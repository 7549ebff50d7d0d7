"""Importance resampling of documents toward a target distribution.

A text's features are its runs of 1 to `most` consecutive words (A-Z lower-cased; words are runs of letters and digits of ASCII and of all
characters beyond it), joined by a space; a feature's bucket is the crc32 of its bytes modulo `buckets`. Tasks count buckets in arrays, for the
documents and for the target texts. A bucket's gain is floor(1000 ln(ratio of its smoothed shares)); an array of all gains, whose size is
`buckets` whatever the input, goes to every task, and a document's weight is the sum of the gains that its features look up in it. Its score adds Gumbel noise, by
sha256 of seed and id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The k highest are found by radix selection: keys are (score descending, id ascending, a number for rows that are equal in both), read as bits; a job counts
the rows by a key's next `DIGIT` bits, those rows whose bits before are the k-th key's, until the k-th key is known. No row moves for that. Only the drawn rows are then range-partitioned,
sorted and ranked; the others keep a null rank.

Defined results: a null, empty or wordless text has no features and weight 0. Documents of fewer than `least` words are scored, never drawn. A row with a null id draws its noise
with an empty id and ties behind all others. Rows that repeat are documents of their own, equal ones in an arbitrary order. Without target texts all gains come from the documents alone; an empty
table of documents gives an empty result. Other columns are kept by `drawn_documents` and otherwise never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm import _text
from gradloom.llm._shared import cut, ranked, whole

BUCKETS = 10_000
#: Bits of a key that one job of the selection looks at.
DIGIT = 12
#: Words of more bytes are hashed one by one.
LONG = 48
MOST_LONG = (1 << 63) - 1


def _crc_steps() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_STEPS = _crc_steps()
_ONES = np.uint32(0xFFFFFFFF)


def crc_after(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inner states of crc32 after each state has read its bytes raw[start:end]; words of one length advance together."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    s, left = starts[order], np.append(np.cumsum(np.bincount(n)[::-1])[::-1], 0) if len(n) else np.zeros(1, int)
    out = state[order]
    for k in range(min(len(left) - 2, LONG) if len(n) else 0):
        m = left[k + 1]  # words of more than k bytes
        out[:m] = _STEPS[(out[:m] ^ raw[s[:m] + k]) & np.uint32(255)] ^ (out[:m] >> np.uint32(8))
    for i in np.flatnonzero(n[order] > LONG).tolist():
        a = int(s[i])
        out[i] = zlib.crc32(raw[a + LONG : a + int(n[order[i]])].tobytes(), int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... `most` words of a plain() array: (offsets of the texts, the buckets of their runs)."""
    raw, off, starts, ends, _ = _text.words(texts, _text.PUNCT, lower=True)
    state = crc_after(np.full(len(starts), _ONES), raw, starts, ends)
    owner = _text.owner(off)
    at = np.arange(len(starts))
    for n in range(1, most + 1):
        if n > 1:
            at = at[at + n <= off[owner[at] + 1]]
            state = state[np.isin(before, at, assume_unique=True)] if len(at) < len(before) else state
            state = _STEPS[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = crc_after(state, raw, starts[at + n - 1], ends[at + n - 1])
        before = at
        yield np.searchsorted(at, off), ((state ^ _ONES) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _text.plain(batch.column(0))
            for a, b in _text.slices(texts):
                for _, found in features(texts.slice(a, b - a), most, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    got = docs.select(F.col(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln(its share of the target over its share of the documents)), shares smoothed by 1."""
    n = len(own)
    s, t = float(own.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, words, n_features, weight) of each row of docs; hash is the text's."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.plain(batch.column(2))
            for a, b in _text.slices(texts):
                weight, count, words = (np.zeros(b - a, np.int64) for _ in range(3))
                for off, found in features(texts.slice(a, b - a), most, len(held.value)):
                    run_of = np.append(0, np.cumsum(held.value[found]))
                    weight += run_of[off[1:]] - run_of[off[:-1]]
                    count += np.diff(off)
                    words = words if words.any() else np.diff(off)  # the first are single words
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words), pa.array(count), pa.array(weight)], ["key", "hash", "words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, hash long, words long, n_features long, weight long")


def gumbel(key: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u by the first 32 bits of sha256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def up_to_kth(rows: DataFrame, k: int, keys: list[str]) -> Column:
    """Whether a row's key (long columns, compared in turn) is among the k smallest; k is from 1 to the rows' number, and keys are distinct or any of the equal ones will do.

    Each job counts rows by the next DIGIT bits of the key and keeps those that share the k-th key's bits so far.
    """
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).collect()[0]
    bound, whole_key, left, same = [MOST_LONG] * len(keys), 0, k, rows
    for i, c in enumerate(keys):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        shift = ((lo ^ hi) & (1 << 64) - 1).bit_length()  # the bits above are the same in all rows
        bits = ((lo + (1 << 63)) >> shift) << shift  # in the order of unsigned numbers
        all_in = False
        while shift > 0 and not all_in:
            step = min(DIGIT, shift)
            shift -= step
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-1 << 63)), shift).bitwiseAND((1 << step) - 1)
            counts = sorted((r["digit"], r["count"]) for r in same.groupBy(digit.alias("digit")).count().collect())
            for d, n in counts:
                if left <= n:
                    break
                left -= n
            bits |= d << shift
            same, all_in = same.where(digit == d), left == n
        bound[i] = bits + (1 << shift) - 1 - (1 << 63)
        if all_in:
            break
    chosen = F.col(keys[-1]) <= bound[-1]
    for c, b in zip(keys[-2::-1], bound[-2::-1], strict=True):
        chosen = (F.col(c) < b) | ((F.col(c) == b) & chosen)
    return chosen


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(key, hash, n_features, weight, score, rank) of each row of docs; rank is null for those that aren't among the floor(percent / 100 * N) drawn of the N that have at least `least` words."""
    gain = gains(bucket_counts(docs, most, buckets, text), bucket_counts(target, most, buckets, target_text))
    rows = weighed(docs, gain, most, key, text).withColumn("score", F.col("weight") + gumbel("key", seed))
    # ids of equal keys; stored with the rows, since they change if these are computed again
    rows = cut(rows.withColumn("down", F.bitwise_not("score")).withColumn("id", F.coalesce("key", F.lit(MOST_LONG))).withColumn("serial", F.monotonically_increasing_id()))
    fit, order = F.col("words") >= least, ["down", "id", "serial"]
    k = percent * rows.where(fit).count() // 100
    columns = [F.col("key").alias(key), "hash", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, none)
    drawn = fit & up_to_kth(rows.where(fit), k, order)
    return ranked(rows.where(drawn), order).select(*columns, "rank").union(rows.where(~drawn).select(*columns, none))


def drawn_documents(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of docs, all columns, by the plan that resample() made of them."""
    same = ["key", "hash"]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("hash"), whole(docs).alias("row"))
    taken = plan.where(F.col("rank").isNotNull()).groupBy(F.col(key).alias("key"), "hash").agg(F.count("*").alias("n"))
    r, t = rows.alias("r"), taken.alias("t")
    met = r.join(t, F.col("r.key").eqNullSafe(F.col("t.key")) & (F.col("r.hash") == F.col("t.hash"))).select("r.*", "t.n")
    # of rows with equal ids and texts as many as were drawn
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    return met.withColumn("place", place).where(F.col("place") <= F.col("n")).select("row.*")
