"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Each text is described by shape statistics (what share of it is capitals, symbols, digits, white
space, repeated words, repeated lines and so on). The worth of a text is linear in its features and
P(a beats b) = sigmoid(worth a - worth b), fitted by logistic loss with an L2 penalty on all pairs of a
good and a bad labelled text. The threshold is the quantile of the learnt texts' worths that parts off as
large a share as is labelled bad, moved to the widest gap between worths within 2 points of it; the score
maps worth to 0..1 with the threshold at 0.7.

Nothing is sampled: centre, scale, weights, threshold and slope come from all labelled rows. The sums over pairs
are not taken pair by pair: a pair's terms depend on the difference of two worths, so texts are summed by
label and bin of worth, with the moments of their distances to the bin's middle, and bins meet bins by the
sigmoid's Taylor series. That is linear in the rows; the series' error is below 1e-7 of a pair.

Defined results: a null text is an empty one and gets the score of its features like any other. Repeated
rows get equal scores. Labels other than 0 and 1 are ignored; without labels of both kinds every
score is 0.7. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gradloom.llm import _text
from gradloom.llm._shared import cut, labelled, map_whole, ranked, summed

THRESHOLD = 0.7
#: Width of a bin of worths, and the order to which its moments are kept.
BIN, ORDER = 0.5, 8
#: Learnt rows in a task of a Newton step.
ROWS = 1 << 16

_UPPER, _DIGIT, _SPACE, _SYMBOL, _COMMON, _LOWER, _LINE, _HIGH = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[128:] = _HIGH
for _c in b".,;:'\"-()?":
    _CLASS[_c] = _COMMON
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[[10, 13]] = True
NAMES = [
    "upper", "digit", "space", "symbol", "common", "lower", "line", "high", "ln_bytes", "ln_words", "word_length", "long_words", "distinct_words", "top_word",
    "repeats_previous", "words_with_symbol_end", "upper_words", "distinct_lines", "ln_line_words", "symbol_words",
]


def _shares(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the share of its items that are first of their kind, and of its commonest item."""
    n, rows = len(offsets) - 1, _text.owner(offsets)
    key = hashes ^ _text.mix(rows.astype(np.uint64) + np.uint64(1))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    size = np.maximum(np.diff(offsets), 1)
    top = np.zeros(n)
    np.maximum.at(top, rows[first], count)
    return np.bincount(rows[first], minlength=n) / size, top / size


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text of a plain() array."""
    raw, off, starts, ends, hashes = _text.words(texts)
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    size = np.maximum(np.diff(np.append(_text.buffers(texts)[1], 0)[: n + 1]), 1)
    kind = _CLASS[raw]
    row = _text.owner(_text.buffers(texts)[1])
    out[:, :8] = np.bincount(row * 8 + kind, minlength=n * 8).reshape(n, 8) / size[:, None]
    words, w = np.maximum(np.diff(off), 1), _text.owner(off)
    length = ends - starts
    mean = lambda x: np.bincount(w, x, minlength=n) / words
    out[:, 8], out[:, 9], out[:, 10] = np.log1p(size), np.log1p(np.diff(off)), mean(length)
    out[:, 11] = mean(length > 20)
    out[:, 12], out[:, 13] = _shares(off, hashes)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (w[1:] == w[:-1])
    out[:, 14] = mean(same)
    if len(hashes):
        last, first = kind[ends - 1], kind[starts]
        out[:, 15] = mean((last == _SYMBOL) & (length > 1))
        out[:, 16] = mean((first == _UPPER) & (kind[np.minimum(starts + 1, ends - 1)] == _UPPER) & (length > 1))
        out[:, 19] = mean((first == _SYMBOL) & (last == _SYMBOL))
    _, line_off, _, _, line_hash = _text.words(texts, _NOT_LINE)
    out[:, 17] = _shares(line_off, line_hash)[0]
    out[:, 18] = np.log1p(np.diff(off) / np.maximum(np.diff(line_off), 1))
    return out


@dataclass
class QualityModel:
    """Worth is (features - centre) / scale @ weights; cut is the worth whose score is THRESHOLD."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights

    def score(self, texts: pa.Array) -> np.ndarray:
        texts = _text.plain(texts)
        parts = [features(texts.slice(a, b - a)) for a, b in _text.slices(texts)]
        if not parts:
            return np.zeros(0)
        z = (self.worth(np.vstack(parts)) - self.cut) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoids(x: np.ndarray) -> list[np.ndarray]:
    """The derivatives 0 to ORDER + 1 of the sigmoid at x."""
    p = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
    poly, found = np.polynomial.Polynomial([0.0, 1.0]), []
    for _ in range(ORDER + 2):
        found.append(poly(p))
        poly = poly.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
    return found


def moments(z: np.ndarray, y: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) by label and bin of worth; a key is 2 * bin + label.

    A row of sums has, for each k up to ORDER, the sums of t and of t z, t being (distance to the bin's middle)^k / k!, then the sum of z z'.
    """
    at = np.floor(worth / BIN).astype(np.int64)
    keys, index = np.unique(2 * at + y, return_inverse=True)
    d = z.shape[1]
    out = np.zeros((len(keys), (ORDER + 1) * (d + 1) + d * d))
    order = np.argsort(index, kind="stable")
    first = np.searchsorted(index[order], np.arange(len(keys) + 1))
    far = worth - (at + 0.5) * BIN
    for k in range(len(keys)):
        own = order[first[k] : first[k + 1]]
        t = np.vander(far[own], ORDER + 1, increasing=True) / _FACTORIAL
        out[k, : (ORDER + 1) * (d + 1)] = (t.T @ np.hstack([np.ones((len(own), 1)), z[own]])).ravel()
        out[k, (ORDER + 1) * (d + 1) :] = (z[own].T @ z[own]).ravel()
    return keys, out


_FACTORIAL = np.cumprod(np.append(1.0, np.arange(1, ORDER + 1)))


def pair_sums(keys: np.ndarray, sums: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(number of pairs, gradient, curvature) of the sum of ln(1 + exp(worth b - worth g)) over all pairs of a good g and a bad b, from moments() added up.

    The gradient is exact but for the series' end; the curvature takes the distances in a bin to first order only where both texts' features meet, which Newton's method forgives.
    """
    m = sums[:, : (ORDER + 1) * (d + 1)].reshape(-1, ORDER + 1, d + 1)
    square = sums[:, (ORDER + 1) * (d + 1) :].reshape(-1, d, d)
    bad, good = np.flatnonzero(keys % 2 == 0), np.flatnonzero(keys % 2 == 1)
    middle = (keys // 2 + 0.5) * BIN
    mb, sb = m[bad], square[bad]
    grad, curve = np.zeros(d), np.zeros((d, d))
    for part in np.array_split(good, max(1, len(good) * len(bad) >> 18)):
        s = _sigmoids(middle[bad][None, :] - middle[part][:, None])
        mg, sg = m[part], square[part]
        for i in range(ORDER + 1):
            for j in range(ORDER + 1 - i):
                meet = s[i + j] @ mb[:, j] * (-1.0) ** i  # good bins x (1 + d)
                grad += mg[:, i, 0] @ meet[:, 1:] - mg[:, i, 1:].T @ meet[:, 0]
                if i + j <= 1:
                    across = mg[:, i, 1:].T @ (s[i + j + 1] @ mb[:, j, 1:]) * (-1.0) ** i
                    curve -= across + across.T
        slope_g = sum(s[j + 1] @ mb[:, j, 0] for j in range(ORDER + 1))
        slope_b = sum((-1.0) ** i * mg[:, i, 0] @ s[i + 1] for i in range(ORDER + 1))
        curve += np.tensordot(slope_g, sg, 1) + np.tensordot(slope_b, sb, 1)
    return float(m[bad, 0, 0].sum() * m[good, 0, 0].sum()), grad, curve


def bradley_terry(found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights that minimise mean ln(1 + exp(worth b - worth g)) over all pairs + l2 |w|^2 / 2, by Newton's method; found(w) gives the moments of all rows at w."""
    w = np.zeros(d)
    for _ in range(steps):
        n, grad, curve = pair_sums(*found(w), d)
        step = np.linalg.solve(curve / n + l2 * np.eye(d), grad / n + l2 * w)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _table(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of batches of learnt rows."""
    for batch in batches:
        yield batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES)), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


def learnt_rows(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(x, label, tie: a hash of the key) of all labelled texts. Features are taken before the join, so that no text is shuffled."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.plain(batch.column(1))
            x = [features(texts.slice(a, b - a)) for a, b in _text.slices(texts)]
            if x:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(np.vstack(x).ravel()))], ["key", "x"])

    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    own = labelled(labels, "quality", learn, key).withColumnRenamed(key, "key")
    x = kept.mapInArrow(extract, kept.select("key").schema.add("x", ArrayType(DoubleType())))
    return x.join(own, "key").sortWithinPartitions("key", F.xxhash64("x")).select("x", "label", F.xxhash64("key").alias("tie"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Learn from the labelled rows where `learn` (over labels) holds."""
    d = len(NAMES)
    none = QualityModel(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    rows = cut(learnt_rows(docs, labels, learn, key, text))

    def spread(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        found = list(_table(batches))
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, 2 * d + 1))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return np.unique(y), np.array([np.concatenate([[len(own)], own.sum(0), (own * own).sum(0)]) for own in (x[y == k] for k in np.unique(y))])

    kinds, got = summed(rows, spread, 2 * d + 1)
    if len(kinds) < 2:
        return none
    (n0, n1), n = got[:, 0].astype(np.int64).tolist(), int(got[:, 0].sum())
    centre = got[:, 1 : d + 1].sum(0) / n
    scale = np.maximum(np.sqrt(np.maximum(got[:, d + 1 :].sum(0) / n - centre * centre, 0)), 1e-6)
    rows = rows.coalesce(n // ROWS + 1)

    def found(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            keys, sums = np.zeros(0, np.int64), np.zeros((0, (ORDER + 1) * (d + 1) + d * d))
            for x, y in _table(batches):
                z = np.clip((x - centre) / scale, -6, 6)
                more, own = moments(z, y, z @ w)
                keys, index = np.unique(np.concatenate([keys, more]), return_inverse=True)
                both = np.zeros((len(keys), sums.shape[1]))
                np.add.at(both, index, np.concatenate([sums, own]))
                sums = both
            return keys, sums

        return summed(rows, add, (ORDER + 1) * (d + 1) + d * d)

    model = QualityModel(centre, scale, bradley_terry(found, d), 0.0, 1.0)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ((x, _),) = _table([batch])
            yield pa.RecordBatch.from_pydict({"worth": pa.array(model.worth(x)), "label": batch.column("label"), "tie": batch.column("tie")})

    # Ties are broken by the key's hash, so that many copies of a text don't go to one task.
    worths = rows.mapInArrow(judged, "worth double, label int, tie long")
    model.cut = _gap(worths, n, n0)
    half = F.floor(F.lit(n1 + 1) / 2), F.floor(F.lit(n1 + 2) / 2)
    median = ranked(worths.where("label = 1"), ["worth", "tie"]).where(F.col("rank").isin(*half)).agg(F.avg("worth")).collect()[0][0]
    model.slope = float(4.0 / max(1e-9, median - model.cut)) if median > model.cut else 1.0
    return model


def _gap(worths: DataFrame, n: int, bad: int, slack: float = 0.02) -> float:
    """The middle of the widest gap between neighbouring worths of which as many of the n, within slack of all, are at or below it as are labelled bad."""
    placed = cut(ranked(worths.select("worth", "tie"), ["worth", "tie"]).where(F.abs(F.col("rank") - bad) <= int(slack * n) + 1))
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("worth").alias("next"))
    gaps = placed.join(after, "rank").where(F.abs(F.col("rank") - bad) <= slack * n)
    widest = gaps.agg(F.max(F.struct((F.col("next") - F.col("worth")).alias("gap"), (-F.col("rank")).alias("at"), "worth", "next")).alias("w")).select("w.*").collect()[0]
    return float((widest["worth"] + widest["next"]) / 2)


def judge(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least THRESHOLD."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.score(batch.column(at)) >= THRESHOLD))

    return map_whole(docs, run)
