"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (anything else counts as a space) are hashed to
`DIMS` columns, weighted by (1 + ln count) * idf and scaled to length 1. The weights are learnt with
follow-the-regularised-leader under L1 and L2 penalties; a temperature, fitted on rows that the
weights haven't seen, calibrates the probabilities.

Document frequencies cover all rows that may be learnt from. The weights are fitted on a bounded
sample: about `PER_LANGUAGE` rows of each language.

Defined results: a null or empty text, or one without a letter, gives `und` with score 0. Rows
without a language aren't learnt from. Repeated rows get equal predictions. If nothing can be learnt
(no table rows, no languages) every prediction is `und`. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm import _text
from gradloom.llm._shared import map_whole, unit

DIMS = 1 << 13
PER_LANGUAGE = 1000
UND = "und"
#: Bytes and rows of text whose n-grams are counted at once; a count is held for each row and column.
PIECE = 1 << 16
ROWS = 64


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the n-grams of a plain() array, in order of row and column; whether a row has a letter."""
    points, off = _text.letters(texts)
    n = len(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, bool)
    is_letter = points != 32
    seen = np.zeros(len(points) + 1, np.int64)
    np.cumsum(is_letter, out=seen[1:])
    lettered = seen[off[1:]] > seen[off[:-1]]
    base = (_text.owner(off) * DIMS).astype(np.int64)
    counts = np.zeros(n * DIMS, np.int64)
    h = points * np.uint32(0x9E3779B1)
    for order in (1, 2, 3):
        if order > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[order - 1 :] * np.uint32(0xC2B2AE3D)
        use = is_letter[: len(h)].copy()
        for k in range(1, order):
            use |= is_letter[k : k + len(h)]
        if order > 1:  # within one text
            use &= base[: len(h)] == base[order - 1 :]
        key = base[: len(h)][use] + ((h[use] ^ (h[use] >> np.uint32(13))) & np.uint32(DIMS - 1))
        counts += np.bincount(key, minlength=n * DIMS)
    at = np.flatnonzero(counts)
    return at // DIMS, at % DIMS, counts[at], lettered


def _features(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[cols]
    norm = np.sqrt(np.bincount(rows, values * values, minlength=n))
    return values / np.maximum(norm, 1e-12)[rows]


@dataclass
class LanguageModel:
    """languages, idf per column, weights (column x language), bias, and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, cols, counts, lettered = ngrams(texts)
        n = len(texts)
        values = _features(rows, cols, counts, self.idf, n)
        out = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(rows, values * self.weights[cols, k], minlength=n)
        return out + self.bias, lettered

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and their probabilities; ties go to the first language in order."""
        names, scores = [], []
        texts = _text.plain(texts)
        for a, b in _text.slices(texts, PIECE, ROWS):
            z, lettered = self.logits(texts.slice(a, b - a))
            if not self.languages:
                names += [UND] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            p = _softmax(z / self.temperature)
            best = p.argmax(1)
            names += [self.languages[k] if ok else UND for k, ok in zip(best, lettered, strict=True)]
            scores.append(np.where(lettered, p[np.arange(b - a), best], 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, dims: int, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression by FTRL-proximal, one example at a time."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    order = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray, penalty: float) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - penalty, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            cols, values = examples[i]
            w, b = weights(z[cols], n[cols], l1), weights(z[dims], n[dims], 0.0)
            p = _softmax((values @ w + b)[None])[0]
            p[labels[i]] -= 1
            for at, g, old in ((cols, values[:, None] * p, w), (dims, p, b)):
                ni = n[at]
                z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * old
                n[at] = ni + g * g
    w = weights(z, n, l1)
    return w[:dims], weights(z[dims], n[dims], 0.0)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to divide the logits by for the least negative log-likelihood, by golden section over ln T.

    Each label counts as 1 / (n + 2) uncertain, so that n rows without an error don't drive T to 0.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    doubt = 1.0 / (n + 2)
    goal = np.full((n, classes), doubt / (classes - 1))
    goal[np.arange(n), labels] = 1 - doubt

    def loss(t: float) -> float:
        return float(-(goal * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(1).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(number of rows, rows in which each n-gram column occurs) over all rows of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            texts = _text.plain(batch.column(0))
            for a, b in _text.slices(texts, PIECE, ROWS):
                df += np.bincount(ngrams(texts.slice(a, b - a))[1], minlength=DIMS)
            total += len(texts)
        at = np.append(np.flatnonzero(df), DIMS)
        yield pa.RecordBatch.from_pydict({"col": pa.array(at, pa.int32()), "n": pa.array(np.append(df[at[:-1]], total), pa.int64())})

    found = docs.select(text).mapInArrow(count, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for r in found:
        df[r["col"]] = r["n"]
    return int(df[DIMS]), df[:DIMS]


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of docs where `learn` holds and lang isn't null."""
    rows = docs.where(learn & F.col(lang).isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    total, df = document_frequencies(rows, text)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], idf, np.zeros((DIMS, 0)), np.zeros(0))
    number, rate = F.lit(-1), F.lit(0.0)
    for k, name in enumerate(languages):
        number = F.when(F.col(lang) == name, F.lit(k)).otherwise(number)
        rate = F.when(F.col(lang) == name, F.lit(min(1.0, per_language / counts[name]))).otherwise(rate)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.plain(batch.column(0))
            for a, b in _text.slices(texts, PIECE, ROWS):
                r, c, n, lettered = ngrams(texts.slice(a, b - a))
                bounds = pa.array(np.searchsorted(r, np.arange(b - a + 1)).astype(np.int32))
                part = {"label": batch.column(1).slice(a, b - a), "order": batch.column(2).slice(a, b - a), **{k: pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for k, v in (("cols", c), ("counts", n))}}
                yield pa.RecordBatch.from_pydict(part).filter(pa.array(lettered))

    n_languages = len(languages)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        got = pa.Table.from_batches(found).sort_by([("order", "ascending"), ("label", "ascending")])
        w, bias, t = _weights(got, idf, n_languages)
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "bias": [bias.tobytes()], "temperature": [t]})

    sample = rows.where(unit(key, 5) < rate).select(F.col(text), number.alias("label"), F.xxhash64(F.col(text)).alias("order"))
    features = sample.mapInArrow(extract, "label int, order long, cols array<int>, counts array<int>")
    # One task learns from the bounded sample, so that the driver gets the weights only.
    found = features.repartition(1).mapInArrow(learnt, "weights binary, bias binary, temperature double").collect()
    if not found:  # no text with a letter
        return LanguageModel(languages, idf, np.zeros((DIMS, n_languages)), np.zeros(n_languages))
    w, bias = (np.frombuffer(found[0][c], float) for c in ("weights", "bias"))
    return LanguageModel(languages, idf, w.reshape(DIMS, n_languages), bias, found[0]["temperature"])


def _weights(sample: pa.Table, idf: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature from (label, cols, counts) in their order; every fifth row is for the temperature alone."""
    labels = sample["label"].to_numpy().astype(np.int64)
    cols, counts = (np.concatenate([c.flatten().to_numpy() for c in sample[n].chunks] or [np.zeros(0, np.int32)]) for n in ("cols", "counts"))
    off = np.append(0, np.cumsum(pc.list_value_length(sample["cols"]).to_numpy())).astype(np.int64)
    values = _features(np.repeat(np.arange(len(labels)), np.diff(off)), cols, counts, idf, len(labels))
    examples = [(cols[a:b].astype(np.int64), values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    check = np.arange(len(labels)) % 5 == 4
    w, bias = ftrl([e for e, c in zip(examples, check, strict=True) if not c], labels[~check], classes, DIMS)
    logits = np.array([v @ w[c] + bias for (c, v), k in zip(examples, check, strict=True) if k]).reshape(-1, classes)
    return w, bias, temperature(logits, labels[check])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with a probability of at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column(at))
            yield batch.filter(pa.array((np.array(names, object) != UND) & (scores >= least)))

    return map_whole(docs, run)
