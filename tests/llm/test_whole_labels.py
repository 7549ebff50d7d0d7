"""The classifiers learn from every labelled row: against plain versions over more rows than a bounded sample held."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradloom.llm import _shared, _text, quality, toxicity


def plain_worths(x, y, l2=1e-3):
    """(centre, scale, weights) by Newton's method over all pairs, one by one."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -6, 6)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w)), -(d * p[:, None]).mean(0) + l2 * w)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


@pytest.mark.parametrize("n_good, n_bad", [(3600, 60), (31, 30), (1, 1)])
def test_quality_is_learnt_from_all_labelled_rows_and_pairs(spark, n_good, n_bad):
    rng = random.Random(n_good)
    words = "the a of and river stone keeps house under letter nine".split()
    rows = []
    for i in range(n_good + n_bad):
        good = i >= n_bad
        text = [rng.choice(words) if rng.random() < (0.95 if good else 0.8) else rng.choice(["#$%", "QQ", "77", "\n", "stone stone"]) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(text), int(good)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int"), F.lit(True))
    x, y = quality.features(_text.plain(pa.array([t for _, t, _ in rows]))), np.array([y for *_, y in rows])
    centre, scale, w = plain_worths(x, y)
    assert np.allclose(model.centre, centre, rtol=1e-9, atol=1e-9) and np.allclose(model.weights, w, atol=2e-5)
    worth = np.sort(model.worth(x))
    near = np.array([k for k in range(len(worth) - 1) if abs(k + 1 - n_bad) <= 0.02 * len(worth)])
    k = near[np.argmax(worth[near + 1] - worth[near])]
    assert np.isclose(model.cut, (worth[k] + worth[k + 1]) / 2, atol=1e-9)
    assert np.isclose(model.slope, 4 / (np.median(model.worth(x)[y == 1]) - model.cut), rtol=1e-9)


def plain_threshold(score, y):
    if (y == 1).sum() < toxicity.LEAST:
        return None
    order = np.argsort(-score, kind="stable")
    s, tp = score[order], np.cumsum((y == 1)[order])
    f1 = np.where(np.append(s[:-1] != s[1:], True), 2 * tp / (np.arange(1, len(s) + 1) + (y == 1).sum()), -1)
    k = int(np.argmax(f1))
    return (s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k]


def test_toxicity_is_learnt_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 2000)
    rng = random.Random(5)
    rows = []
    for i in range(5600):
        text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(2, 12))]
        if toxic := i % 4 == 0 and rng.random() < 0.9:
            text[rng.randrange(len(text))] = rng.choice(["vile", "rotten", "scum"])
        rows.append((i, " ".join(text), ["en", "de", None][i % 3] if i % 50 else "fr", int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    own = _shared.cut(toxicity.learnt_rows(docs, labels, F.lit(True)))
    got = own.toPandas()
    assert len(got) == len(rows) and own.rdd.getNumPartitions() == 3 and 0.2 < got["check"].mean() < 0.3
    net = toxicity.fit(docs, labels, F.lit(True))
    seen = Counter(w for ids, check in zip(got["ids"], got["check"], strict=True) if not check for w in set(ids))
    assert net.known.tolist() == sorted(w for w, n in seen.items() if n >= 2)
    kept = got[got["check"]]
    off = np.append(0, np.cumsum(kept["ids"].map(len)))
    z, y, lang = net.margins(off, net.rows(np.concatenate(kept["ids"].tolist()))), kept["label"].to_numpy(), kept["lang"].to_numpy()
    score = 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -40, 40)))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    wrong = score - np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    assert abs(wrong.sum()) < 1e-4 and abs((wrong * z).sum()) < 1e-4
    want = {x: plain_threshold(score[lang == x], y[lang == x]) for x in ("en", "de", "fr")}
    assert want["fr"] is None and net.thresholds == pytest.approx({x: t for x, t in want.items() if t is not None}, rel=1e-6)
    out = toxicity.detect(docs, net, ["doc_id"]).toPandas().sort_values("doc_id")
    assert ((out["score"] >= 0.5) == np.array([bool(r[3]) for r in rows])).mean() > 0.98
