"""The pipeline's stages: columns, and what each may and may not drop."""

import random
import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import sentencepiece
from gradloom.llm import langid, minhash, quality
from gradloom.llm._shared import held_out
from pyspark.sql import functions as F


def brute_targets(sizes):
    """What each source should give: shares of 150 % by weight, at most twice a source's words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (total - sum(2 * sizes[s] for s in full)) / rest if rest else 0.0
        new = {s for s in names if s not in full and weight[s] * level > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def stored(spark, docs, stage, sf, path):
    stage(spark, docs, sf).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    """Each stage against a plain version: models row by row, all pairs, targets by hand, the sentencepiece library."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(stored(spark, kept[-1], stage, sf, tmp_path / str(k)))
        if k < 4:
            assert kept[-1].columns == columns
    raw, identified, good, once, mixed, ids = ([r.asDict() for r in d.collect()] for d in kept)
    model = langid.fit(docs, ~held_out("doc_id", 3, 1))
    want = []
    for r in raw:
        names, scores = model.predict(pa.array([r["text"]], pa.string()))
        want += [r["doc_id"]] if names[0] != langid.UND and scores[0] >= 0.5 else []
    assert sorted(r["doc_id"] for r in identified) == sorted(want) and len(want) >= 0.95 * len(raw)
    model = quality.fit(kept[1], spark.read.parquet(f"{sf}/labels.parquet"), ~held_out("doc_id", 4, 2))
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in identified if model.score(pa.array([r["text"]]))[0] >= 0.7)
    texts = {r["doc_id"]: r["text"] for r in good}
    groups = brute_groups(texts, Fraction(8, 10))
    assert sorted(r["doc_id"] for r in once) == sorted(set(groups.values())) and len(once) < len(good)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in once}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= set(size) and max(times.values()) <= 2
    by, taken = Counter(), Counter()
    for r in once:
        by[r["source"]] += size[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]] * times[r["doc_id"]]
    for source, target in brute_targets(by).items():
        assert abs(taken[source] - target) <= max(0.02 * target, max(size[r["doc_id"]] for r in once if r["source"] == source) / 2)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == sorted((r["doc_id"], sp.encode(r["text"])) for r in mixed)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty, long and repeated texts, names of the operators' own columns, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    names = ["_rows", "key", "doc", "size", "cluster", "_at", "_text", "comp", "n", "_gone", "row", "id", "at", "a.b", "it's", "x y", "Upper", "`tick`", "hash", "all", "text.1", "kept"]
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, plain.first()["text"], None, None), (3, None, "en", "web"), (4, "", None, None), (5, " \t ", "de", None), (6, "word " * 50_000, None, None), (7, plain.first()["text"], "en", "web"), (7, plain.first()["text"], "en", "web")]
    extra = spark.createDataFrame([(*r, None) for r in odd], plain.schema)
    docs = plain.union(extra).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for rows, tag in ((docs, "some"), (docs.limit(0), "none")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stored(spark, rows, stage, sf, tmp_path / f"{tag}{k}")
            assert after.columns == rows.columns if k < 4 else "ids" in after.columns
            if k < 3:
                assert after.exceptAll(rows).count() == 0
            rows = after
        assert (rows.count() > 100) == (tag == "some")


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def brute_groups(texts, least):
    """The smallest id of each id's group, by comparing all pairs of sets of five words; shorter texts are one."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= least:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def edited(rng, words, at):
    return " ".join(f"n{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words))


def test_near_duplicates_from_eight_tenths_on(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(0, 200, 2):  # three words far apart: 131 of 161 shingles are common, 0.81; four: 126 of 166, 0.76
        words = [f"w{rng.randrange(4000)}" for _ in range(150)]
        texts[i], texts[i + 1] = " ".join(words), edited(rng, words, (20, 70, 120) if i % 4 else (20, 50, 80, 120))
    words = [f"w{rng.randrange(4000)}" for _ in range(150)]
    for i in range(200, 300):
        texts[i] = edited(rng, words, rng.sample(range(150), rng.randrange(6)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = brute_groups(texts, Fraction(8, 10))
    assert groups != brute_groups(texts, Fraction(85, 100))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()) == sorted(set(groups.values()))
    got = minhash.near_duplicates(rows, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    a, b, c = ([f"{x}{rng.randrange(4000)}" for _ in range(100)] for x in "abc")
    text = " ".join
    rows = [(3, text(a), "x"), (3, text(a), "y"), (3, text(a), "x"), (4, edited(rng, a, (50,)), "x"), (None, text(a), "x"), (None, edited(rng, a, (20,)), "x")]
    rows += [(None, text(b), "x"), (None, text(b), "x"), (None, edited(rng, b, (20,)), "x"), (9, text(c), "x"), (9, text(c), "x"), (8, "", "x"), (None, "", "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert got.columns == d.columns
    got = got.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [3, 8, 9]
    none = [r["text"] for r in got if r["doc_id"] is None]
    assert len(none) == 3 and None in none and "" in none and max(none, key=lambda t: len(t or ""))[:1] == "b"
