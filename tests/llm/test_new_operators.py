"""Importance resampling, line dedup and phrases against plain versions, on awkward rows and with their skew paths forced."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from gradloom.llm import importance, linededup, phrases, queries
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ["key", "hash", "row", "a.b", "rank", "n", "_text", "keep", "pos", "h", "`t`", "words", "range"]


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.mark.parametrize("name", ["op11_importance", "op12_lines", "op13_phrases"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr) and got.count() > 0


# importance


def test_crc32_of_many_words():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abXYZ09éß漢", k=rng.choice([1, 2, 3, 8, 30, 200]))) for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "..", "x" * 100_000]
    for most in (1, 3):
        per = list(importance.features(pa.array(texts, pa.large_string()), most, 997))
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
            for n, (off, found) in enumerate(per, 1):
                assert found[off[i] : off[i + 1]].tolist() == [zlib.crc32(" ".join(w[k : k + n]).encode()) % 997 for k in range(len(w) - n + 1)]


def plain_resample(docs, target, most, buckets, percent, least, seed):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, most + 1) for k in range(len(w) - n + 1)]

    own, goal = Counter(b for _, t in docs for b in feats(t)[1]), Counter(b for t in target for b in feats(t)[1])
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1.0) * (s + buckets) / ((own[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        w, f = feats(text)
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 50, 35, 0), (1, 3, 100, 1), (3, 100, 0, 5)])
def test_resample_against_plain(spark, most, buckets, percent, least):
    rng = random.Random(most)
    words = ["ab", "cd", "Ef", "éü", "x1", "漢字", "z" * 90]
    docs = [(rng.choice([1, -1]) * rng.getrandbits(rng.choice([3, 30, 52])) * 1000 + i if i % 9 else i, rng.choice([". ", " ", "--"]).join(rng.choices(words, k=rng.randrange(60)))) for i in range(400)]
    docs += [(None, "ab cd " * 20), (-(1 << 63), "cd " * 30), ((1 << 63) - 1, "cd " * 30), (5_000_000, None), (5_000_001, ""), (5_000_002, "ab " * 50_000)]
    target = ["ab cd ab", None, "", "漢字 x1"]
    d, t = frame(spark, [(*r, None) for r in docs]).repartition(5), spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, most, buckets, percent, least, 7)
    want = plain_resample(docs, target, most, buckets, percent, least, 7)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    if percent == 35:
        drawn = importance.drawn_documents(d, got)
        assert drawn.columns == d.columns
        assert sorted(map(repr, (r["doc_id"] for r in drawn.collect()))) == sorted(repr(r[0]) for r in want if r[4])


def test_resample_of_equal_rows_and_none(spark):
    docs = [(7, "same words here again") for _ in range(50)] + [(8, "other words")] * 30
    d = frame(spark, [(*r, None) for r in docs])
    none = spark.createDataFrame([], "text string")
    got = importance.resample(d, none, percent=25, least=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len(got) == 80
    by_rank = [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert by_rank == sorted((r["score"] for r in got), reverse=True)[:20]
    assert importance.drawn_documents(d, importance.resample(d, none, percent=25, least=1)).count() == 20
    assert importance.resample(d.limit(0), none).count() == 0


def test_kth_key_of_any_longs(spark):
    rng = random.Random(3)
    for spread in (1, 60, 1 << 20, 1 << 63):
        rows = [(rng.randrange(-spread, spread), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(500)]
        d = spark.createDataFrame(rows, "a long, b long")
        for k in (1, 2, 250, 499, 500):
            assert sorted(map(tuple, d.where(importance.up_to_kth(d, k, ["a", "b"])).collect())) == sorted(rows)[:k]


# lines


def plain_lines(docs, least=20, documents=3):
    held = {}
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    first = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def line_docs():
    rng = random.Random(4)
    pool = [f"Line number {k} of the POOL, é{k % 7}" for k in range(40)] + ["short", "", "  ", "\x0b a line between SPACES and more \t", "a line between spaces and MORE", "ÀÉ lines that differ in case beyond ascii", "àé lines that differ in case beyond ascii", "x" * 19, "y" * 20, "漢" * 20]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 200)) + [f"own line of document {i} alone"])) for i in range(0, 120, 2)]
    docs += [(None, "\n".join(pool)), (None, "y" * 20), (1001, None), (1003, ""), (1005, "\n"), (10, "\n".join(pool[:9])), (10, "\n".join(pool[:9])), (2000, "long line of a long document\n" * 30_000), (1999, "long line of a long document"), (-5, "long line of a long document\nfree"), (-6, "long line of a long document\r\n")]
    return docs


@pytest.mark.parametrize("share", [1024, 20, 1_000_000])
def test_lines_against_plain(spark, monkeypatch, share):
    """With the sketch's way for few hashes, for many and for none."""
    monkeypatch.setattr(linededup, "SHARE", share)
    docs = line_docs()
    d = frame(spark, [(*r, None) for r in docs]).repartition(6)
    want = plain_lines(docs)
    got = linededup.digests(d, linededup.keep_bitmaps(d)).collect()
    assert sorted(((r["doc_id"], r["kept_sha256"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest(), n, k) for i, t, n, k in want), key=repr)
    clean = linededup.clean(d)
    assert clean.columns == d.columns
    texts = {i: t for i, t in docs}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(repr((i, t if k or texts[i] is not None else None)) for i, t, _, k in want)


def test_lines_of_nothing_and_bitmaps(spark):
    d = frame(spark, [(1, "a", None)])
    assert linededup.keep_bitmaps(d.limit(0)).count() == 0 and linededup.keep_bitmaps(d).count() == 0
    assert linededup.digests(d.limit(0), linededup.keep_bitmaps(d.limit(0))).count() == 0
    lines = [f"some line that repeats {i}" if i in (3, 64, 700) else f"line {i}" for i in range(1000)]
    rows = [(k, "\n".join(lines), None) for k in range(3)]
    got = {r["id"]: r for r in linededup.keep_bitmaps(frame(spark, rows)).collect()}
    assert set(got) == {0, 1} and got[0]["n_dropped"] == 3
    words, at = {}, -1
    for skip, bits in got[0]["keep"]:
        at += skip + 1
        words[at] = bits
    assert [i for w, b in sorted(words.items()) for i in range(w * 64, w * 64 + 64) if not b >> (i % 64) & 1] == [3, 64, 700]


def test_line_hashes_stay_in_their_ranges(spark):
    """Once in ranges of hashes, rows aren't dealt again before the document's sums."""
    plan = linededup._by_ranges(spark.range(9).select(F.col("id"), F.lit(1).alias("hash"), F.lit(1).alias("pos"), F.col("id").alias("h"), F.col("id").alias("h2")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


# phrases


def plain_phrases(docs, least, top, within=80):
    n, f = Counter(), Counter()
    for _, t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for k in range(len(w) - m + 1):
                    f[lang, tuple(w[k : k + m])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    around = Counter()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for k in range(len(w) - m + 1):
                around[lang, w[k : k + m]] = max(around[lang, w[k : k + m]], a)
    rows = []
    for (lang, w), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * around[lang, w] < within * a or (lang, w) not in around:
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    rows.sort()
    out, rank = [], Counter()
    for lang, s, a, p, l, r, total in rows:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, total, -s))
    return sorted(out)


def phrase_docs(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "é", "漢字", "\x01", "a\x00b", "it's", '"', "#" * 70, "tail"]
    weights = [30, 20, 5, 5, 5, 5, 3, 3, 2, 2, 2, 1, 1, 4]
    docs = []
    for i in range(n):
        t = " ".join(rng.choices(words, weights, k=rng.randrange(60)))
        for a, b in ((" é", " , "), (" tail", ".\n"), (" hall", "\thall  ")):
            t = t.replace(a, b) if rng.random() < 0.4 else t
        docs.append((i, t + (" New York City Hall" if i % 3 else ""), rng.choice(["en", "de\n", "", None, 'q"'])))
    return [*docs, (None, None, "en"), (1, "", None), (1, "...", "xx"), (2, "word " * 60_000, "en"), (2, "the of", None)]


@pytest.mark.parametrize(("least", "top", "chunk"), [(30, 2000, 8 << 20), (3, 17, 2000), (1, 2000, 500)])
def test_phrases_against_plain(spark, monkeypatch, least, top, chunk):
    """In one trie a batch and in many, with texts longer than one."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = phrase_docs(least, 300 if least > 1 else 60)
    got = phrases.collocations(frame(spark, docs).repartition(3), least, top)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, least, top)


def test_phrases_with_every_first_word_apart(spark):
    """Over so many ranges each first word would fill one: phrases go by two words, first words are looked up."""
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        docs = phrase_docs(9)
        got = phrases.collocations(frame(spark, docs), 4)
        assert sorted(map(tuple, got.collect())) == plain_phrases(docs, 4, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_phrases_with_a_full_field(spark):
    """If all pairs are marked, the counts are the same."""
    docs = phrase_docs(5, 80)
    d = frame(spark, docs)
    few, many = (sorted((r["lang"], tuple(r["words"]), r["a"], tuple(r["lefts"])) for r in phrases.phrase_counts(d, 5, bits=b).where("words is not null").collect()) for b in (64, 1 << 20))
    assert few == many and len(few) > 50


def test_phrases_of_nothing(spark):
    d = frame(spark, [(1, "a b", "en")])
    assert phrases.collocations(d.limit(0)).count() == 0 and phrases.collocations(d).count() == 0


def test_word_hashes_are_of_the_word_alone():
    words = [b"", b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 300] + [bytes([65 + i % 26]) * (i % 40) for i in range(100)]
    whole = phrases._hashes(pa.array(words, pa.large_binary()))
    assert [phrases._hashes(pa.array([w], pa.large_binary()))[0] for w in words] == whole.tolist()
    assert len(set(whole.tolist())) == len(set(words))


def test_tries_keep_what_they_are_written_as():
    w = phrases.Words(np.frombuffer(b"a b a b c. a b", np.uint8), np.array([0, 14]), np.array([0]))
    t = phrases.trie(w, phrases._lang_hashes(["en"]), np.full(1, 2**64 - 1, np.uint64))
    blobs = [b for _, b in phrases._pieces(t, w, ["en"], np.zeros(0, np.uint64), 5)]
    got = {tuple(r["words"]): (r["a"], r["lefts"]) for x in blobs for r in phrases._merged([x, x], 1).to_pylist() if r["words"]}
    assert got["a", "b"] == (6, [6]) and got["a", "b", "a", "b"] == (2, [6, 6, 2]) and got["b", "c"] == (2, [6]) and ("c", "a") not in got
