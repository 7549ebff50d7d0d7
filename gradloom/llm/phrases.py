"""Phrase collocations of each language, mined with count tries.

Texts (A-Z lower-cased) are parted at `.,;:!?` and line breaks into pieces, pieces at blanks and tabs into words. A candidate is a phrase of 2 to `DEPTH` words that
occurs at least `least` times in its language. Of the ways to cut it in two, the one of the lowest score SCALE * a / (l + r) counts, a being the
phrase's occurrences, l and r those of the parts. Candidates that lie within a longer one of nearly as many occurrences are dropped.

1. Pairs. Each task counts its neighbouring words, and Spark sums the counts by hash: what is frequent is at least as frequent by hash. The frequent hashes are marked in a field of `BITS` bits, of one size
   whatever the input, that goes to every task. A longer phrase's pairs are all as frequent as it is; so nothing that can be a candidate is lost, and a collision only lets a rare phrase in for now.
2. Tries. Each task turns `CHUNK` bytes of text at once into a trie of languages, words and phrases of marked pairs, at most DEPTH words deep, level by level: a node is a (parent, word) pair, the
   words numbered in order of their hash, so that each level is sorted by path. The trie is cut into ranges of the prefix's hash and serialised, as a row for each range.
3. Merge. The tries of one range meet in one task, are merged level by level, and the walk from a frequent phrase to the root gives its left parts. A range is of first words; a first word with so many pairs that it would fill a range goes by its first two words, its
   own count is looked up afterwards (at most four for each range, by broadcast).
4. Suffix links. A phrase's right parts are the phrases of its last words: frequent themselves, so they are joined from the merged table.

All counts are sums over all documents; scores are exact decimals. Defined results: null and empty texts have no words; a null language is `und`. Rows that repeat count each time. An empty table gives an empty result.
Words may hold any other character. Other columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm import _text
from gradloom.llm._shared import cut, ranked

DEPTH = 4
SCALE = 2_000_000
#: Bits of the field that marks frequent pairs.
BITS = 1 << 26
#: Bytes of text in one trie; a longer piece of text is one all the same.
CHUNK = 4 << 20
UND = "und"

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(0xFFFFFFFF)


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of paths that go on with a word, by hashes of both."""
    return _text.mix(h * _MIX + word)


class Words:
    """A chunk's words: their numbers in order of hash, the strings and hashes of these, and each word's piece and language."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, langs: np.ndarray) -> None:
        """raw: bytes; bounds: where texts begin and end; langs: the number of each text's language."""
        raw = _text.LOWER[raw]
        kind = _KIND[raw]
        word = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts, ends = np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1
        breaks = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)
        self.piece = breaks[starts]
        self.lang = langs[np.searchsorted(bounds, starts, "right") - 1]
        offsets = np.append(0, np.cumsum(ends - starts))
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
        coded = strings.dictionary_encode()
        own, where = coded.dictionary, coded.indices.to_numpy()
        h = _hashes(own)
        order = np.argsort(h, kind="stable")
        self.hash, self.strings = h[order], own.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.id = rank[where]

    def __len__(self) -> int:
        return len(self.id)


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, by all their bytes and length."""
    raw, off = _text.buffers(strings)
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    h, start = n[order].astype(np.uint64), off[:-1][order]
    left = np.append(np.cumsum(np.bincount(n)[::-1])[::-1], 0) if len(n) else np.zeros(1, int)
    for k in range(0, len(left) - 2, 8):  # eight bytes at once of all words that have more than k
        m = left[k + 1]
        if m < 16:
            for i in range(m):
                rest = raw[start[i] + k : start[i] + n[order[i]]]
                rest = np.append(rest, np.zeros(-len(rest) % 8, np.uint8)).view(np.uint64)
                for v in rest:
                    h[i : i + 1] = _extend(h[i : i + 1], v)
            h[:m] = _text.mix(h[:m])
            break
        at = start[:m, None] + k + np.arange(8)
        part = np.where(k + np.arange(8) < n[order[:m], None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)
        h[:m] = _extend(h[:m], part.view(np.uint64)[:, 0])
        h[left[min(k + 9, len(left) - 1)] : m] = _text.mix(h[left[min(k + 9, len(left) - 1)] : m])
    out = np.empty(len(n), np.uint64)
    out[order] = h
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """The words of (text, lang) rows, CHUNK bytes at once; a longer text is parted between pieces. With the languages' names."""
    texts, coded = _text.plain(batch.column(0)), pc.fill_null(batch.column(1).cast(pa.string()), UND).dictionary_encode()
    names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    for a, b in _text.slices(texts, CHUNK):
        raw, off = _text.buffers(texts.slice(a, b - a))
        if len(raw) <= 2 * CHUNK:
            yield Words(raw, off, lang[a:b]), names
            continue
        at = 0  # one long text
        while at < len(raw):
            to = min(len(raw), at + CHUNK)
            while to < len(raw) and not len(end := np.flatnonzero(_KIND[raw[at:to]] == 2)):
                to = min(len(raw), 2 * to - at)
            to = at + int(end[-1]) + 1 if to < len(raw) else to
            yield Words(raw[at:to], np.array([0, to - at]), lang[a:b]), names
            at = to


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hashes of pairs: the upper half is the first word's, so that a pair's hash says which first word it has."""
    return first & ~_HALF | _extend(first, second) & _HALF


def _lang_hashes(names: list[str]) -> np.ndarray:
    return _hashes(pa.array([n.encode() for n in names], pa.large_binary()))


def pairs(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(h, n): how often each neighbouring pair of words of a language occurs, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, names in _chunks(batch):
                if len(w) < 2:
                    continue
                first = _extend(_lang_hashes(names)[w.lang], w.hash[w.id])[:-1]
                h, n = np.unique(_pair_hashes(first, w.hash[w.id[1:]])[w.piece[1:] == w.piece[:-1]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n})

    counted = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n"))


def marks(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """The field of bits in which the hashes h of frequent are marked: at most bits / 64 rows come to the driver."""
    at = F.pmod(F.col("h"), F.lit(bits))
    words = frequent.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))")).alias("b")).toArrow()
    field = np.zeros(bits // 64, np.int64)
    field[words["word"].to_numpy()] = words["b"].to_numpy()
    return field.view(np.uint64)


def _marked(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(field) * 64 - 1)
    return (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class Trie:
    """Levels of nodes sorted by path: parent (in the level before), word, count, and the path's hash; level 0 is of languages."""

    def __init__(self) -> None:
        self.parent: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.hash: list[np.ndarray] = []

    def add(self, key: np.ndarray, width: int, weight: np.ndarray | None, words: np.ndarray, above: np.ndarray) -> np.ndarray:
        """A level whose nodes are the distinct keys parent * width + word; gives the node of each key. words and above: hashes of words and of the level before."""
        if weight is None:
            key, back, n = np.unique(key, return_inverse=True, return_counts=True)
        else:
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, weight, len(key)).astype(np.int64)  # doubles hold a range's sums exactly up to 2**53
        self.parent.append(key // width)
        self.word.append(key % width)
        self.count.append(n)
        self.hash.append(_extend(above[self.parent[-1]], words[self.word[-1]]))
        return back


def trie(w: Words, langs: np.ndarray, field: np.ndarray) -> Trie:
    """All words and the phrases of marked pairs, counted; langs: the languages' hashes."""
    t = Trie()
    width = max(1, len(w.hash))
    node = t.add(w.lang * width + w.id, width, None, w.hash, langs)
    at, live = np.arange(len(w)), node
    first = _extend(langs[w.lang], w.hash[w.id])
    pair = np.zeros(len(w), bool)
    if len(w) > 1:
        pair[:-1] = (w.piece[1:] == w.piece[:-1]) & _marked(field, _pair_hashes(first[:-1], w.hash[w.id[1:]]))
    for depth in range(1, DEPTH):
        at = at[pair[np.minimum(at + depth - 1, len(w) - 1)] & (at + depth < len(w))]
        live = live[at] if depth == 1 else live[np.searchsorted(was, at)]
        live = t.add(live * width + w.id[at + depth], width, None, w.hash, t.hash[-1])
        was = at
    return t


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _pieces(t: Trie, w: Words, names: list[str], broad: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, the part of the trie in it, serialised): each level's nodes with all those above them, and the words that they need."""
    place = [_range_of(t.hash[0], ranges)]
    wide = np.isin(t.hash[0] >> np.uint64(32), broad)
    for d in range(1, DEPTH):
        place.append(np.where(wide[t.parent[d]], _range_of(t.hash[d], ranges), place[-1][t.parent[d]]) if d == 1 else place[-1][t.parent[d]])
    # A node outside its parent's range needs the parent there too, with no count of its own.
    extra = np.unique(place[1].astype(np.int64) * len(t.word[0]) + t.parent[1]) if len(place[1]) else np.zeros(0, np.int64)
    extra = extra[place[0][extra % max(1, len(t.word[0]))] != extra // max(1, len(t.word[0]))] if len(extra) else extra
    tops = np.concatenate([np.arange(len(t.word[0])), extra % max(1, len(t.word[0]))])
    top_place, top_count = np.concatenate([place[0], (extra // max(1, len(t.word[0]))).astype(np.int32)]), np.concatenate([t.count[0], np.zeros(len(extra), np.int64)])
    order = np.lexsort((tops, top_place))
    tops, top_place, top_count = tops[order], top_place[order], top_count[order]
    orders = [np.argsort(p, kind="stable") for p in place[1:]]
    bounds = [np.searchsorted(top_place, np.arange(ranges + 1)), *[np.searchsorted(p[o], np.arange(ranges + 1)) for p, o in zip(place[1:], orders, strict=True)]]
    for r in np.unique(top_place).tolist():
        above = tops[bounds[0][r] : bounds[0][r + 1]]
        levels = [(t.parent[0][above], t.word[0][above], top_count[bounds[0][r] : bounds[0][r + 1]])]
        for d in range(1, DEPTH):
            own = orders[d - 1][bounds[d][r] : bounds[d][r + 1]]
            levels.append((np.searchsorted(above, t.parent[d][own]), t.word[d][own], t.count[d][own]))
            above = own
        used = np.unique(np.concatenate([x[1] for x in levels]))
        levels = [(p, np.searchsorted(used, x), n) for p, x, n in levels]
        yield r, _written(levels, w.strings.take(pa.array(used)), names)


def _written(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], strings: pa.Array, names: list[str]) -> bytes:
    """Sorted levels as bytes: sizes; then of each level the gaps between parents, words and counts; then lengths and bytes of words; then the languages."""
    raw, off = _text.buffers(strings)
    lang = json.dumps(names).encode()
    head = np.array([*[len(p) for p, _, _ in levels], len(strings), len(lang), *[int(max(n.max(initial=0) >> 31, 0) > 0) for _, _, n in levels]], np.int64)
    parts = [head.tobytes()]
    for (p, x, n), long in zip(levels, head[-len(levels) :], strict=True):
        parts += [np.diff(p, prepend=0).astype(np.int32).tobytes(), x.astype(np.int32).tobytes(), n.astype(np.int64 if long else np.int32).tobytes()]
    return b"".join([*parts, np.diff(off).astype(np.int32).tobytes(), raw.tobytes(), lang])


def _read(data: bytes) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], pa.Array, list[str]]:
    head = np.frombuffer(data, np.int64, 2 * DEPTH + 2)
    at, levels = head.nbytes, []

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    for n, long in zip(head[:DEPTH].tolist(), head[DEPTH + 2 :].tolist(), strict=True):
        gaps, words = take(n, np.int32), take(n, np.int32)
        levels.append((np.cumsum(gaps, dtype=np.int64), words.astype(np.int64), take(n, np.int64 if long else np.int32).astype(np.int64)))
    off = np.append(0, np.cumsum(take(int(head[DEPTH]), np.int32), dtype=np.int64))
    raw = take(int(off[-1]), np.uint8)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw)])
    return levels, strings, json.loads(data[at : at + int(head[DEPTH + 1])])


def _merged(blobs: list[bytes], least: int) -> pa.Table:
    """(lang, words, a, lefts) of the phrases of at least `least` occurrences in one range, and (lang, null, a, null) of all words in it."""
    read = [_read(b) for b in blobs]
    coded = pa.concat_arrays([s for _, s, _ in read]).dictionary_encode()
    ids, strings = np.split(coded.indices.to_numpy(), np.cumsum([len(s) for _, s, _ in read])[:-1]), coded.dictionary
    langs = sorted({n for _, _, names in read for n in names})
    width, none = max(1, len(strings)), np.zeros(max(len(strings), 1), np.uint64)
    t, nodes = Trie(), [np.array([langs.index(n) for n in names]) for _, _, names in read]
    for d in range(DEPTH):
        keys = [nodes[i][levels[d][0]] * width + ids[i][levels[d][1]] for i, (levels, _, _) in enumerate(read)]
        back = t.add(np.concatenate(keys), width, np.concatenate([levels[d][2] for levels, _, _ in read]), none, np.zeros(max(1, len(t.word[-1]) if d else len(langs)), np.uint64))
        nodes = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
    out = {"lang": [], "words": [], "a": [], "lefts": []}
    for k, name in enumerate(langs):
        out["lang"].append(name)
        out["words"].append(None)
        out["a"].append(int(t.count[0][t.parent[0] == k].sum()))
        out["lefts"].append(None)
    decoded = [s.decode() for s in strings.to_pylist()]
    for d in range(DEPTH):
        for node in np.flatnonzero(t.count[d] >= least).tolist():
            out["a"].append(int(t.count[d][node]))
            words, lefts, at = [], [], node
            for up in range(d, -1, -1):  # to the root
                words.append(decoded[t.word[up][at]])
                if up < d:
                    lefts.append(int(t.count[up][at]) or None)
                at = t.parent[up][at]
            out["lang"].append(langs[at])
            out["words"].append(words[::-1])
            out["lefts"].append(lefts[::-1])
    return pa.table([pa.array(out["lang"], pa.string()), pa.array(out["words"], pa.list_(pa.string())), pa.array(out["a"], pa.int64()), pa.array(out["lefts"], pa.list_(pa.int64()))], ["lang", "words", "a", "lefts"])


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, words, a, lefts) of all phrases of 1 to DEPTH words with a >= least occurrences; lefts: those of its first 1, 2, ... words. Rows whose words are null: how many words a range has."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = cut(pairs(docs, text, lang).where(F.col("n") >= least))
    field = spark.sparkContext.broadcast(marks(frequent, bits))
    # first words with more marked pairs than a quarter of a range's share
    by_first = frequent.groupBy(F.shiftrightunsigned("h", 32).alias("first")).agg(F.sum("n").alias("n"))
    total = frequent.agg(F.sum("n")).collect()[0][0] or 0
    broad = spark.sparkContext.broadcast(np.array([r["first"] for r in by_first.where(F.col("n") * 4 * ranges > total).select("first").collect()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, names in _chunks(batch):
                found = list(_pieces(trie(w, _lang_hashes(names), field.value), w, names, broad.value, ranges)) if len(w) else []
                yield pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in found], pa.int32()), "nodes": pa.array([b for _, b in found], pa.binary())})

    tries = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "range int, nodes binary")
    merged = cut(tries.groupBy("range").applyInArrow(lambda group: _merged([b for b in group["nodes"].to_pylist() if b], least), "lang string, words array<string>, a long, lefts array<long>"))
    # the counts of first words whose phrases are in other ranges
    apart = merged.where(F.get("lefts", F.lit(0)).isNull() & (F.size("words") > 1)).select("lang", F.col("words")[0].alias("word")).distinct()
    single = merged.where(F.size("words") == 1).select("lang", F.col("words")[0].alias("word"), F.col("a").alias("own"))
    own = apart.join(single, ["lang", "word"])
    m, o = merged.alias("m"), own.alias("o")
    met = m.join(F.broadcast(o), (F.col("m.lang") == F.col("o.lang")) & (F.get("m.words", F.lit(0)) == F.col("o.word")), "left")
    lefts = F.transform("m.lefts", lambda v, i: F.when(i == 0, F.coalesce(v, F.col("o.own"))).otherwise(v))
    return met.select("m.lang", "m.words", "m.a", lefts.alias("lefts"))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, within: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases; candidates within a longer one of at least `within` % as many occurrences are dropped."""
    counted = cut(phrase_counts(docs, least, text, lang))
    words = counted.where(F.col("words").isNull()).groupBy("lang").agg(F.sum("a").alias("n"))
    known = counted.where(F.col("words").isNotNull())
    size = F.size("words")
    found = known.where(size > 1).select("lang", "words", _phrase(F.col("words")).alias("phrase"), "a", "lefts")
    # suffix links: a phrase and the number of words cut off at its left give the right part
    cuts = found.select("lang", "phrase", "a", F.posexplode("lefts").alias("k", "l"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", _phrase(F.slice("words", F.col("k") + 2, F.size("words"))).alias("right"))
    links = known.select("lang", _phrase(F.col("words")).alias("right"), F.col("a").alias("r"))
    scored = cuts.join(links, ["lang", "right"]).withColumn("whole", _exact("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("parts", (_exact("l") + _exact("r")).cast("decimal(20,0)"))
    scored = scored.withColumn("score", F.expr("cast(whole div parts as bigint)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"))
    # the longest count of a longer candidate around each phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda s: _phrase(F.slice("words", s, n)))))
    around = found.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (_exact("outer") * 100 < _exact("a") * within))
    rows = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    listed = ranked(rows, order, ["lang"]).where(F.col("rank") <= top)
    return listed.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
