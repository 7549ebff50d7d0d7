"""SentencePiece encoding and decoding with a given model, by batched numpy Viterbi.

A text is escaped as the model asks (a blank in front, blanks as U+2581) and cut into words, each with the blanks before
it; no piece reaches over the start of a word. Words of equal length advance together, one character at a time: the hashes of all
substrings that end there probe the sorted hashes of the pieces, and the best of the candidates becomes the backpointer.

For a unigram model the best is the one of largest total score. For a BPE model the score of a candidate is whether merging would have
ended there: a sequence of pieces is what BPE makes of a text exactly if each piece is what BPE makes of that piece and each two neighbours are what it
makes of the two, so every prefix has one valid last piece. Both give the ids that the sentencepiece library gives. Words
with runs of blanks, whose pieces tie in rank, are merged one by one.

A word met before is looked up by its hash. Characters without a piece fall back to bytes, or to the unknown piece if the model has none.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; null ids decode to null. Ids outside the model
raise ValueError. Models with a character map for normalising, or that drop blanks, raise ValueError. Repeated rows get equal ids. Other columns are never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.llm import _text

SPACE = "▁"
#: Places in a worker's tables of words and of pairs, and ids held before it starts anew.
SLOTS = 1 << 20
HELD = 1 << 23
PIECE = 1 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_START, _NONE = -2, -1


@dataclass
class Model:
    """pieces with their types and scores; bpe says whether to merge by rank rather than add scores."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    bpe: bool
    dummy_prefix: bool = True

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(Path(path).read_bytes())
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models have pieces to search")
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that normalise characters, drop blanks or put them behind words aren't supported")
        model = Model([p.piece for p in m.pieces], [p.type for p in m.pieces], [p.score for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix)
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL):
            raise ValueError("models with pieces that reach over blanks aren't supported")
        return model


class Codec:
    """A worker's tables for a model."""

    def __init__(self, model: Model) -> None:
        self.model, n = model, len(model.pieces)
        self.rank = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.bytes = np.full(256, self.unknown, np.int32)
        self.fallback = False
        for i, k in enumerate(model.kinds):
            if k == BYTE:
                self.bytes[int(model.pieces[i][3:5], 16)] = i
                self.fallback = True
        self.longest = max((len(p) for p in self.id), default=1)
        if any(c not in self.id for p in self.id if len(p) > 1 for c in p) and model.bpe:
            raise ValueError("a piece has a character without a piece")
        codes = [np.array([ord(c) for c in p], np.uint64) for p in self.id]
        powers = _text._table(self.longest + 1)[0]
        keys = np.array([int(((c + np.uint64(1)) * powers[: len(c)]).sum(dtype=np.uint64)) for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.fromiter(self.id.values(), np.int32, len(self.id))[order]
        self.score = np.array(model.scores + [min(self.rank.values(), default=0.0) - 10.0])
        self.whole = np.ones(n + 1, bool)
        if model.bpe:
            for p, i in self.id.items():
                self.whole[i] = len(p) < 3 or SPACE * 2 in p or self.merge(p) == [p]
        out = [b"" if k in (CONTROL,) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_off = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)
        self.pair_key, self.pair_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.clear()

    def clear(self) -> None:
        self.held, self.place, self.ids, self.used = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, 2), np.int32), np.zeros(1 << 16, np.int32), 0

    def merge(self, word: str) -> list[str]:
        """What BPE makes of word: the best-ranked pair merges first, the leftmost of equals."""
        n, rank = len(word), self.rank
        parts: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank, left part's place, both parts as they were): a pair whose parts have merged since is passed over
        heap = [(-r, i, word[i], word[i + 1]) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _compatible(self, pair: np.ndarray) -> np.ndarray:
        """For each left * pieces + right, whether BPE leaves the two as they are."""
        n = len(self.model.pieces)
        slot = (_text.mix(pair.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != pair)
        if len(miss):
            kinds, inverse = np.unique(pair[miss], return_inverse=True)
            p = self.model.pieces
            new = np.array([self.merge(p[k // n] + p[k % n]) == [p[k // n], p[k % n]] for k in kinds.tolist()], bool)
            own = (_text.mix(kinds.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
            self.pair_key[own], self.pair_ok[own] = kinds, new
            ok[miss] = new[inverse]
        return ok

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, id or -1 - code point of one without a piece) of the pieces of the rows of points, in order."""
        rows, length = points.shape
        n = len(self.model.pieces)
        power, inverse = _text._table(length + 1)
        h = np.zeros((rows, length + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:length], axis=1, out=h[:, 1:])
        last = np.full((rows, length + 1), _NONE, np.int64)
        last[:, 0] = _START
        back = np.zeros((rows, length + 1), np.int32)
        total = np.zeros((rows, length + 1))
        all_rows = np.arange(rows)
        for j in range(1, length + 1):
            at = j - np.arange(1, min(self.longest, j) + 1)  # where the last piece may start, shortest piece first
            key = (h[:, j][:, None] - h[:, at]) * inverse[at]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            piece = np.where(hit, self.key_id[pos], _NONE).astype(np.int64)
            piece[~hit[:, 0], 0] = n  # a character without a piece
            before = last[:, at]
            valid = (piece >= 0) & (before != _NONE)
            if self.model.bpe:
                valid &= self.whole[piece]
                ask = valid & (before >= 0) & (before < n) & (piece < n)
                valid[ask] = self._compatible(before[ask] * n + piece[ask])
                best = valid.argmax(1)
            else:
                best = np.where(valid, total[:, at] + self.score[piece], -np.inf).argmax(1)
                total[:, j] = total[all_rows, at[best]] + self.score[piece[all_rows, best]]
            last[:, j] = np.where(valid[all_rows, best], piece[all_rows, best], _NONE)
            back[:, j] = best + 1
        if (last[:, length] == _NONE).any():
            raise AssertionError("a word has no valid pieces")
        ends = np.zeros((rows, length + 1), bool)
        j = np.full(rows, length)
        while (live := np.flatnonzero(j > 0)).size:
            ends[live, j[live]] = True
            j[live] -= back[live, j[live]]
        r, c = np.nonzero(ends)
        piece = last[r, c]
        lost = piece == n
        piece[lost] = -1 - points[r[lost], c[lost] - 1].astype(np.int64)
        return r, piece

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); blanks in words are escaped."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.array([len(w) for w in words])
        special = np.array([self.model.bpe and w[:2] == SPACE * 2 for w in words], bool)
        for length in np.unique(size[~special]).tolist():
            at = np.flatnonzero((size == length) & ~special)
            points = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), length)
            r, piece = self.viterbi(points)
            found.append((at[r], piece))
        for i in np.flatnonzero(special).tolist():
            parts = self.merge(words[i])
            found.append((np.full(len(parts), i), np.array([self.id.get(p, -1 - ord(p[0])) for p in parts], np.int64)))
        owner, piece = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(owner, kind="stable")
        owner, piece = owner[order], piece[order]
        lost = np.flatnonzero(piece < 0)
        if len(lost):
            raw = [self.bytes[np.frombuffer(chr(-1 - p).encode("utf-8", "surrogatepass"), np.uint8)] if self.fallback else np.array([self.unknown], np.int32) for p in piece[lost].tolist()]
            many = np.ones(len(piece), np.int64)
            many[lost] = [len(x) for x in raw]
            start = np.cumsum(many) - many
            owner, wide = np.repeat(owner, many), np.repeat(piece, many)
            wide[np.repeat(start[lost], many[lost]) + np.concatenate([np.arange(len(x)) for x in raw])] = np.concatenate(raw)
            piece = wide
            if not self.fallback:  # neighbouring unknown characters are one unknown piece
                again = np.zeros(len(piece), bool)
                again[1:] = (piece[1:] == self.unknown) & (piece[:-1] == self.unknown) & (owner[1:] == owner[:-1])
                owner, piece = owner[~again], piece[~again]
        return piece.astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, their ids) of a plain() array."""
        texts = pc.replace_substring(texts, SPACE, " ")
        if self.model.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        raw, off = _text.buffers(texts)
        blank = raw == 32
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(raw))
        h = _spans(raw, starts, ends)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        place = self.place[slot]
        miss = np.flatnonzero(self.held[slot] != h)
        if len(miss):
            kinds, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            data, at = raw.tobytes(), miss[where]
            flat, count = self.encode_words([data[a:b].decode().replace(" ", SPACE) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], flat, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            new = np.stack([self.used + np.cumsum(count) - count, count], 1).astype(np.int32)
            self.used += len(flat)
            own = (kinds & np.uint64(SLOTS - 1)).astype(np.int64)
            self.held[own], self.place[own] = kinds, new
            place[miss] = new[inverse]
        first, size = place[:, 0].astype(np.int64), place[:, 1].astype(np.int64)
        before = np.append(0, np.cumsum(size))
        out = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        out_off = before[np.searchsorted(starts, off)]
        if self.used > HELD:
            self.clear()
        return out_off, out

    def decode(self, off: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of lists of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.model.pieces)):
            raise ValueError("an id isn't in the model")
        size = self.out_off[ids + 1] - self.out_off[ids]
        before = np.append(0, np.cumsum(size))
        raw = self.out[np.repeat(self.out_off[ids] - before[:-1], size) + np.arange(before[-1])].tobytes()
        bounds, lead = before[off].tolist(), self.model.dummy_prefix
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [t[1:] if lead and t[:1] == " " else t for t in texts]


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of raw[starts:ends], which cover raw in order."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + _text.BLOCK, "right")))
        part = raw[starts[k] : ends[to - 1]]
        power, inverse = _text._table(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        a, b = starts[k:to] - starts[k], ends[k:to] - starts[k]
        out[k:to] = _text.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        k = to
    return np.maximum(out, np.uint64(1))


def _codec(model: Model, held: dict = {}) -> Codec:  # noqa: B006
    """The worker's codec for a model, made once."""
    key = hash((tuple(model.pieces), tuple(model.kinds), tuple(model.scores), model.bpe, model.dummy_prefix)) if id(model) not in held else id(model)
    if key not in held:
        held.clear()
        held[key] = held[id(model)] = Codec(model)
        held["model"] = model  # keeps the id taken
    return held[key]


def encode(docs: DataFrame, model: Model, keep: list[str], text: str = "text", to: str = "ids") -> DataFrame:
    """The columns `keep` of docs, with the ids of their texts in column `to`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(to, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            texts = _text.plain(batch.column(len(keep)))
            for a, b in _text.slices(texts, PIECE):
                off, ids = codec.encode(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], [*keep, to])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, with ids, the crc32 of the text decoded from them, and whether it is the text (null: empty), in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            texts = _text.plain(batch.column(len(keep)))
            for a, b in _text.slices(texts, PIECE):
                own = texts.slice(a, b - a)
                off, ids = codec.encode(own)
                back = codec.decode(off, ids.astype(np.int64))
                same = [x == y for x, y in zip(back, own.to_pylist(), strict=True)]
                crc = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in back]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], schema.fieldNames())

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, keep: list[str], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The columns `keep` of rows, with the texts of their ids in column `to`."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep).schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(len(keep))
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                texts = pa.array(codec.decode(np.append(0, np.cumsum(size)).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pc.if_else(pc.is_valid(lists), texts, pa.scalar(None, pa.string()))], [*keep, to])

    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
