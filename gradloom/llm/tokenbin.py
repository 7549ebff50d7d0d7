"""Token ids in compressed binary files with access to single documents.

`write` encodes each text with a tokenizers file, appends an end id, and stores the ids as little-endian
16- or 32-bit numbers, each document compressed on its own by zstandard with one dictionary that all
share. The dictionary is trained on the ids of a bounded sample of about `SAMPLE` documents chosen by hash.

A written folder holds two Parquet tables:

- `dictionary`: one row (dict_sha256, dictionary, tokenizer_sha256, end_id, width);
- `blocks`: rows (shard, block, before, dict_sha256, doc_ids, n_tokens, offsets, payload). Shards hold ascending ranges of
  document ids, blocks ascending runs of about `BLOCK` bytes in them, before counts the shard's ids in earlier blocks.
  payload is the documents' frames, one after another; frame k is payload[offsets[k] : offsets[k + 1]].

Texts are encoded and compressed where they are read; only frames are dealt to the shards and sorted. The borders
between shards are quantiles of about `BORDER` document ids a shard, chosen by hash; every row goes to its shard.

Spark's own writer commits the files, so lost executors leave no torn file, and any store that Spark
reaches will do. `read_ids` gives all ids back in order, `read_document` one document's with the dictionary and one frame.

White space never joins two tokens of the tokenizer, so words between blanks, tabs and line ends are
encoded once and looked up by hash afterwards; the ids are those of the whole text.

Defined results: a null or empty text has the end id alone. Repeated ids stand beside each other in order of their texts' hashes;
null ids come first. An empty table writes empty tables. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradloom.llm import _text
from gradloom.llm._shared import small_batches, unit

SAMPLE = 2000
DICTIONARY = 64 << 10
BORDER = 100
BLOCK = 1 << 18
LEVEL = 3
#: Places for words in a worker's table, and the ids that it holds at most before it keeps only words met again.
SLOTS = 1 << 21
KNOWN = 1 << 23
PIECE = 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True


class WordEncoder:
    """Encodes plain() arrays of texts word by word; a word met before is looked up by its hash.

    The table has a slot for each value of the hash's low bits. A word takes the place of another in its slot, unless that was met again since another wanted the place.
    """

    def __init__(self, tokenizer_json: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # A special token that is found whatever surrounds it parts words, so that one call encodes many.
        marks = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[-1] if marks else None
        self.clear()

    def clear(self) -> None:
        self.held, self.place, self.ids = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, 2), np.int32), np.zeros(1 << 16, np.int32)
        self.used, self.again = 0, np.zeros(SLOTS, bool)

    def forget(self) -> None:
        """Keep only the words met again lately; all, if these alone are too many."""
        slot = np.flatnonzero(self.again)
        first, size = self.place[slot, 0].astype(np.int64), self.place[slot, 1].astype(np.int64)
        held, before = self.held[slot], np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        self.clear()
        if 2 * len(ids) <= KNOWN:
            self.held[slot], self.place[slot] = held, np.stack([before[:-1], size], 1)
            self.ids, self.used = np.concatenate([ids, self.ids]), len(ids)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        if self.mark is None or any(self.mark[1] in w for w in words):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.int32), np.array([len(x) for x in got], np.int64)
        joined = [self.mark[1].join(words[i : i + 256]) + self.mark[1] for i in range(0, len(words), 256)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark[0])
        return flat[flat != self.mark[0]], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, their ids with the end id)."""
        raw, off, starts, ends, h = _text.words(texts, _GAP)
        h = np.maximum(h, np.uint64(1))  # 0 marks a free slot
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        place = self.place[slot]
        found = self.held[slot] == h
        self.again[slot[found]] = True
        miss = np.flatnonzero(~found)
        if len(miss):
            kinds, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            data, at = raw.tobytes(), miss[where]
            flat, count = self._encode_words([data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], flat, np.zeros(len(self.ids), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            new = np.stack([self.used + np.cumsum(count) - count, count], 1).astype(np.int32)
            self.used += len(flat)
            own = (kinds & np.uint64(SLOTS - 1)).astype(np.int64)
            free = ~self.again[own]
            self.again[own] = False
            self.held[own[free]], self.place[own[free]] = kinds[free], new[free]
            place[miss] = new[inverse]
        first, size = place[:, 0].astype(np.int64), place[:, 1].astype(np.int64)
        doc, n = _text.owner(off), len(off) - 1
        before = np.append(0, np.cumsum(size))
        total = np.bincount(doc, size, minlength=n).astype(np.int64) + 1
        out_off = np.append(0, np.cumsum(total))
        out = np.full(int(out_off[-1]), end_id, np.int32)
        out[np.repeat(doc, size) + np.arange(before[-1])] = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        if self.used > KNOWN:
            self.forget()
        return out_off, out


def _encoder(tokenizer_json: bytes, held: dict = {}) -> WordEncoder:  # noqa: B006
    """The worker's encoder for a tokenizer, made once."""
    key = hashlib.sha256(tokenizer_json).digest()
    if key not in held:
        held.clear()
        held[key] = WordEncoder(tokenizer_json)
    return held[key]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of samples; where there is too little to train on, their bytes themselves."""
    if sum(map(len, samples)) < 256:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> dict:
    """Arguments for zstandard's (de)compressors."""
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Write docs' token ids to folder; tokenizer is the path of a tokenizers file on the driver."""
    spark = docs.sparkSession
    spec = Path(tokenizer).read_bytes()
    held = spark.sparkContext.broadcast(spec)
    width = 2 if max(WordEncoder(spec).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            texts = _text.plain(batch.column(0))
            for a, b in _text.slices(texts, PIECE):
                off, ids = encoder.encode(texts.slice(a, b - a), end_id)
                data = ids.astype(f"<u{width}")
                yield pa.RecordBatch.from_pydict({"ids": pa.array([data[off[i] : off[i + 1]].tobytes() for i in range(b - a)], pa.binary()), "at": batch.column(1).slice(a, b - a)})

    small_batches(spark)
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    total, cores = sum(parts), spark.sparkContext.defaultParallelism
    if 0 < len(parts) < cores:  # one file or row group: its texts are dealt to all cores first
        rows = rows.repartition(cores)
    sample = rows.where(unit("doc_id", 10) < min(1.0, SAMPLE / max(1, total))).select("text", F.xxhash64("doc_id", "text"))
    got = sample.mapInArrow(serialise, "ids binary, at long").toArrow().sort_by([("at", "ascending"), ("ids", "ascending")])
    dictionary = train_dictionary(got["ids"].to_pylist())
    sha = hashlib.sha256(dictionary).hexdigest()
    table = spark.createDataFrame([(sha, bytearray(dictionary), hashlib.sha256(spec).hexdigest(), end_id, width)], "dict_sha256 string, dictionary binary, tokenizer_sha256 string, end_id long, width int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")
    shards = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((dictionary, _borders(rows, total, shards)))
    schema = "shard int, block int, before long, dict_sha256 string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (own, borders) = _encoder(held.value), shared.value
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False, **_dictionary(own))
        for batch in batches:
            texts = _text.plain(batch.column(1))
            for a, b in _text.slices(texts, PIECE):
                off, flat = encoder.encode(texts.slice(a, b - a), end_id)
                data, docs = flat.astype(f"<u{width}"), batch.column(0).slice(a, b - a)
                shard = np.where(docs.is_null(), 0, np.searchsorted(borders, docs.fill_null(0).to_numpy(), "right"))
                frames = [press.compress(data[off[i] : off[i + 1]].tobytes()) for i in range(b - a)]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "doc_id": docs, "at": batch.column(2).slice(a, b - a), "n_tokens": pa.array(np.diff(off), pa.int64()), "frame": pa.array(frames, pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, ids, tokens, frames, size = 0, 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = np.append(0, np.cumsum([len(f) for f in frames])).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()), "dict_sha256": [sha], "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([tokens], pa.list_(pa.int64())), "offsets": pa.array([offsets], pa.list_(pa.int64())), "payload": pa.array([b"".join(frames)], pa.binary()),
            })

        for batch in batches:
            for shard, doc, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):  # a task has one shard
                frames.append(frame)
                ids.append(doc)
                tokens.append(n)
                size += len(frame)
                if size >= BLOCK:
                    yield flush()
                    block, before = block + 1, before + sum(tokens)
                    ids, tokens, frames, size = [], [], [], 0
        if ids:
            yield flush()

    pressed = rows.select("doc_id", "text", F.xxhash64("text").alias("at")).mapInArrow(framed, "shard int, doc_id long, at long, n_tokens long, frame binary")
    dealt = pressed.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "at").select("shard", "doc_id", "n_tokens", "frame")
    dealt.mapInArrow(pack, schema).write.mode("overwrite").parquet(f"{folder}/blocks")


def _borders(rows: DataFrame, total: int, shards: int) -> np.ndarray:
    """Ascending ids that part the rows into ranges of about equal size: a shard has those from one border up to the next."""
    sample = rows.where(F.col("doc_id").isNotNull() & (unit("doc_id", 20) < min(1.0, BORDER * shards / max(1, total)))).select("doc_id")
    found = np.sort(sample.toArrow()["doc_id"].to_numpy())
    return found[np.arange(1, shards) * len(found) // shards] if len(found) else found


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes, str, int]:
    """(blocks, dictionary, its hash, bytes per id) of a written folder; the hash is checked."""
    row = spark.read.parquet(f"{folder}/dictionary").collect()[0]
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"{folder}: the dictionary doesn't match its hash")
    return spark.read.parquet(f"{folder}/blocks"), data, row["dict_sha256"], row["width"]


def _unpacked(blocks: DataFrame, data: bytes, sha: str, width: int, schema: str, row) -> DataFrame:  # noqa: ANN001
    """One row for each document of blocks (start, dict_sha256, doc_ids, n_tokens, offsets, payload); row gives its columns from its ids."""
    shared = blocks.sparkSession.sparkContext.broadcast(data)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor(**_dictionary(shared.value))
        for batch in batches:
            for b in range(batch.num_rows):
                r = batch.slice(b, 1)
                start, own, docs, tokens, offsets = (r.column(k)[0].as_py() for k in range(5))
                if own != sha:
                    raise ValueError(f"a block was written with dictionary {own}")
                payload, out = memoryview(r.column(5)[0].as_buffer()), []
                for k, doc in enumerate(docs):
                    ids = np.frombuffer(inflate.decompress(payload[offsets[k] : offsets[k + 1]]), f"<u{width}")
                    if len(ids) != tokens[k]:
                        raise ValueError(f"document {doc} has {len(ids)} ids where the index says {tokens[k]}")
                    out.append((doc, start, len(ids), *row(ids)))
                    start += len(ids)
                for a in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out[a : a + 1000], strict=True), strict=True)}, schema=kinds)

    kinds = pa.schema([(n, {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
    return blocks.select("start", "dict_sha256", "doc_ids", "n_tokens", "offsets", "payload").mapInArrow(run, schema)


def _placed(blocks: DataFrame) -> DataFrame:
    """blocks with start, the ids of all documents before the block; only a sum for each shard is broadcast, so payloads stay where they are read."""
    per = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    base = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(F.broadcast(per.select("shard", base.alias("base"))), "shard").withColumn("start", F.col("base") + F.col("before"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in folder."""
    blocks, *rest = _opened(spark, folder)
    return _unpacked(_placed(blocks), *rest, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: (ids.astype(np.int32),))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in folder, all from its stored frame."""
    blocks, *rest = _opened(spark, folder)
    return _unpacked(_placed(blocks), *rest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the document (or documents, if the id repeats): only their frames are decompressed, but the id lists and payloads of all blocks are scanned for them."""
    blocks, data, _, width = _opened(spark, folder)
    inflate, out = zstandard.ZstdDecompressor(**_dictionary(data)), []
    near = blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("shard", "block", F.posexplode("doc_ids").alias("k", "doc"), "offsets", "payload").where(F.col("doc") == doc_id)
    frame = F.expr("substring(payload, offsets[k] + 1, offsets[k + 1] - offsets[k])")
    for r in near.select(frame.alias("frame"), "shard", "block", "k").orderBy("shard", "block", "k").collect():
        out.append(np.frombuffer(inflate.decompress(bytes(r["frame"])), f"<u{width}").tolist())
    return out
