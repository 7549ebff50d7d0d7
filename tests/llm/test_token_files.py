"""Token files: what a worker and a block hold, shards of odd ids."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradloom.llm import _text, tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_met_again_stay_and_tables_are_bounded(monkeypatch):
    most = 4 * tokenbin.KNOWN
    monkeypatch.setattr(tokenbin, "KNOWN", 1 << 14)
    t, e = Tokenizer.from_file(PATH), tokenbin.WordEncoder(Path(PATH).read_bytes())
    rare, common, own, asked = random.Random(3), [f"common{k}" for k in range(50)], e._encode_words, []
    monkeypatch.setattr(e, "_encode_words", lambda words: asked.extend(words) or own(words))
    for _ in range(12):
        x = [" ".join([*common, *("".join(rare.choices("bcdfghjklmnp", k=9)) for _ in range(600)), *common]) for _ in range(2)]
        off, ids = e.encode(_text.plain(pa.array(x)), 1)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*t.encode(s, add_special_tokens=False).ids, 1] for s in x]
        assert e.used <= 1 << 14
    assert sum(w in common for w in asked) == len(common)  # each once, though the table was full several times
    assert e.held.nbytes + e.place.nbytes + most < 80e6


def test_shards_and_blocks_of_odd_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "BLOCK", 200)
    t, big = Tokenizer.from_file(PATH), (1 << 63) - 1
    ids = [*range(-40, 40), *[7] * 60, None, None, big, -big - 1, big - 1, 1 << 53, (1 << 53) + 1]
    rows = [(k, [None, "", f"text {i % 9} of {k}", "word " * (i % 50)][i % 4]) for i, k in enumerate(ids)]
    folder = str(tmp_path / "f")
    tokenbin.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, PATH, 1, partitions=6)
    got = tokenbin.read_ids(spark, folder).orderBy("start").collect()
    want = sorted(((k, [*t.encode(s or "", add_special_tokens=False).ids, 1]) for k, s in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sorted((r["start"], r["ids_crc32"]) for r in tokenbin.read_index(spark, folder).collect()) == [(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got]
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.select("shard").distinct().count() > 3
    assert blocks.where(F.expr("offsets[size(offsets) - 2]") >= 200).count() == 0  # a block ends with the frame that fills it
    one = [(5, "a b"), (5, None), (5, "a b")]
    tokenbin.write(spark.createDataFrame(one, "doc_id long, text string"), str(tmp_path / "one"), PATH, 1, partitions=4)
    assert [(r["doc_id"], r["start"]) for r in tokenbin.read_index(spark, str(tmp_path / "one")).orderBy("start").collect()][0] == (5, 0)
