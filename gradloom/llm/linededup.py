"""Line deduplication in DataFrame operations only: lines that many documents hold stay in one of them.

A text's lines are what \\n parts; a line's key is the line without white space at both ends, A-Z lower-cased. A key of at least `least`
code points that at least `documents` documents hold loses all its lines, except those of the largest id that holds it.

Keys are 128 bits of hash from the first table on; (document, position, hash) rows are stored, texts aren't. Hashes are partitioned by range and sorted within by id, descending, and position: read in
that order, the first document met of each hash keeps its lines, and a rank over documents says which others come third or later. A hash that holds over one in `SHARE` of all rows would make
one range too long: those are found beforehand by a mergeable sketch of frequent items (at most `HOT` can be found), counted by partial sums instead of being partitioned, and their rows
decided where they lie, by a broadcast of at most `HOT` rows. The sketch only chooses the way; both give the same decisions.

The result is a bitmap of the lines to keep for each document that loses any: words of 64 lines, listed with the number of words of kept lines skipped
before each. Texts are read again only by those who want texts (`clean`) or their digests.

Defined results: a null or empty text is one empty line. Rows with equal ids count as one document; each row's bitmap goes by its own text. Rows with null ids are one document, smaller than all ids. An empty
table gives an empty result. Extra columns are kept by `clean` and otherwise never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm._shared import cut, remove, shared_dir, whole

SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash of over one in SHARE of the rows is counted apart. The sketch tracks TRACKED hashes, so that all such are among its HOT most frequent.
SHARE = 1024
HOT = 2048
TRACKED = 1 << 16


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _lowered(text: Column) -> Column:
    """text with A-Z lower-cased; lower() is faster and the same on ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """(id, hash, pos, h, h2): each line whose key has at least `least` code points; hash is the text's, h and h2 the key's."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.posexplode(lines_of(text)).alias("pos", "line"))
    line = own.withColumn("line", F.trim("line", F.lit(SPACES))).where(F.char_length("line") >= least)
    line = line.withColumn("line", _lowered(F.col("line")))
    return line.select("id", "hash", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _by_ranges(rows: DataFrame, documents: int) -> DataFrame:
    """The rows of `rows` that go, for hashes none of which is hot: ranges of hashes, each sorted by hash, id (largest first) and position."""
    ranges = rows.repartitionByRange("h", "h2").sortWithinPartitions("h", "h2", F.desc_nulls_last("id"), "pos")
    turn = F.dense_rank().over(Window.partitionBy("h", "h2").orderBy(F.desc_nulls_last("id")))
    most = F.max("turn").over(Window.partitionBy("h", "h2"))
    return ranges.withColumn("turn", turn).withColumn("most", most).where((F.col("turn") > 1) & (F.col("most") >= documents))


def _by_sums(rows: DataFrame, hot: DataFrame, documents: int) -> DataFrame:
    """The rows of `rows` that go, for the hot hashes: each one's documents and largest id by partial sums, then a broadcast of at most HOT rows."""
    same = ["h", "h2"]
    own = rows.join(F.broadcast(hot), "h", "left_semi").groupBy(*same, "id").agg(F.lit(1).alias("one"))
    first = own.groupBy(*same).agg(F.count("*").alias("n"), F.max("id").alias("first")).where(F.col("n") >= documents).select(*same, "first")
    # a hot h may stand for several keys, but each of these with its own h2; only frequent ones matter
    return rows.join(F.broadcast(first), same).where(~F.col("id").eqNullSafe(F.col("first")))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(id, hash, n_dropped, keep) of each document, by id and text's hash, that loses a line; keep: array of (skip, bits), the words of 64 lines in which any goes."""
    spark, folder = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    try:
        hashed_lines(docs, key, text, least).write.parquet(folder)
        rows = spark.read.parquet(folder)
        total = rows.count()
        frequent = rows.select(F.expr(f"approx_top_k(h, {HOT}, {TRACKED})").alias("t")).select(F.inline("t")).where(F.col("count") * SHARE > total)
        hot = spark.createDataFrame([(r[0],) for r in frequent.select("item").collect()], "h long")
        gone = _by_ranges(rows.join(F.broadcast(hot), "h", "left_anti"), documents).select("id", "hash", "pos")
        gone = gone.union(_by_sums(rows, hot, documents).select("id", "hash", "pos"))
        word = F.shiftright("pos", 6)
        # one shuffle: both sums below go by the document
        words = gone.repartition("id", "hash").groupBy("id", "hash", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
        sparse = words.groupBy("id", "hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("words"), i - 1)["word"])
        keep = F.transform("words", lambda w, i: F.struct((w["word"] - before(i) - 1).alias("skip"), F.bitwise_not(w["bits"]).alias("bits")))
        return cut(sparse.select("id", "hash", "n_dropped", keep.alias("keep")))
    finally:
        remove(spark, folder)


def kept_text(text: str, keep: str) -> Column:
    """The text without the lines that go; keep is null where none does."""
    # the words of the bitmap one after another, the skipped ones whole
    words = F.flatten(F.transform(keep, lambda w: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["skip"]), F.array(w["bits"]))))
    stays = lambda words, i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
    left = F.transform(F.array(words), lambda held: F.array_join(F.filter(lines_of(text), lambda _, i: F.getbit(stays(held, i), i.bitwiseAND(63)) == 1), "\n"))
    return F.when(F.col(keep).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(left[0])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """columns (of docs), text, n_dropped and keep for each row of docs."""
    d = docs.select(*columns, F.col(text).alias("_text"), F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash")).alias("d")
    b = bitmaps.alias("b")
    met = d.join(b, F.col("d._id").eqNullSafe(F.col("b.id")) & (F.col("d._hash") == F.col("b.hash")), "left")
    return met.select("d.*", F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "b.keep").drop("_id", "_hash")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """docs, all columns, with the lines gone from their texts; a text that loses none stays as it is."""
    met = with_bitmaps(docs, keep_bitmaps(docs, key, text, least, documents), [whole(docs).alias("row")], key, text)
    new = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(kept_text("_text", "keep"))
    return met.select(F.col("row").withField(text, new).alias("row")).select("row.*")


def digests(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of each row of docs."""
    met = with_bitmaps(docs, bitmaps, [F.col(key)], key, text)
    lines = (F.char_length(F.coalesce("_text", F.lit(""))) - F.char_length(F.replace(F.coalesce("_text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return met.select(key, lines.alias("n_lines"), "n_dropped", F.sha2(kept_text("_text", "keep").cast("binary"), 256).alias("kept_sha256"))
