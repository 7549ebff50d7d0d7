"""The registered queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import embed_dedup, htmlmain, importance, langid, linededup, media, minhash, mixing, phrases, quality, spm, tokenbin, toxicity
from gradloom.llm._shared import held_out, shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    net = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~out)
    return toxicity.detect(docs, net, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), similarity=0.85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = spm.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    both = spm.round_trip(_read(spark, sf_dir, "documents"), model, ["doc_id"])
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_crc32", "round_trip")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = langid.fit(docs, ~out)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), ~out)
    return quality.judge(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_column(_read(spark, sf_dir, "documents"))
    return media.digests(media.audio_features(stored, keep=("n_bytes",)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(_read(spark, sf_dir, "pages"), htmlmain.train(), ["page_id", "url"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenbin.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.read_index(spark, folder)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return linededup.digests(docs, linededup.keep_bitmaps(docs))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_minhash, op3_sentencepiece, op4_mix, op5_langid, op6_quality, op7_media, op8_embeddings, op9_html, op10_token_files, op11_importance, op12_lines, op13_phrases)
    return {f.__name__: f for f in own}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 byte by byte over a table of 256 steps, of distinct words only.
_BUCKETS = (
    "steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))), "
    "bytes AS (SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT word FROM w)), "
    "k AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps)"
)
_WORDS = f"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_IMPORTANCE = (
    f"WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, coalesce({_WORDS}, []) AS ws FROM documents), dw AS MATERIALIZED (SELECT i, unnest(ws) AS word FROM d), bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark), w AS (SELECT word FROM dw UNION SELECT word FROM bw), {_BUCKETS}, "
    "own AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (word) GROUP BY 1), target AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (word) GROUP BY 1), size AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t), "
    "g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(target.t, 0) + 1)::DOUBLE * (size.s + 10000)::DOUBLE / ((coalesce(own.s, 0) + 1)::DOUBLE * (size.t + 10000)::DOUBLE)))::BIGINT AS gain FROM own FULL JOIN target USING (bucket), size), "
    "x AS (SELECT d.doc_id, len(d.ws)::BIGINT AS n_features, coalesce(v.weight, 0)::BIGINT AS weight FROM d LEFT JOIN (SELECT i, sum(gain) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY i) v ON d.i = v.i), "
    "y AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM z"
)

_LINES = (
    "WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents), "
    f"k AS MATERIALIZED (SELECT doc_id, pos, line, {_LOWER.replace('text', 'trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))')} AS key FROM l), "
    "f AS (SELECT key, max(doc_id) AS keeps FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3) "
    "SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeps <> doc_id)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeps IS NULL OR keeps = doc_id), '')) AS kept_sha256 FROM k LEFT JOIN f USING (key) GROUP BY doc_id"
)

_PHRASES = (
    f"WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), "
    "g AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (" + " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(list_slice(w, i, i + {m - 1}), ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM w)" for m in (1, 2, 3, 4)) + ") GROUP BY ALL HAVING count(*) >= 30), "
    "n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang), c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m > 1), "
    "cuts AS (SELECT lang, m, phrase, a, ws, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)), "
    "s AS (SELECT cuts.*, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = lp JOIN g y ON y.lang = cuts.lang AND y.phrase = rp), "
    "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), "
    "o AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, array_to_string(list_slice(ws, i, i + j - 1), ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2))) GROUP BY ALL), "
    "q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE coalesce(100 * around::HUGEINT < 80 * a::HUGEINT, true)) "
    "SELECT q.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000"
)


def oracle_sql() -> dict[str, str]:
    """Trained models, signatures, files and clusters aren't expressible; the tests hold those operators against plain versions."""
    return {"op11_importance": _IMPORTANCE, "op12_lines": _LINES, "op13_phrases": _PHRASES}
