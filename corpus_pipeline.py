"""A training corpus from raw documents: language, quality, near duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return the columns of
documents; the last returns the token ids. Models are learnt anew from the stage's own rows; labels come from sf_dir.

Rows with nulls, empty and repeated texts, empty tables and further columns of any name pass through as each stage's operator says: a text that is
null or has no letter goes at the first stage, rows with null ids are documents of their own until near-dedup, and further columns are kept up to encoding.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import langid, minhash, mixing, quality, spm
from gradloom.llm._shared import held_out, remove, shared_dir

#: Documents of at least this Jaccard similarity on five-word shingles are near duplicates.
SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose most probable language has a probability under one half, go."""
    return langid.keep_identified(docs, langid.fit(docs, ~held_out("doc_id", 3, 1)))


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the quality threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, ~held_out("doc_id", 4, 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return minhash.keep_first(docs, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: never, once or twice."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each document."""
    ids = spm.encode(docs, spm.Model.load(public_tokenizers.path("piece_bpe_32k.model")), ["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", select_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_tokens),
]

#: Trained models and a tokenizer's pieces aren't expressible in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored in the shared folder before the next begins."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
