"""The corpus pipeline: language ID, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents.

Defined results: documents with null or empty text, or without a letter, go in the first stage; a null lang or source is kept as it is (a null source is one of its own); of equal
texts and of linked ones the least id stays, rows that repeat an id stay or go together, rows with null id always stay; mixing repeats rows as they are, so the last stage
has a row for each copy; very long texts are judged, redacted and encoded whole; further columns, whatever their names, are kept until the last stage; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, langid, mixing, ngram_join, secrets
from pixelloom.llm.common import scratch_path, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, or no letter in it); the model learns from the labelled documents that are not held out."""
    return langid.keep_identified(docs, langid.trained_on_rest(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that is linked by n-gram Jaccard similarity."""
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark and counts the characters anew; no document is dropped."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come to their target weights; a row for each copy."""
    return mixing.mix(docs)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with digests of the ids and of the bytes that they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_decode),
]

#: The model's training and the tokenizer can't be put into SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
