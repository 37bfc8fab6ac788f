"""Corpus pipeline: five stages from raw documents to token digests, each written and read again.

Language identification (rejected documents go), exact dedup, n-gram Jaccard join (one document of each
group stays), benchmark decontamination, byte-level BPE encoding and decoding. All stages but the last
return the columns of documents; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from lodestack.llm._spark import dropped, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from docs themselves, does not reject."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.keep_one_of_each(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the one with the least doc_id."""
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text."""
    return byte_bpe.encode_digests(docs, byte_bpe.public_bpe())


STAGES = [
    ("language_id", identified),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: Models and merges have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
