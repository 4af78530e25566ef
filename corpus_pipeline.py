"""The corpus pipeline: each stage reads what its predecessor kept.

``run`` writes each stage's documents to the shared folder and reads them back,
so that a lost executor costs tasks of one stage and not the run.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import byte_bpe, exact_dedup, language_id, ngram_join, source_mixing
from tidemark.llm.common import table
from tidemark.session import staged


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or torn between two languages, go."""
    return language_id.keep_known(docs, language_id.fit(language_id.learnable(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingles connect, the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by rates that bring the domains to their target weights."""
    return source_mixing.resample(docs, source_mixing.domains_of(table(spark, sf_dir, "labels")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    whole = F.sha2(F.col("decoded.bytes"), 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", whole.alias("round_trip")
    )


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_domains),
    ("byte-level BPE", tokenise),
]

#: Compression sizes, classifier posteriors and byte-pair merges can't be said in SQL; tests/llm holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
