"""The corpus queries: thin, whole tables, production parameters."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, license_scan, ngram_join, prefix_trie, quality_rules, source_mixing, token_alignment, token_counts, token_files, url_filter
from tidemark.llm.common import table
from tidemark.llm.oracles import ORACLES  # noqa: F401
from tidemark.session import staged, work_dir

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@query
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = staged(url_filter.listed_urls(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, listed)


@query
def op3_license_scan(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op6_token_files(spark, sf_dir):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_files.write_and_check(spark, table(spark, sf_dir, "documents"), work_dir(spark, "tokens"), vocabulary)


@query
def op7_ngram_join(spark, sf_dir):
    return ngram_join.members(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(language_id.learnable(docs)))


@query
def op9_token_counts(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.by_section(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op10_source_mixing(spark, sf_dir):
    labels = source_mixing.domains_of(table(spark, sf_dir, "labels"))
    return source_mixing.mix(table(spark, sf_dir, "documents"), labels)


@query
def op11_token_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
