"""Exact deduplication with a heavy-hitter split, in built-in expressions.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of that
family) names the digests that may be frequent. They are counted exactly, and
those that are frequent indeed, the winners, are broadcast, so that their copies
are settled where they are read. All other digests, none of which is frequent,
are grouped by an ordinary shuffle of digests.

Two texts are equal when they agree after each run of ASCII white space became
one space. A null text counts as empty, so null, "" and no other text are equal.
Of equal texts the row with the smallest ``doc_id`` stays; a null ``doc_id``
comes last. Rows that repeat both text and ``doc_id`` are all marked as kept in
the report, and ``exact_dedup`` leaves one of them. An empty table gives none.
Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import bloom
from tidemark.llm.common import all_columns, clean_text, free_name
from tidemark.session import staged

WHITE = r"[\x20\x09-\x0D]+"
#: Counters of a summary, and winners that are broadcast at most (under 60 KB).
COUNTERS = 1024
WINNERS = 512
#: Summaries that are built side by side before their counts are added up.
SHARDS = 64


def digest_of(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(clean_text(text), WHITE, " "), 256))


def frequent(digests: DataFrame, counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """The verified winners among ``digest`` rows: ``digest``, ``keep_id``, ``group_size``.

    The summary holds every digest with more than rows / counters copies in its
    shard; it may hold others, which the exact count shows. One that it misses is
    grouped with the rest, so the result never depends on the summary."""
    summaries = digests.groupBy((F.spark_partition_id() % SHARDS).alias("shard")).agg(
        F.call_function("approx_top_k", F.xxhash64("digest"), F.lit(winners), F.lit(counters)).alias("top")
    )
    likely = (
        summaries.select(F.explode("top").alias("t")).groupBy(F.col("t.item").alias("key"))
        .agg(F.sum("t.count").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(winners)
    )
    return (
        digests.withColumn("key", F.xxhash64("digest")).join(F.broadcast(likely), "key", "left_semi")
        .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .orderBy(F.desc("group_size"), "digest").limit(winners)
    )


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, winners, groups of two or more of the rest), each staged."""
    digests = staged(docs.select("doc_id", digest_of().alias("digest")))
    heavy = staged(frequent(digests))
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti")
    light = staged(
        rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    return digests, heavy, light


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests, heavy, light = groups(docs)
    settled = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left")
    alone = F.col("group_size").isNull()
    rest = rest.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn(
        "group_size", F.coalesce("group_size", F.lit(1).cast("bigint"))
    )
    return settled.unionByName(rest).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts are not shuffled: a blocked Bloom filter of the digests in groups lets
    single documents pass, winners are settled by the broadcast, and only
    documents that may have a few copies meet their group in a join."""
    _, heavy, light = groups(docs)
    blocks = bloom.blocks_for(light.count())
    digest, keep, hit, group = (free_name(docs, n) for n in ("digest", "first", "hit", "group"))
    own = all_columns(docs)
    inner = docs.withColumn(digest, digest_of()).join(
        F.broadcast(heavy.select(F.col("digest").alias(digest), F.struct("keep_id").alias(keep))), digest, "left"
    )
    marked = bloom.mark(inner, digest, bloom.build(light, "digest", blocks), blocks, hit)
    is_heavy = F.col(keep).isNotNull()
    single = marked.where(~is_heavy & ~F.col(hit))
    first = marked.where(is_heavy & F.col("doc_id").eqNullSafe(F.col(keep)["keep_id"]))
    maybe = marked.where(~is_heavy & F.col(hit)).join(
        light.select(F.col("digest").alias(digest), F.struct("keep_id").alias(group)), digest, "left"
    )
    alone = maybe.where(F.col(group).isNull())
    staying = maybe.where(F.col(group).isNotNull() & F.col("doc_id").eqNullSafe(F.col(group)["keep_id"]))
    once = first.select(*own, digest).union(staying.select(*own, digest)).dropDuplicates([digest])
    return single.select(*own).union(alone.select(*own)).union(once.select(*own))
