"""A blocked Bloom filter as a small DataFrame, in built-in expressions.

A block has eight 64-bit lanes. A key picks one block and sets one bit in each of
its lanes, so that a probe touches one row. The filter never grows past
``MAX_BLOCKS`` rows of 72 bytes, which is what makes it safe to broadcast: more
keys only raise the rate of false hits, and every user checks hits exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import free_name

LANES = 8
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17  # 9.4 MB, full at 4.2 million keys


def blocks_for(keys: int) -> int:
    """A power of two with room for ``keys``, within the bound."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * LANES * 64 < keys * BITS_PER_KEY:
        blocks *= 2
    return blocks


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key, F.lit("block")).bitwiseAND(F.lit(blocks - 1))


def _lane(key: Column, lane: int) -> Column:
    six = F.shiftrightunsigned(F.xxhash64(key), 6 * lane).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), six)


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the non-null values of a column: ``block`` and lanes ``w0`` to ``w7``."""
    held = keys.where(F.col(key).isNotNull()).select(
        _block(F.col(key), blocks).alias("block"),
        *(_lane(F.col(key), i).alias(f"w{i}") for i in range(LANES)),
    )
    return held.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)))


def mark(df: DataFrame, key: str, filter_: DataFrame, blocks: int, into: str) -> DataFrame:
    """Add a boolean column: false means that the key is surely not in the filter.
    The filter is broadcast; it has ``MAX_BLOCKS`` rows at most."""
    block, words = free_name(df, "block"), free_name(df, "words")
    small = filter_.select(F.col("block").alias(block), F.struct(*(f"w{i}" for i in range(LANES))).alias(words))
    joined = df.withColumn(block, _block(F.col(key), blocks)).join(F.broadcast(small), block, "left")
    hit = reduce(Column.__and__, (
        F.col(words)[f"w{i}"].bitwiseAND(_lane(F.col(key), i)) == _lane(F.col(key), i) for i in range(LANES)
    ))
    return joined.withColumn(into, F.coalesce(hit, F.lit(False))).drop(block, words)
