"""Word count, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def words(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row per lower-case word; a word is a run of ASCII letters, digits or _."""
    word = F.explode(F.split(F.lower(F.col(text)), r"\W+")).alias("word")
    return lines.select(word).filter(F.length("word") > 0)


def word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    return words(lines, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
