"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import staged


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours with its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours with the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the root is the smallest
    node that can be reached. Ids may be of any type with an order. Nodes without
    an edge to another one don't occur.

    Each round is written to the shared folder, so the lineage stays short. The
    end is reached when every edge leads to a root: no node is both a child and
    a parent, and no child has two parents."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        state = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if state is None or state == 1 and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        now = staged(_small(staged(_large(now))))
