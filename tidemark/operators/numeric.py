"""Monte-Carlo estimate of pi and a regular series of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import codec


def in_circle(x: Column, y: Column, radius: Column | float = 1.0) -> Column:
    r = radius if isinstance(radius, Column) else F.lit(radius)
    return F.when(x * x + y * y <= r * r, 1).otherwise(0)


def pi_from_points(points: DataFrame, radius: Column | float = 1.0) -> DataFrame:
    """One row (inside, n, pi) from points x, y in the square of +-radius."""
    inside = F.sum(in_circle(F.col("x"), F.col("y"), radius)).cast("bigint")
    n = F.count(F.lit(1))
    return points.agg(inside.alias("inside"), n.alias("n"), (F.lit(4.0) * inside / n).alias("pi"))


def random_points(spark: SparkSession, n: int, partitions: int | None = None, seed: int = 34) -> DataFrame:
    """n uniform points, generated inside the tasks."""
    rows = spark.range(1, n + 1, 1, partitions)
    return rows.select(
        (F.rand(seed) * 2 - 1).alias("x"), (F.rand(seed + 1) * 2 - 1).alias("y")
    )


# A series starts here and its first row is eleven minutes later.
SERIES_START_MS = 1430438400000
SERIES_OFFSET_MIN = 10


def time_spine(rows: DataFrame, i: str = "i") -> DataFrame:
    """One minute per row number, as time text and as demo payload."""
    at_ms = F.lit(SERIES_START_MS) + (F.col(i) + SERIES_OFFSET_MIN) * 60000
    return rows.select(
        F.col(i).alias("i"), at_ms.alias("at_ms"), codec.demo_payload(F.col(i), at_ms).alias("value")
    )
