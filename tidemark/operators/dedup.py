"""Removal of repeated messages, batch form.

Each variant is one grouped aggregate over a struct that starts with the
arrival time: Spark combines copies before the shuffle, so a message id that
holds a large part of all rows leaves each task as a single row. The rest of
the struct breaks ties, so the kept row never depends on the order of input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import timewin as tw


def _keep(df: DataFrame, keys: list[str], arrival: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != arrival]
    pick = F.max if last else F.min
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(arrival, *rest)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_per_window(
    df: DataFrame,
    time: Column | str = "event_time",
    size_ms: int = tw.WINDOW_MS,
    slide_ms: int | None = None,
    arrival: str = "send_ms",
) -> DataFrame:
    """First record per message id and window; adds ``window``."""
    ts = F.col(time) if isinstance(time, str) else time
    windowed = df.withColumn("window", tw.window_of(ts, size_ms, slide_ms))
    return _keep(windowed, ["message_id", "window"], arrival, last=False)


def last_per_window(
    df: DataFrame, time: Column | str, size_ms: int = tw.WINDOW_MS, arrival: str = "send_ms"
) -> DataFrame:
    """Last record per message id and window; adds ``window``."""
    ts = F.col(time) if isinstance(time, str) else time
    windowed = df.withColumn("window", tw.window_of(ts, size_ms))
    return _keep(windowed, ["message_id", "window"], arrival, last=True)


def last_per_batch(df: DataFrame, batch: Column, arrival: str = "send_ms") -> DataFrame:
    """Last record per message id inside one arrival batch; copies that arrive
    in different batches all stay. Adds ``batch``."""
    return _keep(df.withColumn("batch", batch), ["message_id", "batch"], arrival, last=True)


def first_per_id(df: DataFrame, arrival: str = "send_ms") -> DataFrame:
    """First record per message id whatever its window."""
    return _keep(df, ["message_id"], arrival, last=False)


def first_of(df: DataFrame, keys: list[str], arrival: str = "send_ms") -> DataFrame:
    """First record per key."""
    return _keep(df, keys, arrival, last=False)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
