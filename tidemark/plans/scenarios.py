"""Whole runs: truncate, send, store the truth, run a job, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import codec, timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import aggregate, feed as feeds, lateness, reconcile
from tidemark.session import staged
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs, outputs, replay, sinks

MODES = ("event", "processing", "ingestion", "microbatch")


def raw_events(feed: DataFrame) -> DataFrame:
    """The sender's own log of what it sent."""
    return feed.select(
        "message_id", "device_id",
        tw.to_timestamp(F.col("device_ms")).alias("device_time"),
        tw.to_timestamp(F.col("send_ms")).alias("send_time"),
        "category", "measure1", "measure2",
    )


def run_batch_job(tables: KeyedTables, events: DataFrame, mode: str, measure=PLAIN) -> None:
    """One of the jobs as a batch over parsed events with their arrival time."""
    if mode == "event":
        # The debug rows and the sums come from the same deduplicated rows.
        rows = staged(
            aggregate.event_time_rows(events, watermarks=staged(lateness.batch_watermarks(events)))
        )
        tables.write("debug", aggregate.debug_rows(rows), mode)
        sums = aggregate.window_sums(rows, None, measure)
    elif mode in ("processing", "ingestion"):
        sums = aggregate.arrival_time_sums(events, measure)
    elif mode == "microbatch":
        sums = aggregate.microbatch_sums(events, measure)
    else:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    tables.write("agg_events", sinks.downstream(sums), mode)


def send(tables: KeyedTables, feed: DataFrame, measure=PLAIN) -> None:
    """The sender's part: log of messages and both truths, under one commit."""
    tables.write_all({"raw_events": raw_events(feed), "agg_events": reconcile.reconcile(feed, None, measure)}, "sender")


def run_scenario(tables: KeyedTables, feed: DataFrame, mode: str, measure=PLAIN) -> DataFrame:
    """Reset the tables, run sender and job over the payload text, compare.

    Returns the report; the tables hold everything else.
    """
    tables.reset()
    feed = staged(feed)
    send(tables, feed, measure)
    events, _ = feeds.from_payload(feeds.to_payload(feed), measure.scale)
    run_batch_job(tables, events, mode, measure)
    return reconcile.report(tables.read("agg_events"), measure)


# 2100-01-01, after every event. The window of the closing
# message itself stays open, so it is in no result.
CLOSING_MS = 4102444800000


def closing_message(spark: SparkSession) -> DataFrame:
    """A message that pushes the watermark of a replay past all windows. A live
    stream uses ``jobs.with_idle_watermark`` instead."""
    return spark.range(1).select(
        codec.encode_payload(
            F.lit("closing"), F.lit("closing"), F.lit(CLOSING_MS), F.lit("closing"), F.lit(0), F.lit(0.0)
        ).alias("value"),
        tw.to_timestamp(F.lit(CLOSING_MS)).alias("arrival"),
    )


def run_stream_scenario(
    spark: SparkSession, tables: KeyedTables, feed: DataFrame, slice_ms: int, mode: str = "event",
    measure=PLAIN,
) -> DataFrame:
    """The same with the job as a stream over the replayed feed. In event mode, for
    which ``tables`` are those of ``outputs.TABLES``, one pass also stores the debug
    rows, the late rows and the lines that can't be read."""
    tables.reset()
    feed = staged(feed)
    send(tables, feed, measure)
    messages = feeds.to_payload(feed)
    if mode == "event":
        write = outputs.outputs_into(tables, mode, measure)
        marks = lambda stream: jobs.marks_of(jobs.events_of(stream, measure.scale))
        replay.replay(spark, messages, slice_ms, lambda stream: outputs.sorted_lines(stream, measure=measure), "append", write, marks=marks)
        tables.write("agg_events", sinks.downstream(outputs.stored_sums(tables, measure)), mode)
    elif mode == "microbatch":
        write = sinks.microbatch_into(tables, mode, measure)
        # A slice is a batch here, so none share a delivery.
        replay.replay(spark, messages, slice_ms, lambda stream: stream, "append", write, rests=False, most=1 << 62)
    else:
        write = sinks.upsert_into(tables, "agg_events", mode, sinks.downstream)
        replay.replay(
            spark, messages, slice_ms, lambda stream: jobs.window_sums(stream, mode, measure=measure),
            "append", write, closing_message(spark), rests=False,
        )
    return reconcile.report(tables.read("agg_events"), measure)


def first_debug_rows(tables: KeyedTables, n: int = 5) -> DataFrame:
    """Any n rows of the debug table, to see that the store answers."""
    return tables.read("debug").limit(n)
