"""One stream job with several outputs under one commit.

The event-time job of a scenario sorts every line of a stream: first copies that are
on time, late rows, and lines that can't be read. A micro-batch is kept while it is
written, and its sums, debug rows, late rows and quarantine become visible together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schema
from tidemark.functions import codec
from tidemark.functions.measures import PLAIN
from tidemark.operators import aggregate, reconcile
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs, stateful

_INCREMENT = schema.of("window_time string, device_id string, category string, m1 bigint, m2 double")
_LATE = schema.of(f"{stateful.LATE}, window_end_ms bigint, watermark_ms bigint")
_QUARANTINE = schema.of("reason string, value string, arrival timestamp, n bigint")

#: The tables of a scenario and those that only the job writes.
TABLES = {
    **schema.TABLES,
    "increments": (_INCREMENT, reconcile.KEYS),
    "late_events": (_LATE, ("message_id",)),
    "quarantine": (_QUARANTINE, ("reason",)),
}
KEPT, LATE, BAD = "kept", "late", "bad"


def sorted_lines(messages: DataFrame, delay_ms: int = 1000, measure=PLAIN) -> DataFrame:
    """The lines of a stream with their ``kind``; repeated copies are dropped. The
    watermark is that of the good events. For append mode."""
    good, bad = codec.split_valid(codec.parse_payload(messages, scale=measure.scale))
    events = jobs.watermarked(good, delay_ms)
    kinds = {KEPT: jobs.first_seen(jobs.on_time(events)), LATE: stateful.late_rows(events), BAD: bad_lines(messages, measure)}
    rows = None
    for kind, frame in kinds.items():
        own = frame.drop("event_time", "slice").withColumn("kind", F.lit(kind))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows


def bad_lines(messages: DataFrame, measure=PLAIN) -> DataFrame:
    parsed = codec.parse_payload(messages, scale=measure.scale)
    return parsed.where(F.col("reason").isNotNull()).select("value", "reason", "arrival")


def outputs_into(tables: KeyedTables, writer: str, measure=PLAIN):
    """``foreachBatch`` function of ``sorted_lines``: four tables, one commit. Sums are
    stored as what each micro-batch adds to them."""

    def write(rows: DataFrame, batch_id: int, run: str | None = None) -> None:
        rows.persist()
        try:
            kept = rows.where(F.col("kind") == KEPT)
            sums = aggregate.sum_by(kept, ["window", *aggregate.KEYS], measure)
            added = sums.select(
                aggregate.tw.window_label(F.col("window")).alias("window_time"), *aggregate.KEYS, "m1", F.col("m2").cast("double").alias("m2")
            )
            tables.write_all({
                "increments": added,
                "debug": aggregate.debug_rows(kept),
                "late_events": rows.where(F.col("kind") == LATE),
                "quarantine": rows.where(F.col("kind") == BAD).groupBy("reason", "value", "arrival").agg(F.count(F.lit(1)).alias("n")),
            }, writer, batch_id, run)
        finally:
            rows.unpersist()

    return write


def stored_sums(tables: KeyedTables, measure=PLAIN) -> DataFrame:
    """The sums, out of all that was added."""
    total = tables.log("increments").groupBy(*reconcile.KEYS).agg(F.sum("m1").alias("m1_sum"), F.sum("m2").alias("m2"))
    return total.select(*reconcile.KEYS, "m1_sum", measure.unpack(F.col("m2")).alias("m2_sum"))
