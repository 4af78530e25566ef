"""The event-time watermark of a batch run, and the rows it leaves behind.

A stream judges a row by the watermark in force when the row arrives. A batch
run gets the same answer from arrival batches: the watermark of a batch is the
highest device time of the batches before it, minus the allowed delay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import timewin as tw

# Arrival batches per block of the running maximum: 60 days of 5 s batches.
BLOCK = 1 << 20


@dataclass(frozen=True)
class LateRule:
    """``arrival`` is the column that orders arrival, cut into batches of
    ``batch_ms``; with 1 its values are the batch numbers themselves.

    The watermark is that of the batch right before, as in a stream that settles
    between deliveries.
    """

    delay_ms: int = 1000
    batch_ms: int = 5000
    arrival: str = "send_ms"

    def batch(self) -> Column:
        return tw.floor_ms(F.col(self.arrival), self.batch_ms)


DEFAULT = LateRule()


def batch_watermarks(feed: DataFrame, rule: LateRule = DEFAULT) -> DataFrame:
    """(batch, watermark_ms), one row per arrival batch; NULL = none yet."""
    return running_watermarks(
        feed.groupBy(rule.batch().alias("batch")).agg(F.max("device_ms").alias("high")), rule
    )


def running_watermarks(highs: DataFrame, rule: LateRule = DEFAULT) -> DataFrame:
    """The same from (batch, high), the highest device time of each batch.

    The running maximum is taken per block of batches and then over the block
    maxima. Only the second window is unpartitioned; its rows are bounded by
    the calendar (6 a year with 5 s batches), not by the volume of events.
    """
    batches = highs.withColumn("block", tw.floor_ms(F.col("batch"), rule.batch_ms * BLOCK))
    before = Window.partitionBy("block").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    scanned = batches.withColumn("before", F.max("high").over(before))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.groupBy("block").agg(F.max("high").alias("high")).select(
        "block", F.max("high").over(earlier).alias("carry")
    )
    return scanned.join(carried, "block", "left").select(
        "batch", (F.greatest("before", "carry") - rule.delay_ms).alias("watermark_ms")
    )


def is_late(window_end_ms: Column) -> Column:
    """NULL watermark: nothing is late yet."""
    return F.coalesce(window_end_ms <= F.col("watermark_ms"), F.lit(False))


def drop_late(df: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Rows with ``batch`` and ``window`` whose window was still open.

    The join is left to the adaptive planner: the watermark side is broadcast
    only when its size at run time allows, else a sort-merge join that splits
    a hot batch.
    """
    end_ms = F.unix_millis(F.col("window.end"))
    return df.join(watermarks, "batch", "left").filter(~is_late(end_ms)).drop("watermark_ms")


def late_rows(feed: DataFrame, rule: LateRule = DEFAULT, size_ms: int = tw.WINDOW_MS,
              watermarks: DataFrame | None = None) -> DataFrame:
    """The rows an event-time stream drops, with the watermark that did it.

    This joins every row. Pass staged ``watermarks`` for a large feed: with a
    known small size they are broadcast and the feed is not shuffled.
    """
    if watermarks is None:
        watermarks = batch_watermarks(feed, rule)
    marked = feed.withColumn("batch", rule.batch()).join(watermarks, "batch", "left")
    end_ms = tw.floor_ms(F.col("device_ms"), size_ms) + size_ms
    return marked.filter(is_late(end_ms)).select(
        *feed.columns, end_ms.alias("window_end_ms"), "watermark_ms"
    )
