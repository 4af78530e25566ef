"""Starting stream queries and writing their output into keyed tables."""

from __future__ import annotations

import inspect
import time
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import aggregate, dedup, reconcile
from tidemark.session import session_conf
from tidemark.sources.commits import checkpoint_run
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_settings(spark: SparkSession, idle: bool = False, state_partitions: int | None = None):
    """Options a query picks up when it starts: state on disk instead of on the
    heap, with incremental checkpoints, and one state partition per core."""
    n = state_partitions or spark.sparkContext.defaultParallelism
    return session_conf(
        spark,
        spark__sql__shuffle__partitions=str(n),
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__multipleWatermarkPolicy="max" if idle else "min",
        spark__sql__streaming__numRecentProgressUpdates="1000",
    )


def upsert_into(tables: KeyedTables, name: str, writer: str,
                shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """``foreachBatch`` function. A repeated batch of a run replaces its own rows."""

    def write(rows: DataFrame, batch_id: int, run: str | None = None) -> None:
        tables.write(name, shape(rows), writer, batch_id, run)

    return write


def downstream(rows: DataFrame) -> DataFrame:
    return reconcile.as_side(rows, "downstream")


def microbatch_into(tables: KeyedTables, writer: str, measure=PLAIN,
                    batch_time: Callable[[int], int] | None = None, slice_ms: int | None = None):
    """``foreachBatch`` function of the micro-batch job: last copy per message
    inside the batch, sums per device and category, labelled with the time of
    the batch. Copies that arrive in different batches count each time.

    ``batch_time`` gives epoch milliseconds for a batch number; by default the
    clock, cut to the window length. With ``slice_ms``, a replay's arrival slice is
    a batch, and its end is the time.
    """

    def clock(_: int) -> int:
        now = int(time.time() * 1000)
        return now - now % tw.WINDOW_MS

    def write(messages: DataFrame, batch_id: int, run: str | None = None) -> None:
        at = F.lit((batch_time or clock)(batch_id))
        if slice_ms is not None:
            at = tw.floor_ms(F.col("send_ms"), slice_ms) + slice_ms
        events = jobs.events_of(messages, measure.scale).withColumn("send_ms", F.unix_millis("arrival"))
        last = dedup.last_per_batch(events.drop("event_time", "arrival"), at)
        sums = aggregate.sum_by(last, ["batch", *aggregate.KEYS], measure)
        rows = sums.select(
            tw.ms_text(F.col("batch")).alias("window_time"),
            *aggregate.KEYS,
            F.col("m1").alias("m1_sum"),
            measure.unpack(F.col("m2")).alias("m2_sum"),
        )
        tables.write("agg_events", downstream(rows), writer, batch_id, run)

    return write


def _of_run(query: DataFrame, checkpoint: str, write):
    """A write function that takes a third argument is told the run, which Spark
    keeps in the checkpoint: a restart goes on in it, a new checkpoint is a new one."""
    if len(inspect.signature(write).parameters) < 3:
        return write
    known = []

    def of_run(rows: DataFrame, batch_id: int) -> None:
        if not known:
            known.append(checkpoint_run(query.sparkSession, checkpoint))
        write(rows, batch_id, known[0])

    return of_run


def run_available(query: DataFrame, mode: str, checkpoint: str, write) -> list:
    """Process what is there in micro-batches, then stop. The checkpoint lets
    the next call go on from there. Returns the progress of the last thousand."""
    running = (
        query.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_of_run(query, checkpoint, write))
        .start()
    )
    running.awaitTermination()
    return running.recentProgress


def dropped_by_watermark(progress: list) -> int:
    """Rows that the stateful operators of a query dropped as late."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def run_forever(query: DataFrame, mode: str, checkpoint: str, write, every: str = "5 seconds"):
    """Start a continuous query; the caller holds and stops it."""
    return (
        query.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(_of_run(query, checkpoint, write))
        .start()
    )


def run_until_closed(query: DataFrame, mode: str, checkpoint: str, write, every: str = "1 second", seconds: float = 600) -> None:
    """Run a query whose state is closed by the clock until all input is read and no
    state is left. ``seconds`` is the time in which something must have been read."""
    running = run_forever(query, mode, checkpoint, write, every)
    end, begun, seen = time.monotonic() + seconds, False, None
    try:
        while running.isActive and time.monotonic() < end:
            progress = running.lastProgress
            rows = progress["numInputRows"] if progress else 0
            begun = begun or rows > 0
            if rows and progress["batchId"] != seen:
                end, seen = time.monotonic() + seconds, progress["batchId"]
            if begun and not rows and not sum(o["numRowsTotal"] for o in progress["stateOperators"]):
                return
            time.sleep(0.1)
        if running.exception():
            raise running.exception()
        raise TimeoutError("the query's state is not closed")
    finally:
        running.stop()


def print_stream(stream: DataFrame):
    """Print a stream, for instance the messages of a topic as they come."""
    return stream.writeStream.outputMode("append").format("console").option("truncate", False).start()
