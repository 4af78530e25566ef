"""Replay of a feed as a stream: slices of arrival time delivered one after another.

The deliveries are written once, in parallel, as the same number of files each. The
files' times follow the order of arrival, so Spark's own file source takes one
delivery as one micro-batch and stops when all are read.

A delivery is one slice or, so that their number doesn't grow with the feed, a run
of slices. Where results depend on slices, a first stream notes how far the watermark
is behind each of them, and the job judges every message by that of its own slice.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import schema
from tidemark.functions import timewin as tw
from tidemark.operators import lateness
from tidemark.session import staged, work_dir
from tidemark.sources.stream import event_source
from tidemark.streaming.sinks import run_available, stream_settings

# Arrival time that one delivery spans, whatever the size of the feed.
SLICE_MS = 360_000
# Messages of a file, about: a slice has as many files as its largest one needs.
FILE_ROWS = 1_000_000
# Deliveries of a feed that may share slices: this many at most, and more only for the
# sake of memory, when they would hold more messages than this. Each costs a job's tasks
# and commits, however few messages it holds.
DELIVERIES = 8
DELIVERY_ROWS = 4_000_000
# A delivery of several slices is read by all cores, with no fewer messages a file than this.
LEAST_ROWS = 2_000
# Slice of messages without an arrival time, which come first.
BEFORE_ALL = -(1 << 62)
# Time of the first file; the next delivery's is a second later.
FIRST_MS = 1_000_000_000_000


def with_slice(messages: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """Add ``slice``, the time at which a message's slice begins."""
    return messages.withColumn("slice", tw.floor_ms(F.unix_millis("arrival"), slice_ms))


def _delivery_of(counts: DataFrame, deliveries: int) -> Column:
    """The number of a message's delivery: runs of whole slices with about as many messages
    each. ``counts``: ``slice, count``, so that the messages aren't read once more."""
    shares = [i / deliveries for i in range(1, deliveries)]
    found = counts.agg(F.percentile("slice", shares, F.col("count"))).first()[0] if shares else None
    begins = sorted({int(b) for b in found or []})
    if not begins:
        return F.lit(0).cast("bigint")
    past = F.filter(F.array(*[F.lit(b) for b in begins]), lambda b: b <= F.col("slice"))
    return F.when(F.col("slice").isNull(), 0).otherwise(F.size(past)).cast("bigint")


def deliver(
    messages: DataFrame, folder: str, slice_ms: int, rests: bool = True, file_rows: int = FILE_ROWS, most: int | None = None
) -> int:
    """Write ``messages`` (value, arrival) below ``folder`` for the file source; gives
    the number of files that make one micro-batch.

    With ``rests``, an empty delivery follows each slice. A stream judges late rows by
    the watermark at the start of the micro-batch before; after a rest that is the
    watermark of all slices before. Messages without an arrival time come first.

    A slice is a delivery, or, with ``most``, as many slices in a row as it takes for
    ``most`` deliveries (more, if they would hold above ``DELIVERY_ROWS`` messages).
    """
    spark = messages.sparkSession
    sliced = with_slice(messages.select("value", "arrival"), slice_ms)
    counts = staged(sliced.groupBy("slice").count())
    found = counts.agg(F.max("count"), F.count(F.lit(1)), F.sum("count")).first()
    largest, n_slices, total = (v or 0 for v in found)
    delivery, parts = F.col("slice"), max(1, -(-largest // file_rows))
    if most is not None:
        deliveries = max(most, -(-total // DELIVERY_ROWS))
        if n_slices > deliveries:
            delivery = _delivery_of(counts, deliveries)
            largest += total // deliveries
        parts = max(-(-largest // file_rows), min(spark.sparkContext.defaultParallelism, largest // LEAST_ROWS), 1)
    dealt = sliced.select(
        "value", "arrival", delivery.alias("delivery"), F.pmod(F.xxhash64("value", "arrival"), F.lit(parts)).alias("part")
    )
    dealt.repartition("delivery", "part").write.partitionBy("delivery", "part").parquet(f"{folder}/in")
    spark.createDataFrame([], schema.PAYLOAD).coalesce(1).write.parquet(f"{folder}/empty")

    def files_of(path: str) -> list[str]:
        return spark.read.schema(schema.PAYLOAD).option("recursiveFileLookup", True).parquet(path).inputFiles()

    held: dict[int, list[str]] = {}
    for file in files_of(f"{folder}/in"):
        number = re.search(r"/delivery=(-?\d+)/", file)
        held.setdefault(int(number[1]) if number else BEFORE_ALL, []).append(file)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    empty = jvm.Path(files_of(f"{folder}/empty")[0])
    system = empty.getFileSystem(conf)
    fillers = 0
    for number, at in enumerate(sorted(held)):
        own = held[at]
        for step, files in enumerate([own, []] if rests else [own]):
            while len(files) < parts:
                fillers += 1
                files.append(f"{folder}/in/filler-{fillers:09d}.parquet")
                jvm.FileUtil.copy(system, empty, system, jvm.Path(files[-1]), False, conf)
            for file in files:
                system.setTimes(jvm.Path(file), FIRST_MS + 1000 * (2 * number + step), -1)
    return parts


def slice_watermarks(
    messages: DataFrame, slice_ms: int, marks: Callable[[DataFrame], DataFrame], folder: str
) -> DataFrame:
    """(slice, watermark_ms) from a stream of messages: the watermark when all slices
    before were read, NULL for the first. ``marks`` gives (arrival, mark): the watermark
    that a message leaves behind. One short row a slice. It keeps no state and the slices
    are put in order afterwards, so one micro-batch may hold all of them."""

    def note(rows: DataFrame, batch_id: int) -> None:
        rows.groupBy("batch").agg(F.max("mark").alias("high")).write.mode("overwrite").parquet(f"{folder}/marks/n={batch_id}")

    spark = messages.sparkSession
    spark.createDataFrame([], "batch bigint, high bigint").write.parquet(f"{folder}/marks/n=-1")
    told = with_slice(marks(messages), slice_ms).select(F.coalesce("slice", F.lit(BEFORE_ALL)).alias("batch"), "mark")
    run_available(told, "append", f"{folder}/marks-checkpoint", note)
    highs = spark.read.schema("batch bigint, high bigint").parquet(f"{folder}/marks").groupBy("batch").agg(F.max("high").alias("high"))
    rule = lateness.LateRule(delay_ms=0, batch_ms=slice_ms)
    return staged(lateness.running_watermarks(highs, rule).withColumnRenamed("batch", "slice"))


def judged(messages: DataFrame, watermarks: DataFrame, slice_ms: int) -> DataFrame:
    """Add ``slice`` and ``watermark_ms``, the watermark by which a message is judged."""
    sliced = with_slice(messages, slice_ms).withColumn("slice", F.coalesce("slice", F.lit(BEFORE_ALL)))
    return sliced.join(watermarks, "slice", "left").select(*messages.columns, "slice", "watermark_ms")


def with_beats(messages: DataFrame, slice_ms: int = SLICE_MS, after: int = 1) -> DataFrame:
    """Add one message without a value at the end of each slice, with or without
    messages of its own, and of ``after`` slices more: the clock of a replay."""
    ends = with_slice(messages, slice_ms).agg(F.min("slice").alias("first"), F.max("slice").alias("last")).where("first IS NOT NULL")
    slices = ends.select(F.explode(F.sequence("first", F.col("last") + after * slice_ms, F.lit(slice_ms))).alias("slice"))
    beats = slices.select(F.lit(None).cast("string").alias("value"), tw.to_timestamp(F.col("slice") + slice_ms - 1).alias("arrival"))
    return messages.select("value", "arrival").unionByName(beats)


def clock_of(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages of a replay with beats, and its clock (``timestamp``)."""
    return stream.where("value IS NOT NULL"), stream.where("value IS NULL").select(F.col("arrival").alias("timestamp"))


def replay(
    spark: SparkSession,
    messages: DataFrame,
    slice_ms: int,
    job: Callable[[DataFrame], DataFrame],
    mode: str,
    write,
    closing: DataFrame | None = None,
    rests: bool = True,
    idle: bool = False,
    marks: Callable[[DataFrame], DataFrame] | None = None,
    most: int = DELIVERIES,
) -> list[dict]:
    """Run one query over ``messages`` (value, arrival).

    ``closing`` holds messages that push the watermark past the last window. ``idle``: of
    two watermarks the later one counts. Returns the progress.

    With ``rests``, as in ``deliver``, a slice is a micro-batch, and Spark's watermark is
    that of the slices before: two micro-batches a slice. Without, a micro-batch holds
    several slices, ``most`` as in ``deliver``, which is right for jobs that don't depend
    on them. ``marks``, as in ``slice_watermarks``, is for those that do: the job is given
    messages with ``slice`` and ``watermark_ms``, and no rests are needed.
    """
    folder = work_dir(spark, "replay")
    rests = rests and marks is None
    if closing is not None:
        messages = messages.select("value", "arrival").unionByName(closing.select("value", "arrival"))
    files = deliver(messages, folder, slice_ms, rests, most=None if rests else most)
    options = {"recursiveFileLookup": "true"}
    with stream_settings(spark, idle):
        stream = event_source(spark, "parquet", path=f"{folder}/in", options={**options, "maxFilesPerTrigger": str(files)})
        if marks is not None:
            whole = event_source(spark, "parquet", path=f"{folder}/in", options=options)
            stream = judged(stream, slice_watermarks(whole, slice_ms, marks, folder), slice_ms)
        return run_available(job(stream), mode, f"{folder}/checkpoint", write)
