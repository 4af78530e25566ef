"""The stream jobs: messages in, streaming DataFrames out.

They only declare the query. Output mode, sink, trigger and checkpoint are
chosen where the query is started (``sinks``, ``replay``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import codec, timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import aggregate, lateness, text
from tidemark.streaming import stateful

TIME_MODES = ("event", "ingestion", "processing")


def events_of(messages: DataFrame, scale: int | None = None) -> DataFrame:
    """Good events of a message stream."""
    return codec.split_valid(codec.parse_payload(messages, scale=scale))[0]


def quarantine_of(messages: DataFrame, scale: int | None = None) -> DataFrame:
    """Bad lines of a message stream, for a second query of their own."""
    return codec.split_valid(codec.parse_payload(messages, scale=scale))[1]


def with_time(events: DataFrame, mode: str = "event") -> DataFrame:
    """Set ``event_time`` to the time the windows use.

    ``event``: the device time in the payload. ``ingestion``: when the broker
    got the message. ``processing``: now, one value per micro-batch.
    """
    if mode == "event":
        return events
    if mode == "ingestion":
        return events.withColumn("event_time", F.col("arrival"))
    if mode == "processing":
        return events.withColumn("event_time", F.current_timestamp())
    raise ValueError(f"time mode must be one of {TIME_MODES}, not {mode!r}")


def watermarked(events: DataFrame, delay_ms: int = 1000) -> DataFrame:
    return events.withWatermark("event_time", tw.duration(delay_ms))


def marks_of(events: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """What each event leaves behind for ``replay.slice_watermarks``: its time less the delay."""
    return events.select("arrival", (F.unix_millis("event_time") - delay_ms).alias("mark"))


def on_time(events: DataFrame, size_ms: int = tw.WINDOW_MS, slide_ms: int | None = None) -> DataFrame:
    """The events whose window was open at the watermark of their slice. Those of a
    stream that brings no such watermark all pass: Spark drops the late ones."""
    if "watermark_ms" not in events.columns:
        return events
    if slide_ms not in (None, size_ms):
        raise ValueError("late rows of sliding windows aren't judged by slice")
    ends = tw.floor_ms(F.unix_millis("event_time"), size_ms) + size_ms
    return events.where(~lateness.is_late(ends)).drop("watermark_ms")


def one_per_window(
    events: DataFrame, size_ms: int = tw.WINDOW_MS, slide_ms: int | None = None, last: bool = False
) -> DataFrame:
    """First (or last) record per message id and window of a watermarked stream,
    emitted with ``window`` when the window closes. For append mode.

    A grouped aggregate: copies are combined before the shuffle, so a message
    id that floods the stream reaches its state partition as one row per task.
    The earliest arrival wins, ties go by the payload.
    """
    rest = [c for c in ("arrival", *codec.PAYLOAD_FIELDS[1:]) if c in events.columns]
    pick = F.max if last else F.min
    return (
        events.groupBy("message_id", tw.window_of(F.col("event_time"), size_ms, slide_ms).alias("window"))
        .agg(pick(F.struct(*rest)).alias("_row"))
        .select("message_id", "window", *[f"_row.{c}" for c in rest])
    )


def _spread(events: DataFrame) -> DataFrame:
    """``_salt`` by input task and arrival: the same again when a task is run
    again, and different for the copies of a flooding message id. There are as
    many salts as state partitions."""
    spread = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seed = [F.spark_partition_id()] + [F.col("arrival")] * ("arrival" in events.columns)
    return events.withColumn("_salt", F.pmod(F.xxhash64(*seed), F.lit(spread)))


def first_seen(
    events: DataFrame, size_ms: int = tw.WINDOW_MS, slide_ms: int | None = None
) -> DataFrame:
    """The record per message id and window that arrives first, passed on at
    once with ``window``. For update mode, or append without waiting.

    ``dropDuplicates`` on a stream shuffles every copy, so it is applied twice:
    per salt, which splits a hot id, and on what is left. Among copies in one
    micro-batch any may be taken.
    """
    windowed = events.withColumn("window", tw.window_of(F.col("event_time"), size_ms, slide_ms))
    salted = _spread(windowed).dropDuplicates(["message_id", "window", "_salt"])
    return salted.drop("_salt").dropDuplicates(["message_id", "window"])


def first_within_watermark(events: DataFrame, spread: bool = True, delay_ms: int | None = None) -> DataFrame:
    """One record per message id whatever its window, remembered for the
    watermark delay. Make windows after it: it allows one event-time column.

    A copy is let through again once the delay has passed since the one that was
    let through last. ``spread`` splits a flooding id over salts first. Then a
    dropped copy may be remembered under its salt, and later ones stay away for a
    delay from it; without it the delay is exact, and one id one state partition.

    Messages that bring the watermark of their slice are judged by that, with ``delay_ms``.
    """
    if "watermark_ms" in events.columns:
        if delay_ms is None:
            raise ValueError("the delay must be told for a stream judged by slice")
        return stateful.first_within(events, delay_ms)
    if not spread:
        return events.dropDuplicatesWithinWatermark(["message_id"])
    salted = _spread(events).dropDuplicatesWithinWatermark(["message_id", "_salt"])
    return salted.drop("_salt").dropDuplicatesWithinWatermark(["message_id"])


def by_delivery(events: DataFrame, slice_ms: int) -> DataFrame:
    """Set ``event_time`` to the start of the delivery that a message arrives in, so
    that copies of one delivery have one time, whichever is read first."""
    at = tw.floor_ms(F.unix_millis("arrival"), slice_ms)
    return events.withColumn("event_time", tw.to_timestamp(at))


def window_sums(
    messages: DataFrame,
    mode: str = "event",
    emit: str = "append",
    delay_ms: int = 1000,
    deduplicate: bool = True,
    measure=PLAIN,
    label: str = "end",
    size_ms: int = tw.WINDOW_MS,
    slide_ms: int | None = None,
    by_slice: bool = False,
) -> DataFrame:
    """The main job. ``emit`` is the output mode it will run in: append emits a
    window once it is closed, update emits each change and goes with an upsert.

    ``by_slice``, in update mode over messages that bring their slice: what each slice
    adds to a window, with ``slice``. A micro-batch for each slice would put out their
    running totals."""
    events = on_time(with_time(events_of(messages, measure.scale), mode), size_ms, slide_ms)
    if by_slice:
        first = first_seen(watermarked(stateful.earliest_in_slices(events, size_ms), delay_ms), size_ms)
        sums = aggregate.sum_by(first, ["window", "slice", *aggregate.KEYS], measure)
        return aggregate.labelled(sums, measure, label, also=("slice",))
    return sums_of(watermarked(events, delay_ms), emit, deduplicate, measure, label, size_ms, slide_ms)


def sums_of(
    events: DataFrame,
    emit: str = "append",
    deduplicate: bool = True,
    measure=PLAIN,
    label: str = "end",
    size_ms: int = tw.WINDOW_MS,
    slide_ms: int | None = None,
) -> DataFrame:
    """The same from a stream that already has its watermark."""
    if emit not in ("append", "update"):
        raise ValueError(f"emit must be 'append' or 'update', not {emit!r}")
    if not deduplicate:
        return aggregate.window_sums(events, "event_time", measure, label, size_ms, slide_ms)
    single = one_per_window if emit == "append" else first_seen
    return aggregate.window_sums(single(events, size_ms, slide_ms), None, measure, label)


def complete_sums(messages: DataFrame, measure=PLAIN) -> DataFrame:
    """No watermark and no deduplication, start labels: the state is never
    dropped, so use it on bounded input and in complete mode."""
    return aggregate.window_sums(events_of(messages, measure.scale), "event_time", measure, "start")


def debug_rows(messages: DataFrame, mode: str = "event", delay_ms: int = 1000) -> DataFrame:
    """Each deduplicated event with its window as debug text."""
    events = watermarked(on_time(with_time(events_of(messages), mode)), delay_ms)
    return aggregate.debug_rows(first_seen(events))


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Running word count; update mode emits one row per changed word."""
    return text.word_count(lines, column)


def with_idle_watermark(
    spark: SparkSession, events: DataFrame, delay_ms: int = 1000, idle_ms: int = 6000, clock: DataFrame | None = None
) -> DataFrame:
    """Let the watermark follow a clock when no events arrive, so the last
    windows close: watermark = max(newest event - delay, clock - idle).

    The clock is a heartbeat stream that contributes no rows. Start the query
    inside ``sinks.stream_settings(spark, idle=True)``. By default it is the
    machine's, for live timestamps only: a replay of old data would be overtaken and
    dropped as late. ``clock``, a stream with a column ``timestamp``, is for those.
    """
    if clock is None:
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    beat = (
        clock.select(
            *[
                (F.col("timestamp") if f.name == "event_time" else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in events.schema
            ]
        )
        .withWatermark("event_time", tw.duration(idle_ms))
        .filter(F.col("event_time").isNull())
    )
    return watermarked(events, delay_ms).unionByName(beat)


def changelog_sums(messages: DataFrame, mode: str = "ingestion", delay_ms: int = 0,
                   measure=PLAIN) -> DataFrame:
    """Last copy per message and window, then the sums, in append mode: the
    sums see each message once, after its window has closed."""
    events = watermarked(with_time(events_of(messages, measure.scale), mode), delay_ms)
    return aggregate.window_sums(one_per_window(events, last=True), None, measure)
