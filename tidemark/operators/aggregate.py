"""Sums of the two measures per device, category and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import codec, timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import dedup, lateness
from tidemark.session import staged

KEYS = ("device_id", "category")


def _summed_columns(feed: DataFrame, *also: Column | str) -> DataFrame:
    """Only what the sums need. Deduplication keeps whole rows in a struct,
    which column pruning does not look into."""
    return feed.select("message_id", "send_ms", *KEYS, "measure1", "measure2", *also)


def sum_by(df: DataFrame, keys: list[str], measure=PLAIN) -> DataFrame:
    """Packed sums ``m1`` and ``m2``: partial per task, then final."""
    return df.groupBy(*keys).agg(*_sums(measure))


def _sums(measure) -> list[Column]:
    return [F.sum("measure1").alias("m1"), F.sum(measure.pack(F.col("measure2"))).alias("m2")]


def labelled(sums: DataFrame, measure=PLAIN, label: str = "end", also: tuple[str, ...] = ()) -> DataFrame:
    """Window text label and unpacked sums."""
    return sums.select(
        tw.window_label(F.col("window"), label).alias("window_time"),
        *KEYS,
        F.col("m1").alias("m1_sum"),
        measure.unpack(F.col("m2")).alias("m2_sum"),
        *also,
    )


def window_sums(
    df: DataFrame,
    time: Column | str | None = "event_time",
    measure=PLAIN,
    label: str = "end",
    size_ms: int = tw.WINDOW_MS,
    slide_ms: int | None = None,
) -> DataFrame:
    """Sums per window. With ``time=None`` the frame already has ``window``.
    Batch or stream."""
    if time is not None:
        ts = F.col(time) if isinstance(time, str) else time
        df = df.withColumn("window", tw.window_of(ts, size_ms, slide_ms))
    return labelled(sum_by(df, ["window", *KEYS], measure), measure, label)


def _first_copies(feed: DataFrame, rule, size_ms: int) -> DataFrame:
    """First copy per message and window in the rule's order of arrival, with ``batch``."""
    extra = ["device_ms"] + [rule.arrival] * (rule.arrival != "send_ms")
    first = dedup.first_per_window(
        _summed_columns(feed, *extra), tw.to_timestamp(F.col("device_ms")), size_ms, arrival=rule.arrival
    )
    return first.withColumn("batch", rule.batch())


def event_time_parts(feed: DataFrame, rule=lateness.DEFAULT, measure=PLAIN,
                     size_ms: int = tw.WINDOW_MS, copies_agree: bool = True) -> DataFrame:
    """Deduplicated on-time sums per (batch, window, device, category), packed.

    Copies of a message in one window share its end, and the watermark only
    rises, so the window still has an on-time copy exactly when its first copy
    is on time. Deduplicating first is therefore the same as dropping late rows
    first, and whether a row is late depends on (batch, window) alone. The
    watermark is thus joined to these sums and not to the events.

    Where the copies of a message in one window have one device time, as the
    event contract says, a later copy can't raise the watermark. It then follows
    from the sums, which are staged, and the feed is read once. Otherwise pass
    ``copies_agree=False``, and the feed is read once more for it.
    """
    first = _first_copies(feed, rule, size_ms)
    keys = ["batch", "window", *KEYS]
    if not copies_agree:
        return lateness.drop_late(sum_by(first, keys, measure), lateness.batch_watermarks(feed, rule))
    per_batch = staged(first.groupBy(*keys).agg(*_sums(measure), F.max("device_ms").alias("high")))
    watermarks = lateness.running_watermarks(per_batch.groupBy("batch").agg(F.max("high").alias("high")), rule)
    return lateness.drop_late(per_batch.drop("high"), watermarks)


def event_time_sums(feed: DataFrame, rule=lateness.DEFAULT, measure=PLAIN, label: str = "end",
                    size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Event-time mode: late rows dropped, first copy per window, device time."""
    parts = event_time_parts(feed, rule, measure, size_ms)
    sums = parts.groupBy("window", *KEYS).agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    return labelled(sums, measure, label)


def event_time_rows(feed: DataFrame, rule=lateness.DEFAULT, size_ms: int = tw.WINDOW_MS,
                    watermarks: DataFrame | None = None) -> DataFrame:
    """The rows behind the event-time sums: on time, first copy per window, with
    ``window``. See ``lateness.late_rows`` about ``watermarks``."""
    if watermarks is None:
        watermarks = lateness.batch_watermarks(feed, rule)
    return lateness.drop_late(_first_copies(feed, rule, size_ms), watermarks)


def arrival_time_sums(feed: DataFrame, measure=PLAIN, label: str = "end",
                      size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Processing- and ingestion-time mode: windows of arrival, nothing is late.
    A copy that arrives in a later window counts again."""
    first = dedup.first_per_window(
        _summed_columns(feed), tw.to_timestamp(F.col("send_ms")), size_ms
    )
    return window_sums(first, None, measure, label)


def microbatch_sums(feed: DataFrame, measure=PLAIN, batch_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Sums per arrival batch, last copy in a batch wins, labelled with the
    time of the batch, its end."""
    batch = tw.floor_ms(F.col("send_ms"), batch_ms)
    last = dedup.last_per_batch(_summed_columns(feed), batch)
    sums = sum_by(last, ["batch", *KEYS], measure)
    return sums.select(
        tw.ms_text(F.col("batch") + batch_ms).alias("window_time"),
        *KEYS,
        F.col("m1").alias("m1_sum"),
        measure.unpack(F.col("m2")).alias("m2_sum"),
    )


def complete_sums(feed: DataFrame, measure=PLAIN) -> DataFrame:
    """No deduplication, nothing dropped, labelled with the window start."""
    return window_sums(feed, tw.to_timestamp(F.col("device_ms")), measure, label="start")


def changelog_sums(feed: DataFrame, measure=PLAIN, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Windows of arrival time where the last copy wins: the final state of a
    changelog that replaces a message by its latest copy."""
    last = dedup.last_per_window(
        _summed_columns(feed), tw.to_timestamp(F.col("send_ms")), size_ms
    )
    return window_sums(last, None, measure)


def sliding_sums(feed: DataFrame, size_ms: int = tw.WINDOW_MS, slide_ms: int = 1000,
                 measure=PLAIN) -> DataFrame:
    """Overlapping windows of device time, first copy per message and window.

    With exact sums of windows that begin every whole part of their length, no row
    is multiplied: see ``pane_sums``. Otherwise each row goes to all its windows."""
    if size_ms % slide_ms == 0 and measure.scale is not None:
        return pane_sums(feed, size_ms, slide_ms, measure)
    first = dedup.first_per_window(
        _summed_columns(feed, "device_ms"), tw.to_timestamp(F.col("device_ms")), size_ms, slide_ms
    )
    return window_sums(first, None, measure)


def pane_sums(feed: DataFrame, size_ms: int, slide_ms: int, measure) -> DataFrame:
    """Sliding sums by panes of ``slide_ms``.

    A copy counts in a range of windows: those that hold its time, less those of
    earlier copies of the message, which cut it from either side and never split it.
    It is added where the range begins and taken away behind its end; sums of such
    steps per pane, and their running total per device and category, are the sums of
    the windows. Only the last step makes a row for each window, which is the result.
    """
    span = size_ms // slide_ms
    rows = _summed_columns(feed, "device_ms").withColumn("pane", F.floor(F.col("device_ms") / slide_ms).cast("bigint"))
    first = dedup.first_of(rows, ["message_id", "pane"])
    order = F.struct("send_ms", *KEYS, "measure1", "measure2", "device_ms")
    near = Window.partitionBy("message_id").orderBy("pane")
    told = first.withColumn("order", order)
    found = told.withColumns({
        "before": F.collect_list(F.struct("pane", "order")).over(near.rangeBetween(1 - span, -1)),
        "after": F.collect_list(F.struct("pane", "order")).over(near.rangeBetween(1, span - 1)),
    })

    def earlier(side: str) -> Column:
        return F.transform(F.filter(side, lambda c: c["order"] < F.col("order")), lambda c: c["pane"])

    ranges = found.select(
        *KEYS, F.col("measure1").alias("m1"), measure.pack(F.col("measure2")).alias("m2"),
        F.greatest(F.col("pane") - span + 1, F.array_max(earlier("before")) + 1).alias("begin"),
        F.least(F.col("pane"), F.array_min(earlier("after")) - span).alias("end"),
    ).where("begin <= end")

    def step(at: Column, sign: int) -> Column:
        held = [(F.col(m).isNotNull().cast("bigint") * sign).alias(f"has_{m}") for m in ("m1", "m2")]
        return F.struct(at.alias("at"), F.lit(sign).cast("bigint").alias("n"), *held, *[(F.col(m) * sign).alias(m) for m in ("m1", "m2")])

    steps = ranges.select(*KEYS, F.explode(F.array(step(F.col("begin"), 1), step(F.col("end") + 1, -1))).alias("s")).select(*KEYS, "s.*")
    names = ("n", "has_m1", "has_m2", "m1", "m2")
    panes = steps.groupBy(*KEYS, "at").agg(*[F.sum(c).alias(c) for c in names])
    upto = Window.partitionBy(*KEYS).orderBy("at")
    running = panes.select(*KEYS, "at", F.lead("at").over(upto).alias("next"), *[F.sum(c).over(upto).alias(c) for c in names])
    return running.where("n > 0").select(
        *KEYS, F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("start"),
        F.when(F.col("has_m1") > 0, F.col("m1")).alias("m1"), F.when(F.col("has_m2") > 0, F.col("m2")).alias("m2"),
    ).select(
        tw.ms_text(F.col("start") * slide_ms + size_ms, fraction=True).alias("window_time"), *KEYS,
        F.col("m1").alias("m1_sum"), measure.unpack(F.col("m2")).alias("m2_sum"),
    )


def debug_rows(windowed: DataFrame) -> DataFrame:
    """Every row of every window as (id, message); nothing is reduced.

    The id is made of message and window, so writing the rows again does not
    multiply them.
    """
    end_ms = F.unix_millis(F.col("window.end")).cast("string")
    return windowed.select(
        F.concat(F.lit("windowed - "), F.col("message_id"), F.lit(" - "), end_ms).alias("id"),
        codec.debug_message(F.col("window")).alias("message"),
    )
