"""The named queries: each takes a session and a table folder and returns a frame.

Every result column is text, bigint or double. The measures of the events
table are amounts with two decimals, so all queries sum them as hundredths.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark import schema
from tidemark.functions import codec, timewin as tw
from tidemark.functions.measures import CENTS
from tidemark.operators import (
    aggregate, custom, dedup, feed as feeds, lateness, numeric, reconcile as recon, text, upsert,
)
from tidemark.plans import scenarios
from tidemark.session import staged, work_dir
from tidemark.sources.stream import event_source
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs, outputs, replay, sinks, stateful

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _readings(spark, sf_dir) -> DataFrame:
    return feeds.readings(table(spark, sf_dir, "events"))


def _originals(spark, sf_dir) -> DataFrame:
    return feeds.mark_late(feeds.base_feed(_readings(spark, sf_dir)))


def _feed(spark, sf_dir) -> DataFrame:
    return feeds.build_feed(table(spark, sf_dir, "events"))


def _tables(spark, **kwargs) -> KeyedTables:
    tables = KeyedTables(spark, work_dir(spark, "tables"), **kwargs)
    tables.init()
    return tables


def _wide(feed: DataFrame) -> DataFrame:
    return recon.reconcile(feed, aggregate.event_time_parts(feed, measure=CENTS), CENTS)


EVENT_COLUMNS = list(codec.PAYLOAD_FIELDS)


# -- codec ---------------------------------------------------------------------

@query
def encode_payload(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    return feed.select("send_ms", codec.encode_events(feed).alias("value"))


@query
def parse_payload(spark, sf_dir):
    events, _ = feeds.from_payload(feeds.to_payload(_feed(spark, sf_dir)))
    return events.select(
        *EVENT_COLUMNS, "send_ms", tw.time_text(F.col("event_time")).alias("event_time")
    )


def damaged(feed: DataFrame, *also: Column) -> DataFrame:
    """Payload lines with faults, as a broken device would send them."""
    line = codec.encode_events(feed)
    kind = F.col("s") % 40
    return feed.select(
        F.when(kind == 0, F.concat_ws("|", "message_id", "device_id"))
        .when(kind == 1, F.regexp_replace(line, r"^([^|]*\|[^|]*\|)\d+", "$1soon"))
        .when(kind == 2, F.regexp_replace(line, r"\|\d+\|([^|]*)$", "|x|$1"))
        .when(kind == 3, F.regexp_replace(line, r"\|[^|]*$", "|"))
        .when(kind == 4, F.lit(None))
        .when(kind == 5, F.regexp_replace(line, r"^[^|]*", ""))
        .when(kind == 6, F.regexp_replace(line, r"^([^|]*)\|[^|]*", "$1|"))
        .when(kind == 7, F.regexp_replace(line, r"^([^|]*\|[^|]*\|[^|]*)\|[^|]*", "$1|"))
        .when(kind == 8, F.regexp_replace(line, r"\|[^|]*$", "|NaN"))
        .when(kind == 9, F.regexp_replace(line, r"\|[^|]*$", "|-Infinity"))
        .when(kind == 10, F.regexp_replace(line, r"\|[^|]*$", "|0.125"))
        .otherwise(line)
        .alias("value"),
        *also,
    )


@query
def quarantine_malformed(spark, sf_dir):
    lines = damaged(_feed(spark, sf_dir))
    return codec.split_valid(codec.parse_payload(lines, scale=CENTS.scale))[1]


@query
def damaged_sums(spark, sf_dir):
    """Sums of a feed with damaged lines; good and quarantined lines are all lines."""
    parsed = codec.parse_payload(damaged(_feed(spark, sf_dir)), scale=CENTS.scale)
    good = F.col("reason").isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("good"), F.count_if(~good).alias("quarantined"),
        F.sum(F.when(good, F.col("measure1"))).alias("m1_sum"),
        CENTS.unpack(F.sum(CENTS.pack(F.when(good, F.col("measure2"))))).alias("m2_sum"),
    )


@query
def render_event(spark, sf_dir):
    return _feed(spark, sf_dir).select(
        "send_ms", codec.render_event("tab").alias("tab"), codec.render_event("comma").alias("comma")
    )


@query
def render_aggregate(spark, sf_dir):
    sums = aggregate.microbatch_sums(_feed(spark, sf_dir), CENTS)
    return sinks.downstream(sums).select(codec.render_aggregate().alias("line"))


@query
def epoch_to_timestamp(spark, sf_dir):
    at = tw.to_timestamp(F.col("device_ms"))
    return _feed(spark, sf_dir).select(
        "message_id", "send_ms",
        tw.time_text(at).alias("device_time"),
        tw.ms_text(F.col("device_ms")).alias("whole_second"),
    )


@query
def window_label_end(spark, sf_dir):
    return _feed(spark, sf_dir).select(
        "message_id", "send_ms", tw.label_end(F.col("device_ms")).alias("window_time")
    )


@query
def window_label_start(spark, sf_dir):
    return _feed(spark, sf_dir).select(
        "message_id", "send_ms", tw.label_start(F.col("device_ms")).alias("window_time")
    )


@query
def lateness_seconds(spark, sf_dir):
    return _feed(spark, sf_dir).select(
        "message_id", "send_ms", "patterncode",
        tw.lateness_seconds(F.col("send_ms"), F.col("device_ms")).alias("late_by"),
    )


@query
def key_text_parse(spark, sf_dir):
    start = tw.floor_ms(F.col("send_ms"))
    keys = _feed(spark, sf_dir).select(
        codec.window_key_text(F.col("device_id"), F.col("category"), start).alias("key_text")
    )
    parts = [c.alias(name) for name, c in codec.parse_window_key(F.col("key_text")).items()]
    return keys.distinct().select("key_text", *parts)


# -- feed ----------------------------------------------------------------------

@query
def feed_base(spark, sf_dir):
    return feeds.base_feed(_readings(spark, sf_dir))


@query
def feed_late(spark, sf_dir):
    return _originals(spark, sf_dir).filter(F.col("patterncode") == "late")


@query
def feed_resend(spark, sf_dir):
    return feeds.resend(_originals(spark, sf_dir))


@query
def feed(spark, sf_dir):
    return _feed(spark, sf_dir)


# -- deduplication ---------------------------------------------------------------

def _with_window_label(rows: DataFrame) -> DataFrame:
    return rows.select(
        *EVENT_COLUMNS, "send_ms", tw.window_label(F.col("window")).alias("window_time")
    )


def _dedup_input(spark, sf_dir) -> DataFrame:
    return _feed(spark, sf_dir).select(*EVENT_COLUMNS, "send_ms")


@query
def dedup_first_per_window(spark, sf_dir):
    at = tw.to_timestamp(F.col("device_ms"))
    return _with_window_label(dedup.first_per_window(_dedup_input(spark, sf_dir), at))


@query
def dedup_last_per_window(spark, sf_dir):
    at = tw.to_timestamp(F.col("send_ms"))
    return _with_window_label(dedup.last_per_window(_dedup_input(spark, sf_dir), at))


@query
def dedup_last_per_batch(spark, sf_dir):
    batch = tw.floor_ms(F.col("send_ms"), 60000)
    rows = dedup.last_per_batch(_dedup_input(spark, sf_dir), batch)
    return rows.select("batch", *EVENT_COLUMNS, "send_ms")


@query
def dedup_rows(spark, sf_dir):
    return dedup.distinct_rows(_feed(spark, sf_dir).select(*EVENT_COLUMNS))


@query
def dedup_first_per_id(spark, sf_dir):
    return dedup.first_per_id(_dedup_input(spark, sf_dir)).select(*EVENT_COLUMNS, "send_ms")


# -- aggregates ------------------------------------------------------------------

@query
def agg_event_time(spark, sf_dir):
    return aggregate.event_time_sums(_feed(spark, sf_dir), measure=CENTS)


@query
def agg_processing_time(spark, sf_dir):
    return aggregate.arrival_time_sums(_feed(spark, sf_dir), CENTS)


@query
def agg_ingestion_time(spark, sf_dir):
    """From the payload and the arrival time the broker noted."""
    events, _ = feeds.from_payload(feeds.to_payload(_feed(spark, sf_dir)), CENTS.scale)
    return aggregate.arrival_time_sums(events, CENTS)


@query
def agg_microbatch(spark, sf_dir):
    return aggregate.microbatch_sums(_feed(spark, sf_dir), CENTS)


@query
def agg_complete(spark, sf_dir):
    return aggregate.complete_sums(_feed(spark, sf_dir), CENTS)


@query
def agg_changelog(spark, sf_dir):
    return aggregate.changelog_sums(_feed(spark, sf_dir), CENTS)


@query
def agg_sliding(spark, sf_dir):
    return aggregate.sliding_sums(_feed(spark, sf_dir), measure=CENTS)


@query
def truth_devicetime(spark, sf_dir):
    return recon.truth(_feed(spark, sf_dir), "ingest_devicetime", CENTS)


@query
def truth_sendtime(spark, sf_dir):
    return recon.truth(_feed(spark, sf_dir), "ingest_sendtime", CENTS)


@query
def debug_window_rows(spark, sf_dir):
    at = tw.to_timestamp(F.col("device_ms"))
    return aggregate.debug_rows(dedup.first_per_window(_dedup_input(spark, sf_dir), at))


@query
def late_dropped(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    watermarks = staged(lateness.batch_watermarks(feed))
    return lateness.late_rows(feed, watermarks=watermarks).select(
        "message_id", "send_ms", "device_ms", "patterncode", "window_end_ms", "watermark_ms"
    )


# -- tables ----------------------------------------------------------------------

@query
def upsert_full(spark, sf_dir):
    """The sender's sums, replaced by those of the job where it has the key."""
    feed = _feed(spark, sf_dir)
    old = aggregate.window_sums(
        recon.originals(feed), tw.to_timestamp(F.col("device_ms")), CENTS
    )
    new = aggregate.event_time_sums(feed, measure=CENTS)
    return upsert.upsert_full(old, new, recon.KEYS)


@query
def upsert_partial(spark, sf_dir):
    """Three writers fill the columns of one table; one grouping merges them."""
    feed = _feed(spark, sf_dir)
    writes = (
        recon.truth(feed, "ingest_devicetime", CENTS),
        recon.truth(feed, "ingest_sendtime", CENTS),
        sinks.downstream(aggregate.event_time_sums(feed, measure=CENTS)),
    )
    log = spark.createDataFrame([], T.StructType([*schema.AGG_EVENTS, T.StructField("written", T.IntegerType())]))
    for written, rows in enumerate(writes):
        log = log.unionByName(rows.withColumn("written", F.lit(written)), allowMissingColumns=True)
    return upsert.merge_columns(log, schema.AGG_EVENTS_KEY, "written")


def _raw_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "message_id", "device_id",
        F.unix_millis("device_time").alias("device_ms"), F.unix_millis("send_time").alias("send_ms"),
        "category", "measure1", "measure2",
    )


@query
def raw_events_upsert(spark, sf_dir):
    """All messages are stored, then the late and repeated ones once more with
    a corrected measure."""
    feed = _feed(spark, sf_dir)
    corrected = feed.filter(F.col("patterncode") != "").withColumn("measure1", F.col("measure1") + 1000)
    tables = _tables(spark)
    tables.write("raw_events", scenarios.raw_events(feed), "sender", 0)
    tables.write("raw_events", scenarios.raw_events(corrected), "sender", 1)
    return _raw_columns(tables.read("raw_events"))


@query
def scan_raw_events(spark, sf_dir):
    tables = _tables(spark)
    tables.write("raw_events", scenarios.raw_events(_feed(spark, sf_dir)), "sender")
    return _raw_columns(tables.read("raw_events"))


@query
def table_counts(spark, sf_dir):
    tables = KeyedTables(spark, work_dir(spark, "tables"))
    scenarios.run_scenario(tables, _feed(spark, sf_dir), "event", CENTS)
    return tables.counts()


# -- comparison --------------------------------------------------------------------

@query
def reconcile(spark, sf_dir):
    return _wide(_feed(spark, sf_dir))


@query
def reconcile_report(spark, sf_dir):
    return recon.report(_wide(_feed(spark, sf_dir)), CENTS)


@query
def reconcile_exceptions(spark, sf_dir):
    return recon.exceptions(_wide(_feed(spark, sf_dir)), CENTS)


@query
def reconcile_counts(spark, sf_dir):
    return recon.counts(_wide(_feed(spark, sf_dir)), CENTS)


def _scenario(mode: str) -> Query:
    def run(spark, sf_dir):
        tables = KeyedTables(spark, work_dir(spark, "tables"))
        return scenarios.run_scenario(tables, _feed(spark, sf_dir), mode, CENTS)

    return run


for _mode in scenarios.MODES:
    REGISTRY[f"scenario_{_mode}"] = _scenario(_mode)


# -- reports and the small jobs ----------------------------------------------------

@query
def filter_sort_limit(spark, sf_dir):
    """The first 100 keys of one category, from the stored table. The filter on
    the key reaches the scan."""
    tables = _tables(spark)
    tables.write("agg_events", _wide(_feed(spark, sf_dir)), "all")
    wide = tables.read("agg_events").filter(F.col("category") == "view")
    return (
        wide.select(
            "window_time", "device_id", "category",
            "m2_sum_ingest_devicetime", "m2_sum_ingest_sendtime", "m2_sum_downstream",
        )
        .orderBy("category", "device_id", "window_time")
        .limit(100)
    )


@query
def key_lookup(spark, sf_dir):
    """Sums of one device by category, from the table laid out by key: one bucket is read, nothing is exchanged."""
    tables = _tables(spark)
    tables.write("agg_events", _wide(_feed(spark, sf_dir)), "all")
    mine = tables.lay_out("agg_events").filter(F.col("device_id") == "dev-1")
    return mine.groupBy("device_id", "category").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("m1_sum_downstream").alias("m1_sum"), F.max("window_time").alias("last_window")
    )


@query
def limit_n(spark, sf_dir):
    """How many of any 100 rows of the stored debug table are there and are its rows."""
    tables = _tables(spark)
    tables.write("debug", debug_window_rows(spark, sf_dir), "job")
    taken = tables.read("debug").limit(100)
    theirs = debug_window_rows(spark, sf_dir).withColumn("there", F.lit(True))
    return taken.join(theirs, ["id", "message"], "left").agg(
        F.count(F.lit(1)).alias("n_taken"), F.count("there").alias("n_found")
    )


@query
def wordcount(spark, sf_dir):
    return text.word_count(table(spark, sf_dir, "documents"))


@query
def time_spine(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("i"))
    return numeric.time_spine(rows)


# Side of the square and the two generators of the point lattice.
PI_RADIUS = 10000
PI_PRIME = 2147483647
PI_FACTORS = (48271, 69621)


@query
def pi_estimate(spark, sf_dir):
    """One point per line item, from its key."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    x, y = [
        (key * factor % PI_PRIME) % (2 * PI_RADIUS + 1) - PI_RADIUS for factor in PI_FACTORS
    ]
    points = table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"))
    return numeric.pi_from_points(points, F.lit(PI_RADIUS).cast("bigint"))


# -- streams: the feed is replayed in slices of arrival time -------------------------

def _stored(tables: KeyedTables) -> DataFrame:
    rows = tables.read("agg_events")
    return rows.select(
        *recon.KEYS,
        F.col("m1_sum_downstream").alias("m1_sum"), F.col("m2_sum_downstream").alias("m2_sum"),
    )


def _marks(messages: DataFrame) -> DataFrame:
    return jobs.marks_of(jobs.events_of(messages, CENTS.scale))


def _stream_sums(spark, sf_dir, job, mode: str, marks=None, most: int = replay.DELIVERIES) -> DataFrame:
    messages = feeds.to_payload(_feed(spark, sf_dir))
    tables = _tables(spark)
    write = sinks.upsert_into(tables, "agg_events", "job", sinks.downstream)
    closing = scenarios.closing_message(spark) if mode == "append" else None
    replay.replay(spark, messages, replay.SLICE_MS, job, mode, write, closing, rests=False, marks=marks, most=most)
    return _stored(tables)


@query
def stream_event_time(spark, sf_dir):
    """Append mode: each window once, when it closes."""
    return _stream_sums(spark, sf_dir, lambda m: jobs.window_sums(m, measure=CENTS), "append", _marks)


@query
def stream_event_time_update(spark, sf_dir):
    """Update mode with an upsert: every change of a window."""
    return _stream_sums(
        spark, sf_dir, lambda m: jobs.window_sums(m, emit="update", measure=CENTS), "update", _marks
    )


@query
def stream_ingestion_time(spark, sf_dir):
    return _stream_sums(
        spark, sf_dir, lambda m: jobs.window_sums(m, "ingestion", measure=CENTS), "append"
    )


# Each micro-batch puts out all windows so far.
COMPLETE_DELIVERIES = 4


@query
def stream_complete(spark, sf_dir):
    return _stream_sums(spark, sf_dir, lambda m: jobs.complete_sums(m, CENTS), "complete", most=COMPLETE_DELIVERIES)


CHANGES = schema.of("window_time string, device_id string, category string, slice bigint, m1_sum bigint, m2_sum double")


@query
def stream_changelog(spark, sf_dir):
    """Every version of every window that the job in update mode put out, numbered."""
    tables = _tables(spark, tables={"changes": (CHANGES, (*recon.KEYS, "slice"))}, by_column=())
    job = lambda m: jobs.window_sums(m, emit="update", measure=CENTS, by_slice=True)
    replay.replay(
        spark, feeds.to_payload(_feed(spark, sf_dir)), replay.SLICE_MS, job, "update",
        sinks.upsert_into(tables, "changes", "job"), marks=_marks,
    )
    of_key = Window.partitionBy(*recon.KEYS).orderBy("slice")
    return tables.read("changes").select(
        *recon.KEYS, F.row_number().over(of_key).cast("bigint").alias("version"),
        F.sum("m1_sum").over(of_key).alias("m1_sum"), CENTS.unpack(F.sum(CENTS.pack(F.col("m2_sum"))).over(of_key)).alias("m2_sum"),
    )


@query
def stream_last_copy(spark, sf_dir):
    """Windows of arrival where the last copy of a message counts, once they close."""
    return _stream_sums(spark, sf_dir, lambda m: jobs.changelog_sums(m, measure=CENTS), "append")


@query
def stream_microbatch(spark, sf_dir):
    """A slice is a batch and its end the time of the batch."""
    messages = feeds.to_payload(_feed(spark, sf_dir))
    tables = _tables(spark)
    write = sinks.microbatch_into(tables, "job", CENTS, slice_ms=replay.SLICE_MS)
    replay.replay(spark, messages, replay.SLICE_MS, lambda stream: stream, "append", write, rests=False)
    return _stored(tables)


@query
def stream_debug_rows(spark, sf_dir):
    messages = feeds.to_payload(_feed(spark, sf_dir))
    tables = _tables(spark)
    write = sinks.upsert_into(tables, "debug", "job")
    replay.replay(spark, messages, replay.SLICE_MS, jobs.debug_rows, "append", write, marks=_marks)
    return tables.log("debug").select("id", "message")


MESSAGES = T.StructType([f for f in schema.EVENT if f.name != "event_time"])


@query
def dedup_within_watermark(spark, sf_dir):
    """The log of everything the stream let through: one row per message id, as
    the watermark delay is the span of device times in the feed."""
    feed = _feed(spark, sf_dir)
    span_ms = feed.agg(F.max("device_ms") - F.min("device_ms")).first()[0] or 0
    messages = feeds.to_payload(feed)
    tables = _tables(spark, tables={"messages": (MESSAGES, ("message_id",))}, by_column=())

    def job(stream):
        events = jobs.watermarked(jobs.events_of(stream), span_ms + 1000)
        return jobs.first_within_watermark(events).drop("event_time", "arrival")

    replay.replay(
        spark, messages, replay.SLICE_MS, job, "append", sinks.upsert_into(tables, "messages", "job"), rests=False
    )
    return tables.log("messages").select(*EVENT_COLUMNS)


# A delivery of two minutes, and a delay of half of one: a message id is forgotten after two.
BOUNDED_SLICE_MS = 120_000
LET_THROUGH = schema.of("message_id string, device_ms bigint, device_id string, category string, measure1 bigint, slice_ms bigint")


@query
def stream_dedup_bounded(spark, sf_dir):
    """One row per message id for a fixed delay: what the stream remembers doesn't grow with the
    feed, and a copy that comes after it is let through again."""
    tables = _tables(spark, tables={"let_through": (LET_THROUGH, ("message_id", "slice_ms"))}, by_column=())

    def job(stream):
        events = jobs.watermarked(jobs.by_delivery(jobs.events_of(stream), BOUNDED_SLICE_MS), BOUNDED_SLICE_MS // 2)
        return jobs.first_within_watermark(events, spread=False, delay_ms=BOUNDED_SLICE_MS // 2).select(
            "message_id", "device_ms", "device_id", "category", "measure1", F.unix_millis("event_time").alias("slice_ms")
        )

    def marks(stream):
        return jobs.marks_of(jobs.by_delivery(jobs.events_of(stream), BOUNDED_SLICE_MS), BOUNDED_SLICE_MS // 2)

    replay.replay(
        spark, feeds.to_payload(_feed(spark, sf_dir)), BOUNDED_SLICE_MS, job, "append",
        sinks.upsert_into(tables, "let_through", "job"), marks=marks,
    )
    return tables.log("let_through").select(*LET_THROUGH.names)


PAUSE_SLICE_MS = 120_000
# How far the watermark of a clock is behind it, as in ``jobs.with_idle_watermark``.
IDLE_MS = 6000


@query
def stream_idle(spark, sf_dir):
    """A feed that is silent in every fourth slice and then ends: windows close, and rows become
    late, by the clock of the replay. No message closes the last window."""
    feed = _feed(spark, sf_dir).where(F.floor(F.col("send_ms") / PAUSE_SLICE_MS) % 4 != 2)
    messages = replay.with_beats(feeds.to_payload(feed), PAUSE_SLICE_MS)
    tables = _tables(spark)

    def job(stream):
        lines, clock = replay.clock_of(stream)
        events = jobs.on_time(jobs.events_of(lines, CENTS.scale))
        return jobs.sums_of(jobs.with_idle_watermark(spark, events, clock=clock, idle_ms=IDLE_MS), measure=CENTS)

    def marks(stream):
        lines, clock = replay.clock_of(stream)
        beats = clock.select(F.col("timestamp").alias("arrival"), F.col("timestamp").alias("event_time"))
        return jobs.marks_of(jobs.events_of(lines, CENTS.scale)).unionByName(jobs.marks_of(beats, IDLE_MS))

    write = sinks.upsert_into(tables, "agg_events", "job", sinks.downstream)
    replay.replay(spark, messages, PAUSE_SLICE_MS, job, "append", write, idle=True, marks=marks)
    return _stored(tables)


# Documents arrive half a second apart, so a slice holds the same number in any table.
DOC_MS = 500
WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


@query
def wordcount_stream(spark, sf_dir):
    """Running counts in update mode; the last count per word is the result."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("text").alias("value"), tw.to_timestamp(F.col("doc_id") * DOC_MS).alias("arrival")
    )
    tables = _tables(spark, tables={"words": (WORDS, ("word",))}, by_column=())
    replay.replay(
        spark, lines, replay.SLICE_MS, jobs.word_count, "update", sinks.upsert_into(tables, "words", "job"), rests=False
    )
    return tables.read("words")


@query
def stream_scenario_event(spark, sf_dir):
    tables = KeyedTables(spark, work_dir(spark, "tables"), outputs.TABLES)
    return scenarios.run_stream_scenario(
        spark, tables, _feed(spark, sf_dir), replay.SLICE_MS, "event", CENTS
    )


@query
def stream_late_rows(spark, sf_dir):
    """What the event-time stream drops, from a query beside it."""
    late = schema.of(f"{stateful.LATE}, window_end_ms bigint, watermark_ms bigint")
    tables = _tables(spark, tables={"late": (late, ("message_id", "send_ms"))}, by_column=())
    job = lambda m: stateful.late_rows(jobs.watermarked(jobs.events_of(m, CENTS.scale)))
    replay.replay(
        spark, feeds.to_payload(_feed(spark, sf_dir)), replay.SLICE_MS, job, "append",
        sinks.upsert_into(tables, "late", "job"), marks=_marks,
    )
    return tables.log("late").select("message_id", "send_ms", "device_ms", "window_end_ms", "watermark_ms")


# Slices short enough that many copies arrive in a later one than their original, and a delay
# that some of them outlast.
CORRECTION_SLICE_MS = 120_000
CORRECTION_DELAY_MS = 300_000


def corrected(feed: DataFrame) -> DataFrame:
    """Repeats that correct their original: another measure, and every second time another category."""
    again = F.col("patterncode") == "re"
    return feed.withColumns({
        "measure1": F.when(again, F.col("measure1") + 1000).otherwise(F.col("measure1")),
        "category": F.when(again & (F.col("s") % 2 == 0), F.lit("corrected")).otherwise(F.col("category")),
    })


@query
def stream_retractions(spark, sf_dir):
    """Every version of every window when a copy replaces the one before it."""
    tables = _tables(spark, tables=stateful.DELTAS, by_column=())
    job = lambda m: stateful.last_copy_deltas(jobs.events_of(m, CENTS.scale), CORRECTION_DELAY_MS, CENTS)
    marks = lambda m: jobs.marks_of(
        stateful.closes_of(jobs.events_of(m, CENTS.scale)).withColumn("event_time", F.col("closes")), CORRECTION_DELAY_MS
    )
    replay.replay(
        spark, feeds.to_payload(corrected(_feed(spark, sf_dir))), CORRECTION_SLICE_MS, job, "update",
        stateful.deltas_into(tables, "job"), marks=marks,
    )
    return stateful.versions(tables, CENTS)


@query
def stream_outputs(spark, sf_dir):
    """A damaged feed through the job with several outputs: where its lines went. Lines that
    went nowhere are repeats."""
    tables = _tables(spark, tables=outputs.TABLES)
    lines = damaged(_feed(spark, sf_dir), tw.to_timestamp(F.col("send_ms")).alias("arrival"))
    replay.replay(
        spark, lines, replay.SLICE_MS, lambda m: outputs.sorted_lines(m, measure=CENTS), "append",
        outputs.outputs_into(tables, "job", CENTS), marks=_marks,
    )
    nothing = F.lit(None).cast("bigint").alias("m1_sum")
    one = F.count(F.lit(1)).alias("n")
    return (
        tables.log("debug").agg(one).select(F.lit("debug rows").alias("output"), "n", nothing)
        .unionByName(outputs.stored_sums(tables, CENTS).agg(one, F.sum("m1_sum").alias("m1_sum")).select(F.lit("sums").alias("output"), "n", "m1_sum"))
        .unionByName(tables.log("late_events").agg(one, F.sum("measure1").alias("m1_sum")).select(F.lit("late").alias("output"), "n", "m1_sum"))
        .unionByName(tables.log("quarantine").groupBy(F.col("reason").alias("output")).agg(F.sum("n").alias("n")).select("output", "n", nothing))
    )


@query
def agg_own(spark, sf_dir):
    """An aggregator of the caller's own, the median, over the first copies per window."""
    at = tw.to_timestamp(F.col("device_ms"))
    first = _with_window_label(dedup.first_per_window(_dedup_input(spark, sf_dir), at))
    return custom.aggregate_by(first, ["window_time", "device_id", "category"], custom.median_of("measure1"))


MEDIANS = schema.of("window_time string, device_id string, category string, median bigint, n bigint")


@query
def stream_own(spark, sf_dir):
    """The same as a stream: late rows are dropped, a window is put out when it closes."""
    tables = _tables(spark, tables={"medians": (MEDIANS, recon.KEYS)}, by_column=())

    def job(stream):
        first = jobs.first_seen(jobs.watermarked(jobs.on_time(jobs.events_of(stream))))
        return custom.stream_aggregate_by(first.drop("event_time"), ["device_id", "category"], custom.median_of("measure1"))

    replay.replay(
        spark, feeds.to_payload(_feed(spark, sf_dir)), replay.SLICE_MS, job, "append",
        sinks.upsert_into(tables, "medians", "job"), scenarios.closing_message(spark), marks=_marks,
    )
    return tables.log("medians").select("window_time", "device_id", "category", "median", "n")


@query
def stream_processing_time(spark, sf_dir):
    """Windows of the clock, closed by timers. What a window holds depends on the clock; all of them
    together hold each original once."""
    folder = work_dir(spark, "clock")
    files = replay.deliver(feeds.to_payload(_originals(spark, sf_dir)), folder, replay.SLICE_MS, rests=False, most=replay.DELIVERIES)
    tables = _tables(spark, tables=stateful.DELTAS, by_column=())
    options = {"maxFilesPerTrigger": str(files), "recursiveFileLookup": "true"}
    with sinks.stream_settings(spark):
        stream = event_source(spark, "parquet", path=f"{folder}/in", options=options)
        sums = stateful.processing_sums(jobs.events_of(stream, CENTS.scale), CENTS)
        sinks.run_until_closed(sums, "append", f"{folder}/checkpoint", stateful.parts_into(tables, "job"))
    return tables.log("deltas").groupBy("device_id", "category").agg(
        F.sum("m1").alias("m1_sum"), CENTS.unpack(F.sum("m2")).alias("m2_sum")
    )
