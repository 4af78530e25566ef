"""Deliveries of several slices give what a micro-batch for each slice gives."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import timewin as tw
from tidemark.functions.measures import CENTS
from tidemark.operators import aggregate, feed as feeds, lateness
from tidemark.plans.queries import REGISTRY, _marks
from tidemark.session import work_dir
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs, replay, sinks, stateful

SF = "/root/testdata/sf0.001"


def lines_at(spark, data):
    return spark.createDataFrame(data, "value string, ms bigint").selectExpr("value", "timestamp_millis(ms) AS arrival")


def with_data(progress):
    return [p["numInputRows"] for p in progress if p["numInputRows"]]


def test_micro_batches_dont_grow_with_the_feed(spark):
    """A hundred slices, one of them without a time of arrival."""
    messages = lines_at(spark, [(f"m{i}|d|{1000 * i}|c|1|1.0", 1000 * i) for i in range(99)] + [("none", None)])
    got = []
    progress = replay.replay(spark, messages, 1000, lambda m: m, "append", lambda df, _: got.extend(rows(df)), rests=False)
    assert len(with_data(progress)) <= replay.DELIVERIES and sum(with_data(progress)) == 100 == len(got)
    assert max(with_data(progress)) <= 2 * 100 // replay.DELIVERIES


@pytest.mark.parametrize("most", [1, 2, 100])
def test_late_rows_are_judged_by_slice(spark, most):
    feed = feeds.build_feed(spark.read.parquet(f"{SF}/events.parquet"))
    t = KeyedTables(spark, work_dir(spark, "t"))
    t.init()
    progress = replay.replay(
        spark, feeds.to_payload(feed), 10_000, lambda m: jobs.window_sums(m, emit="update", measure=CENTS), "update",
        sinks.upsert_into(t, "agg_events", "job", sinks.downstream), marks=_marks, most=most,
    )
    got = t.read("agg_events").select("window_time", "device_id", "category", "m1_sum_downstream", "m2_sum_downstream")
    assert rows(got) == rows(aggregate.event_time_sums(feed, lateness.LateRule(batch_ms=10_000), CENTS))
    assert len(with_data(progress)) == min(most, 5)


def test_watermarks_of_slices(spark):
    """The first slice has none; messages without a time of arrival come before it, and one may close the rest."""
    messages = lines_at(spark, [("a|d|5000|c|1|1.0", None), ("b|d|1000|c|1|1.0", 10), ("c|d|9000|c|1|1.0", 2010), ("d|d|9000|c|1|1.0", 5010)])
    held = []
    replay.replay(spark, messages, 1000, lambda m: m.select(F.substring("value", 1, 1), "watermark_ms"), "append",
                  lambda df, _: held.extend(rows(df)), marks=_marks, most=1)
    assert sorted(held) == [("a", None), ("b", 4000), ("c", 4000), ("d", 8000)]


@pytest.mark.parametrize("most", [1, 2])
def test_retractions_by_slice(spark, most):
    t = KeyedTables(spark, work_dir(spark, "deltas"), tables=stateful.DELTAS, by_column=())
    t.init()
    messages = lines_at(spark, [
        ("a|d|1000|c|1|1.5", 10), ("a|d|1000|c|2|1.5", 20), ("b|d|2000|c|10|0.25", 30),
        ("a|d|1000|x|5|1.5", 1010), ("b|d|2000|c|10|0.25", 1020),
        ("a|d|1000|x|7|2.0", 2010), ("z|d|100000|c|0|0.0", 2020),
        ("a|d|1000|x|9|9.0", 3010),  # closed
    ])
    marks = lambda m: jobs.marks_of(stateful.closes_of(jobs.events_of(m)).withColumn("event_time", F.col("closes")), 50_000)
    job = lambda m: stateful.last_copy_deltas(jobs.events_of(m, 2), 50_000, CENTS)
    replay.replay(spark, messages, 1000, job, "update", stateful.deltas_into(t, "job"), marks=marks, most=most)
    first = "1970-01-01 00:00:05"
    assert rows(stateful.versions(t, CENTS)) == [
        (first, "d", "c", 1, 12, 1.75), (first, "d", "c", 2, 10, 0.25), (first, "d", "x", 1, 5, 1.5), (first, "d", "x", 2, 7, 2.0),
        ("1970-01-01 00:01:45", "d", "c", 1, 0, 0.0),
    ]


@pytest.mark.parametrize("most", [1, 3])
def test_an_id_is_forgotten_by_slice(spark, most):
    """Copies after one, two and three slices: the second is let through, and the third is within its delay."""
    held = [("a", 1_000), ("a", 11_000), ("a", 21_000), ("a", 31_000), *[(f"m{k}", 10_000 * k + 5) for k in range(6)]]
    messages = lines_at(spark, [(f"{i}|d|0|c|1|1.0", at) for i, at in held])
    timed = lambda m: jobs.by_delivery(jobs.events_of(m), 10_000)
    out = []

    def job(stream):
        first = jobs.first_within_watermark(jobs.watermarked(timed(stream), 5_000), spread=False, delay_ms=5_000)
        return first.select("message_id", F.unix_millis("event_time"))

    replay.replay(spark, messages, 10_000, job, "append", lambda df, _: out.extend(rows(df)), marks=lambda m: jobs.marks_of(timed(m), 5_000), most=most)
    assert sorted(out) == sorted([("a", 0), ("a", 20_000), *[(f"m{k}", 10_000 * k) for k in range(6)]])


def test_marks_take_one_micro_batch(spark, monkeypatch):
    """The first stream, which notes watermarks, doesn't pay for each delivery again."""
    run, seen = sinks.run_available, []
    monkeypatch.setattr(replay, "run_available", lambda *args: seen.append(run(*args)) or seen[-1])
    messages = lines_at(spark, [(f"m{i}|d|{1000 * i}|c|1|1.0", 1000 * i) for i in range(100)])
    replay.replay(spark, messages, 1000, lambda m: m.select("slice"), "append", lambda df, _: df.count(), rests=False, marks=_marks)
    assert [len(with_data(p)) for p in seen] == [1, replay.DELIVERIES] and replay.DELIVERIES <= 8


def test_deliveries_hold_about_as_many_messages(spark, tmp_path):
    """Cut by the counts of slices, a busy one among them."""
    data = [(f"m{i}", 1000 * i) for i in range(40)] + [(f"b{i}", 5000) for i in range(40)] + [("none", None)]
    parts = replay.deliver(lines_at(spark, data), f"{tmp_path}/f", 1000, rests=False, most=4)
    held = spark.read.parquet(f"{tmp_path}/f/in").where("value IS NOT NULL").groupBy("delivery").count().collect()
    assert parts >= 1 and 2 <= len(held) <= 4 and sum(r["count"] for r in held) == 81 and max(r["count"] for r in held) <= 41 + 81 // 4


def test_late_by_slice_needs_tumbling_windows(spark):
    judged = lines_at(spark, [("a|d|0|c|1|1.0", 0)]).withColumn("watermark_ms", F.lit(0).cast("bigint"))
    with pytest.raises(ValueError):
        jobs.window_sums(judged, slide_ms=tw.WINDOW_MS // 2)
    with pytest.raises(ValueError):
        jobs.first_within_watermark(jobs.events_of(judged), spread=False)


def test_a_clock_job_runs_as_long_as_it_reads(spark, tmp_path, monkeypatch):
    """The whole run takes longer than the time in which something must have been read."""
    from tidemark.sources.stream import event_source
    from tidemark.streaming.sinks import run_until_closed, stream_settings

    folder = f"{tmp_path}/in"
    messages = lines_at(spark, [(f"m{i}|d|0|c|1|1.0", 1000 * i) for i in range(8)])
    files = replay.deliver(messages, folder, 1000, rests=False)
    seen = []
    with stream_settings(spark, state_partitions=2):
        stream = event_source(spark, "parquet", path=f"{folder}/in", options={"maxFilesPerTrigger": str(files), "recursiveFileLookup": "true"})
        sums = stateful.processing_sums(jobs.events_of(stream))
        run_until_closed(sums, "append", work_dir(spark, "cp"), lambda df, _: seen.extend(rows(df)), every="3 seconds", seconds=18)
    assert sum(r[3] for r in seen) == 8
