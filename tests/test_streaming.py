import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helpers import LINES, rows
from tidemark.functions import timewin as tw
from tidemark.functions.measures import CENTS
from tidemark.operators import aggregate, custom, feed as feeds, lateness
from tidemark.plans import scenarios
from tidemark.session import session_conf, work_dir
from tidemark.sources.stream import event_sink, event_source
from tidemark.sources.tables import KeyedTables
from tidemark.streaming import jobs, outputs, replay, sinks, stateful

A = "a|d|1472209316326|c1|1|1.5"
# One file per micro-batch; the fourth holds only late rows.
FILES = [
    [A, A],
    ["c|d|1472209331000|c1|4|1"],
    ["f|d|1472209332000|c1|16|1"],
    ["z|d|1472209316000|c1|100|9", A],
    ["g|d|1472209360000|c1|32|1"],
]


def write_files(folder, files, first=0):
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(files, start=first):
        path = f"{folder}/part-{i:03d}.txt"
        with open(path, "w") as out:
            out.write("".join(line + "\n" for line in lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def text_stream(spark, folder):
    return event_source(spark, "text", path=folder, options={"maxFilesPerTrigger": "1"})


class Collect:
    """A foreachBatch function that keeps what it was given."""

    def __init__(self):
        self.batches = []

    def __call__(self, df, batch_id):
        got = rows(df)
        if got:
            self.batches.append(got)


def run(spark, folder, job, mode):
    out = Collect()
    with sinks.stream_settings(spark, state_partitions=2):
        sinks.run_available(job(text_stream(spark, folder)), mode, work_dir(spark, "cp"), out)
    return out.batches


@pytest.fixture()
def folder(tmp_path):
    write_files(f"{tmp_path}/in", FILES)
    return f"{tmp_path}/in"


def short(batches):
    return [(r[0][-8:], r[3]) for batch in batches for r in batch]


def test_append_emits_closed_windows_once(spark, folder):
    got = run(spark, folder, jobs.window_sums, "append")
    assert short(got) == [("11:02:00", 1), ("11:02:15", 20)]


def test_update_emits_each_change(spark, folder):
    got = run(spark, folder, lambda m: jobs.window_sums(m, emit="update"), "update")
    assert short(got) == [("11:02:00", 1), ("11:02:15", 4), ("11:02:15", 20), ("11:02:45", 32)]


def test_complete_mode_keeps_duplicates_and_late_rows(spark, folder):
    got = run(spark, folder, jobs.complete_sums, "complete")
    assert short(got[-1:]) == [("11:01:55", 103), ("11:02:10", 20), ("11:02:40", 32)]


def test_sliding_windows(spark, folder):
    job = lambda m: jobs.window_sums(m, emit="update", slide_ms=2500)
    got = run(spark, folder, job, "update")
    last = {r[0][11:]: r[3] for batch in got for r in batch}
    # 01:56.326 | 02:11 and 02:12 | 02:40, each in two windows.
    assert last == {
        "11:01:57.5": 1, "11:02:00": 1, "11:02:12.5": 20, "11:02:15": 20,
        "11:02:42.5": 32, "11:02:45": 32,
    }


def test_append_keeps_the_earliest_of_differing_copies(spark, messages):
    """Two copies in one micro-batch with other values: the first to arrive."""
    t = KeyedTables(spark, work_dir(spark, "copies"))
    t.init()
    lines = spark.createDataFrame(
        [("a|d|1000|c|9|1.0", 2002), ("a|d|1000|c|5|1.0", 2001), ("a|d|1000|c|7|1.0", 2003)],
        "value string, ms bigint",
    ).selectExpr("value", "timestamp_millis(ms) AS arrival")
    for name, want in (("first", 5), ("last", 7)):
        job = jobs.changelog_sums if name == "last" else lambda m: jobs.window_sums(m, "ingestion")
        write = sinks.upsert_into(t, "agg_events", name, sinks.downstream)
        replay.replay(spark, lines, replay.SLICE_MS, job, "append", write, scenarios.closing_message(spark))
        got = t.log("agg_events").filter(F.col("writer") == name)
        assert [r.m1_sum_downstream for r in got.collect()] == [want]


def test_hot_message_id(spark, tmp_path):
    """A third of all rows are copies of one message."""
    lines = [A] * 300 + [f"m{i}|d|1472209317000|c1|1|0.5" for i in range(600)]
    write_files(f"{tmp_path}/in", [lines, lines[:500], [FILES[4][0]], [FILES[4][0]]])
    for emit in ("append", "update"):
        got = run(spark, f"{tmp_path}/in", lambda m: jobs.window_sums(m, emit=emit), emit)
        sums = {r[0][-8:]: r[3] for batch in got for r in batch}
        assert sums["11:02:00"] == 601, emit


def test_copies_are_combined_before_the_shuffle_in_append_mode(spark, folder, capsys):
    jobs.window_sums(text_stream(spark, folder)).explain()
    plan = capsys.readouterr().out
    assert "partial_min" in plan and "StreamingDeduplicate" not in plan


def test_without_deduplication(spark, folder):
    got = run(spark, folder, lambda m: jobs.window_sums(m, "event", "append", deduplicate=False, label="start"), "append")
    assert short(got)[0] == ("11:01:55", 2)


def test_quarantine_stream(spark, tmp_path):
    write_files(f"{tmp_path}/in", [LINES])
    got = run(spark, f"{tmp_path}/in", jobs.quarantine_of, "append")
    assert got == [[("bad|line", "too few fields"), ("e|d|1472209330500|c2|x|1", "bad measure1")]]


def test_debug_rows_are_emitted_once(spark, folder):
    got = run(spark, folder, jobs.debug_rows, "append")
    ids = [r[0] for batch in got for r in batch]
    assert len(ids) == len(set(ids)) == 4


def test_dedup_within_watermark_spans_windows(spark, tmp_path):
    copies = [A, "a|d|1472209326326|c1|1|1.5", "b|d|1472209326326|c1|1|1.5"]
    write_files(f"{tmp_path}/in", [[c] for c in copies])

    def job(stream):
        events = jobs.watermarked(jobs.events_of(stream), 60_000)
        return aggregate.window_sums(jobs.first_within_watermark(events))

    got = run(spark, f"{tmp_path}/in", job, "update")
    assert short(got) == [("11:02:00", 1), ("11:02:10", 1)]


def test_processing_time_counts_now(spark, folder):
    before = int(time.time() * 1000)
    got = run(spark, folder, lambda m: jobs.window_sums(m, "processing", "update"), "update")
    now = int(time.time() * 1000)
    labels = {r[0] for batch in got for r in batch}
    ends = {
        spark.range(1).select(tw.label_end(F.lit(ms))).first()[0] for ms in range(before, now + 5000, 5000)
    }
    assert labels <= ends


def test_unknown_time_mode(spark, messages):
    with pytest.raises(ValueError):
        jobs.with_time(jobs.events_of(messages), "lunar")


def test_restart_from_the_checkpoint(spark, tmp_path):
    """Two runs over one checkpoint give the same table as a single run."""
    def job(stream):
        return jobs.window_sums(stream, emit="update")

    tables = {}
    for name, parts in (("one", [FILES]), ("two", [FILES[:2], FILES[2:]])):
        t = KeyedTables(spark, work_dir(spark, "restart"))
        t.init()
        write = sinks.upsert_into(t, "agg_events", "job", sinks.downstream)
        done, checkpoint = 0, work_dir(spark, "cp")
        for part in parts:
            write_files(f"{tmp_path}/{name}", part, done)
            done += len(part)
            with sinks.stream_settings(spark, state_partitions=2):
                stream = text_stream(spark, f"{tmp_path}/{name}")
                sinks.run_available(job(stream), "update", checkpoint, write)
        tables[name] = rows(t.read("agg_events"))
    assert tables["one"] == tables["two"] and len(tables["one"]) == 3


def test_microbatch_job(spark, tmp_path):
    t = KeyedTables(spark, work_dir(spark, "micro"))
    t.init()
    messages = spark.createDataFrame(
        [
            ("a|d|0|c|1|1.0", 1000), ("a|d|0|c|5|2.0", 2000), ("b|d|0|c|10|0.5", 1500),
            ("broken", 1600), ("a|d|0|c|7|1.0", 9000),
        ],
        "value string, ms bigint",
    ).selectExpr("value", "timestamp_millis(ms) AS arrival")
    write = sinks.microbatch_into(t, "micro", slice_ms=5000)
    replay.replay(spark, messages, 5000, lambda stream: stream, "append", write)
    got = t.read("agg_events").select("window_time", "m1_sum_downstream", "m2_sum_downstream")
    assert rows(got) == [("1970-01-01 00:00:05", 15, 2.5), ("1970-01-01 00:00:10", 7, 1.0)]


def test_microbatch_label_defaults_to_the_clock(spark, messages):
    t = KeyedTables(spark, work_dir(spark, "micro"))
    t.init()
    sinks.microbatch_into(t, "micro")(messages, 0)
    label = t.read("agg_events").select("window_time").distinct().collect()
    assert len(label) == 1 and int(label[0][0][-2:]) % 5 == 0


def test_idle_watermark_closes_the_last_window(spark, tmp_path):
    """Live timestamps and no further events: the clock closes the window."""
    now = int(time.time() * 1000)
    write_files(f"{tmp_path}/in", [[f"a|d|{now}|c|3|1.0", f"b|d|{now}|c|4|1.0"]])
    out = Collect()
    with sinks.stream_settings(spark, idle=True, state_partitions=2):
        events = jobs.with_idle_watermark(spark, jobs.events_of(text_stream(spark, f"{tmp_path}/in")))
        query = sinks.run_forever(
            jobs.sums_of(events), "append", work_dir(spark, "cp"), out, "1 second"
        )
        try:
            end = time.time() + 60
            while not out.batches and time.time() < end:
                assert query.exception() is None
                time.sleep(0.5)
        finally:
            query.stop()
    label = spark.range(1).select(tw.label_end(F.lit(now))).first()[0]
    assert out.batches == [[(label, "d", "c", 7, 2.0)]]


def device_lines(spark, held):
    """Messages of one device: id, arrival and device time in milliseconds."""
    return spark.createDataFrame([(f"{i}|d|{device}|c|1|1.0", at) for i, at, device in held], "value string, at long").select(
        "value", tw.to_timestamp(F.col("at")).alias("arrival")
    )


def test_an_id_is_forgotten_after_the_delay(spark):
    """A copy within the delay goes, one after it is let through, and the state holds the last ids only."""
    start = 1_000_000
    held = [("a", start + at, 0) for at in (0, 10_500, 40_000, 41_000)]
    held += [(f"m{k}", start + 10_000 * k + 5, 0) for k in range(8) for _ in range(2)]
    out = Collect()

    def job(stream):
        events = jobs.watermarked(jobs.by_delivery(jobs.events_of(stream), 10_000), 10_000)
        return jobs.first_within_watermark(events, spread=False).select("message_id", F.unix_millis("event_time"))

    progress = replay.replay(spark, device_lines(spark, held), 10_000, job, "append", out)
    got = sorted(tuple(r) for batch in out.batches for r in batch)
    assert got == sorted([("a", start), ("a", start + 40_000)] + [(f"m{k}", start + 10_000 * k) for k in range(8)])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 4


@pytest.mark.parametrize("beats", [True, False])
def test_the_clock_of_a_replay_closes_windows(spark, beats):
    """Slices 2 and 3 are silent. The clock makes ``late`` late and closes the last window."""
    held = [("a", 1_000, 1_000), ("b", 12_000, 12_000), ("late", 41_000, 22_000), ("c", 42_000, 42_000)]
    messages = device_lines(spark, held)
    out = Collect()

    def job(stream):
        lines, clock = replay.clock_of(stream)
        return jobs.sums_of(jobs.with_idle_watermark(spark, jobs.events_of(lines), clock=clock))

    replay.replay(spark, replay.with_beats(messages, 10_000) if beats else messages, 10_000, job, "append", out, idle=True)
    ends = sorted(r[0][-2:] for batch in out.batches for r in batch)
    assert ends == (["05", "15", "45"] if beats else ["05", "15", "25"])


def test_beats_of_nothing(spark):
    assert replay.with_beats(device_lines(spark, [("a", 1, 1)]).where("value IS NULL"), 10).count() == 0


def test_print_stream(spark, folder):
    query = sinks.print_stream(text_stream(spark, folder))
    query.processAllAvailable()
    query.stop()
    assert sum(p["numInputRows"] for p in query.recentProgress) == sum(map(len, FILES))
    assert "Console" in query.lastProgress["sink"]["description"]


def test_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError):
        with session_conf(spark, spark__sql__shuffle__partitions="3"):
            assert spark.conf.get(key) == "3"
            raise RuntimeError
    assert spark.conf.get(key) == before


def test_slices_are_as_long_in_any_feed(spark, messages):
    got = replay.with_slice(messages, 4).groupBy("slice").count().collect()
    assert all(r["slice"] % 4 == 0 for r in got) and sum(r["count"] for r in got) == len(LINES) and len(got) >= 2


def test_late_rows_are_counted(spark, tmp_path):
    t = KeyedTables(spark, work_dir(spark, "late"))
    t.init()
    lines = spark.createDataFrame(
        [("a|d|1000|c|1|1.0", 1), ("b|d|60000|c|1|1.0", 5001), ("c|d|1000|c|1|1.0", 10001), ("d|d|70000|c|1|1.0", 10002)], "value string, ms bigint"
    ).selectExpr("value", "timestamp_millis(ms) AS arrival")
    write = sinks.upsert_into(t, "agg_events", "job", sinks.downstream)
    progress = replay.replay(spark, lines, 5000, jobs.window_sums, "append", write)
    assert sinks.dropped_by_watermark(progress) == 1


def test_file_sinks_and_sources(spark, messages, tmp_path, capsys):
    event_sink(messages, "parquet", path=f"{tmp_path}/p")
    event_sink(messages, "text", path=f"{tmp_path}/t")
    assert rows(spark.read.parquet(f"{tmp_path}/p")) == rows(messages)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == sorted(LINES)
    assert event_source(spark, "parquet", path=f"{tmp_path}/p").isStreaming
    event_sink(messages, "console")
    assert "bad|line" in capsys.readouterr().out
    with pytest.raises(ValueError):
        event_sink(messages, "carrier pigeon")
    with pytest.raises(ValueError):
        event_source(spark, "carrier pigeon")
    with pytest.raises(ValueError):
        event_source(spark, "kafka")


def fake_session(master, folder):
    conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": folder}.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_dir_uses_the_configured_folder():
    assert work_dir(fake_session("yarn", "hdfs://shared/cp/"), "x").startswith("hdfs://shared/cp/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(fake_session("yarn", None), "x")


def test_resumed_feed_equals_batch(spark):
    """A replay in slices that stops after each one, against the batch rule."""
    feed = feeds.build_feed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    t = KeyedTables(spark, work_dir(spark, "t"))
    t.init()
    write = sinks.upsert_into(t, "agg_events", "job", sinks.downstream)
    replay.replay(
        spark, feeds.to_payload(feed), 10_000,
        lambda m: jobs.window_sums(m, emit="update", measure=CENTS), "update", write,
    )
    want = aggregate.event_time_sums(feed, lateness.LateRule(batch_ms=10_000), CENTS)
    got = t.read("agg_events").select(
        "window_time", "device_id", "category", "m1_sum_downstream", "m2_sum_downstream"
    )
    assert rows(got) == rows(want)


def lines_at(spark, data):
    return spark.createDataFrame(data, "value string, ms bigint").selectExpr("value", "timestamp_millis(ms) AS arrival")


def test_a_slice_is_a_micro_batch_of_any_number_of_files(spark):
    """Files of 3 messages: the largest slice needs four, and each slice gets as many."""
    messages = lines_at(spark, [(str(i), 1000 * (i // 10)) for i in range(25)] + [("none", None)])
    folder = work_dir(spark, "deliver")
    files = replay.deliver(messages, folder, 1000, file_rows=3)
    out = Collect()
    options = {"maxFilesPerTrigger": str(files), "recursiveFileLookup": "true"}
    with sinks.stream_settings(spark, state_partitions=2):
        stream = event_source(spark, "parquet", path=f"{folder}/in", options=options)
        progress = sinks.run_available(stream.select("value"), "append", work_dir(spark, "cp"), out)
    assert files == 4
    assert out.batches == [[("none",)], *[sorted((str(i),) for i in range(a, b)) for a, b in ((0, 10), (10, 20), (20, 25))]]
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [1, 10, 10, 5] and len(progress) >= 8


def test_a_new_checkpoint_hides_nothing(spark, tmp_path):
    """Batch numbers begin again with it; the rows of the old one stay."""
    t = KeyedTables(spark, work_dir(spark, "again"))
    t.init()
    write = sinks.upsert_into(t, "agg_events", "job", sinks.downstream)
    for name, files in (("one", FILES[:2]), ("two", FILES[2:3])):
        write_files(f"{tmp_path}/{name}", files)
        with sinks.stream_settings(spark, state_partitions=2):
            job = jobs.window_sums(text_stream(spark, f"{tmp_path}/{name}"), emit="update")
            sinks.run_available(job, "update", work_dir(spark, "cp"), write)
    got = {r.window_time[-8:]: r.m1_sum_downstream for r in t.read("agg_events").collect()}
    assert got == {"11:02:00": 1, "11:02:15": 16}
    assert t.commits.all().select("run").distinct().count() == 2


def test_late_rows_of_a_stream(spark, tmp_path):
    write_files(f"{tmp_path}/in", FILES)
    got = run(spark, f"{tmp_path}/in", lambda m: stateful.late_rows(jobs.watermarked(jobs.events_of(m))), "append")
    assert [[(r[0], r[2], r[7], r[8]) for r in batch] for batch in got] == [
        [("a", 1472209316326, 1472209320000, 1472209331000), ("z", 1472209316000, 1472209320000, 1472209331000)]
    ]


def test_a_later_copy_takes_back_the_earlier_one(spark):
    t = KeyedTables(spark, work_dir(spark, "deltas"), tables=stateful.DELTAS, by_column=())
    t.init()
    messages = lines_at(spark, [
        ("a|d|1000|c|1|1.5", 10), ("a|d|1000|c|2|1.5", 20), ("b|d|2000|c|10|0.25", 30),  # one slice: the last copy
        ("a|d|1000|x|5|1.5", 1010), ("b|d|2000|c|10|0.25", 1020),  # a moves to x, b is repeated as it is
        ("a|d|1000|x|7|2.0", 2010), ("z|d|100000|c|0|0.0", 2020),  # raises the watermark
        ("a|d|1000|x|9|9.0", 3010),  # its window is closed
    ])
    job = lambda m: stateful.last_copy_deltas(jobs.events_of(m, 2), 50_000, CENTS)
    replay.replay(spark, messages, 1000, job, "update", stateful.deltas_into(t, "job"))
    first = "1970-01-01 00:00:05"
    assert rows(stateful.versions(t, CENTS)) == [
        (first, "d", "c", 1, 12, 1.75), (first, "d", "c", 2, 10, 0.25), (first, "d", "x", 1, 5, 1.5), (first, "d", "x", 2, 7, 2.0),
        ("1970-01-01 00:01:45", "d", "c", 1, 0, 0.0),
    ]


def test_every_line_goes_somewhere(spark):
    """Two repeats, one late row, two bad lines of one text; each batch is one commit."""
    t = KeyedTables(spark, work_dir(spark, "outputs"), outputs.TABLES)
    t.init()
    messages = lines_at(spark, [
        (A, 10), (A, 20), ("bad|line", 30), ("bad|line", 30), ("b|d|1472209317000|c1|2|2.5", 40),
        ("c|d|1472209331000|c1|4|1.25", 1010), (A, 1020), ("e|d|x|c2|1|1", 1030),
        ("z|d|1472209316000|c1|100|9.0", 2010), (None, 2020),
    ])
    replay.replay(spark, messages, 1000, lambda m: outputs.sorted_lines(m, measure=CENTS), "append", outputs.outputs_into(t, "job", CENTS))
    assert rows(outputs.stored_sums(t, CENTS)) == [
        ("2016-08-26 11:02:00", "d", "c1", 3, 4.0), ("2016-08-26 11:02:15", "d", "c1", 4, 1.25)
    ]
    assert t.log("debug").count() == 3
    assert [r.message_id for r in t.log("late_events").collect()] == ["z"]
    assert rows(t.log("quarantine").select("reason", "value", "n")) == [
        ("bad timestamp", "e|d|x|c2|1|1", 1), ("empty value", None, 1), ("too few fields", "bad|line", 2)
    ]
    commits = t.commits.all().collect()
    assert all(set(c.tables) == {"increments", "debug", "late_events", "quarantine"} for c in commits)


def test_own_aggregate_of_a_stream(spark, folder):
    def job(stream):
        first = jobs.first_seen(jobs.watermarked(jobs.events_of(stream)))
        return custom.stream_aggregate_by(first.drop("event_time"), ["category"], custom.median_of("measure1"))

    got = run(spark, folder, job, "append")
    assert [r for batch in got for r in batch] == [("2016-08-26 11:02:00", "c1", 1, 1), ("2016-08-26 11:02:15", "c1", 4, 2)]


def test_windows_of_the_clock_close_by_themselves(spark, folder):
    """No event after them, no watermark: the timer closes the windows, and copies in one count once."""
    out = Collect()
    with sinks.stream_settings(spark, state_partitions=2):
        stream = event_source(spark, "text", path=folder)
        sinks.run_until_closed(stateful.processing_sums(jobs.events_of(stream)), "append", work_dir(spark, "cp"), out)
    got = [r for batch in out.batches for r in batch]
    assert sum(r[3] for r in got) == 1 + 4 + 16 + 100 + 32 and len({r[0] for r in got}) == 1
    assert all(int(r[0][-2:]) % 5 == 0 for r in got)

