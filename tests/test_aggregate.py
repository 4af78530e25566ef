import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import timewin as tw
from tidemark.functions.measures import CENTS, Fixed, PLAIN
from tidemark.operators import aggregate, dedup, feed as feeds, numeric, reconcile, text

EXPECTED = [
    ("2016-08-26 10:58:25", "d", "c1", 100, 9.0),
    ("2016-08-26 11:02:00", "d", "c1", 3, 4.0),
    ("2016-08-26 11:02:05", "d", "c1", 4, 1.0),
    ("2016-08-26 11:02:15", "d", "c1", 8, 1.0),
]


@pytest.mark.parametrize("measure", [PLAIN, CENTS, Fixed(4)])
def test_hand_made_sums(messages, measure):
    events, _ = feeds.from_payload(messages)
    first = dedup.first_per_window(events)
    assert rows(aggregate.window_sums(first, None, measure)) == EXPECTED


def test_start_labels_and_duplicates(messages):
    events, _ = feeds.from_payload(messages)
    got = rows(aggregate.complete_sums(events))
    assert got[1] == ("2016-08-26 11:01:55", "d", "c1", 4, 5.5)
    assert got[0][0] == "2016-08-26 10:58:20"


def test_one_arrival_batch_has_no_late_rows(messages):
    events, _ = feeds.from_payload(messages)
    assert rows(aggregate.event_time_sums(events)) == EXPECTED


def test_arrival_modes(make_events):
    a = ("a", "d", 0, "c", 1, 1.0)
    data = [(*a, 1000), (*a, 2000), (*a, 7000), ("b", "d", 0, "c", 10, 0.25, 1500)]
    events = make_events(data)
    want = [("1970-01-01 00:00:05", "d", "c", 11, 1.25), ("1970-01-01 00:00:10", "d", "c", 1, 1.0)]
    assert rows(aggregate.arrival_time_sums(events)) == want
    assert rows(aggregate.microbatch_sums(events)) == want
    assert rows(aggregate.changelog_sums(events)) == want


def test_first_and_last_copy_differ(make_events):
    events = make_events([("a", "d", 0, "c", 1, 1.0, 1000), ("a", "d", 0, "c", 5, 2.0, 2000)])
    assert rows(aggregate.arrival_time_sums(events))[0][3:] == (1, 1.0)
    assert rows(aggregate.microbatch_sums(events))[0][3:] == (5, 2.0)
    assert rows(aggregate.changelog_sums(events))[0][3:] == (5, 2.0)


@pytest.mark.parametrize("slide", [1000, 2500, 5000])
def test_sliding(make_events, slide):
    rng = random.Random(2)
    data = [
        (f"m{rng.randrange(60)}", "d", rng.randrange(30000), f"c{rng.randrange(2)}", rng.randrange(9), 0.5, i)
        for i in range(200)
    ]
    want = {}
    seen = set()
    for r in data:  # already in arrival order
        start = r[2] // slide * slide
        while start > r[2] - 5000:
            if (r[0], start) not in seen:
                seen.add((r[0], start))
                m1, m2 = want.get((start, r[3]), (0, 0))
                want[(start, r[3])] = (m1 + r[4], m2 + r[5])
            start -= slide
    got = aggregate.sliding_sums(make_events(data), slide_ms=slide)
    labelled = {}
    for (start, category), sums in want.items():
        labelled[(start + 5000, category)] = sums
    back = got.select(
        (F.unix_millis(F.to_timestamp("window_time"))).alias("ms"), "category", "m1_sum", "m2_sum"
    )
    assert {(r.ms, r.category): (r.m1_sum, r.m2_sum) for r in back.collect()} == labelled


def test_truths_count_originals_once(spark):
    feed = feeds.build_feed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    total = feed.filter("patterncode <> 're'").agg(F.sum("measure1")).first()[0]
    for side in ("ingest_devicetime", "ingest_sendtime"):
        truth = reconcile.truth(feed, side, CENTS)
        assert truth.agg(F.sum(f"m1_sum_{side}")).first()[0] == total


def test_cents_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.01, -1e9, 0.07] * 50
    df = spark.createDataFrame([(1, v) for v in values], "measure1 int, measure2 double")
    sums = {
        aggregate.sum_by(df.repartition(n).withColumn("k", F.lit(1)), ["k"], CENTS).first().m2
        for n in (1, 3, 7)
    }
    assert sums == {sum(round(v * 100) for v in values)}


LITERAL = [
    "The meter by the door counts, and the one at the gate counts too.",
    "Nobody reads it at night; it's the noon value that we keep --",
    "a late one, or one sent twice, is dropped.",
]


def test_word_count_of_literals(spark):
    lines = spark.createDataFrame([(l,) for l in LITERAL], "text string")
    counts = {r.word: r.n for r in text.word_count(lines).collect()}
    assert counts["the"] == 5 and counts["one"] == 3 and counts["counts"] == 2 and counts["s"] == 1 and "" not in counts
    assert sum(counts.values()) == 14 + 13 + 9


def test_pi(spark):
    row = numeric.pi_from_points(numeric.random_points(spark, 200_000, 4)).first()
    assert row.n == 200_000 and abs(row.pi - 3.14159) < 0.02


def test_time_spine(spark):
    got = numeric.time_spine(spark.range(1, 61).toDF("i")).orderBy("i").collect()
    assert len(got) == 60
    assert got[0].value == "user_id:1;2015-05-01 00:11:00;event_number_1"
    assert got[-1].value == "user_id:60;2015-05-01 01:10:00;event_number_60"


def test_debug_rows_are_repeatable(messages):
    events, _ = feeds.from_payload(messages)
    got = rows(aggregate.debug_rows(dedup.first_per_window(events)))
    assert len(got) == 5 and len({r[0] for r in got}) == 5
    assert got[0][0] == "windowed - a - 1472209320000"


@pytest.mark.parametrize("size,slide", [(5000, 1000), (5000, 5000), (60_000, 1000), (5000, 2500)])
def test_panes_equal_copies_in_every_window(make_events, size, slide):
    """Copies whose device times differ overlap in part, also with two earlier ones around them."""
    rng = random.Random(slide + size)
    data = [
        (f"m{rng.randrange(40)}", f"d{rng.randrange(2)}", rng.randrange(-20_000, 60_000), f"c{rng.randrange(2)}", rng.randrange(9), rng.randrange(400) / 4, rng.randrange(50))
        for _ in range(400)
    ]
    events = make_events(data)
    first = dedup.first_per_window(
        events.select("message_id", "send_ms", "device_id", "category", "measure1", "measure2", "device_ms"), tw.to_timestamp(F.col("device_ms")), size, slide
    )
    assert rows(aggregate.pane_sums(events, size, slide, CENTS)) == rows(aggregate.window_sums(first, None, CENTS))


def test_panes_with_missing_measures(make_events):
    events = make_events([("a", "d", 1000, "c", None, 1.5, 1), ("b", "d", 3000, "c", 2, None, 2), ("c", "d", 90_000, "c", None, None, 3)])
    first = dedup.first_per_window(events, tw.to_timestamp(F.col("device_ms")), 4000, 1000)
    assert rows(aggregate.pane_sums(events, 4000, 1000, CENTS)) == rows(aggregate.window_sums(first, None, CENTS))
