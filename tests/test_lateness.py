import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions.measures import CENTS
from tidemark.operators import aggregate, lateness


def make(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        message = f"m{rng.randrange(200)}"
        send = 1_000_000 + rng.randrange(120) * 1000 + rng.randrange(1000)
        if 1_040_000 <= send < 1_060_000:
            send += 30_000  # arrival batches without a message
        device = send - rng.choice([0, 0, 500, 4000, 7000, 30_000]) + rng.choice([0, 0, 2500])
        out.append((message, f"d{rng.randrange(2)}", device, f"c{rng.randrange(2)}",
                    rng.randrange(100), rng.randrange(1000) / 100, send))
    return out


def brute_watermarks(data, delay=1000, batch_ms=5000):
    high = {}
    for r in data:
        b = r[6] // batch_ms * batch_ms
        high[b] = max(high.get(b, r[2]), r[2])
    order = sorted(high)
    result = {}
    for i, b in enumerate(order):
        seen = [high[x] for x in order[:i]]
        result[b] = max(seen) - delay if seen else None
    return result


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_watermarks(make_events, monkeypatch, block):
    monkeypatch.setattr(lateness, "BLOCK", block)
    data = make(3)
    rule = lateness.LateRule()
    got = {r.batch: r.watermark_ms for r in lateness.batch_watermarks(make_events(data), rule).collect()}
    assert got == brute_watermarks(data)


def on_time(data):
    marks = brute_watermarks(data)
    keep = []
    for r in data:
        mark, end = marks[r[6] // 5000 * 5000], r[2] // 5000 * 5000 + 5000
        if mark is None or end > mark:
            keep.append(r)
    return keep


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sums_equal_filter_then_deduplicate(make_events, seed):
    """The operator deduplicates first and joins the watermark to the sums; the
    plain order is: drop late rows, keep the first copy, sum."""
    data = make(seed)
    first = {}
    for r in sorted(on_time(data), key=lambda r: (r[6], r[1], r[3], r[4], r[5], r[2])):
        first.setdefault((r[0], r[2] // 5000), r)
    want = {}
    for (_, w), r in first.items():
        m1, m2 = want.get((w, r[1], r[3]), (0, 0))
        want[(w, r[1], r[3])] = (m1 + r[4], m2 + round(r[5] * 100))
    parts = aggregate.event_time_parts(make_events(data), lateness.LateRule(), CENTS, copies_agree=False)
    sums = parts.groupBy("window", "device_id", "category").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    got = {
        (r.start // 5000, r.device_id, r.category): (r.m1, r.m2)
        for r in sums.withColumn("start", F.unix_millis("window.start")).collect()
    }
    assert got == want and len(on_time(data)) < len(data)


def test_late_rows(make_events):
    data = make(4)
    got = lateness.late_rows(make_events(data)).select(
        "message_id", "device_id", "device_ms", "category", "measure1", "measure2", "send_ms"
    )
    kept = on_time(data)
    want = list(data)
    for r in kept:
        want.remove(r)
    assert rows(got) == sorted(want) and want


def test_watermark_out_of_the_sums_when_copies_agree(make_events):
    """The same sums whether the watermark is read from the feed or from the sums."""
    first = {}
    data = [(*first.setdefault((r[0], r[2] // 5000), r)[:6], r[6]) for r in sorted(make(6), key=lambda r: r[6])]
    one, two = (
        rows(aggregate.event_time_parts(make_events(data), measure=CENTS, copies_agree=agree).drop("batch"))
        for agree in (True, False)
    )
    assert one == two


def test_another_arrival_column_decides_the_first_copy(make_events):
    """The copy that came first by the rule's column was on time, the other one wasn't."""
    data = [("a", "d", 1_000_000, "c", 1, 1.0, 2_000_000), ("a", "d", 1_000_000, "c", 1, 1.0, 1_000_500), ("b", "d", 1_100_000, "c", 2, 1.0, 1_050_000)]
    events = make_events(data).withColumn("got", F.when(F.col("send_ms") == 2_000_000, 1_000_000).otherwise(F.col("send_ms") + 500_000))
    for agree in (True, False):
        parts = aggregate.event_time_parts(events, lateness.LateRule(arrival="got"), CENTS, copies_agree=agree)
        assert sorted(r.m1 for r in parts.collect()) == [1, 2]
