from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import codec
from tidemark.operators import feed as feeds

SF = "/root/testdata/sf0.001"


def expected_feed(events):
    """The feed by plain arithmetic, row by row."""
    originals = {}
    for e in events:
        s, send = e.event_id, 1704067200000 + e.event_id * 50
        device = f"dev-{e.user_id % 4}"
        late = s * 7919 % 1000 < 10
        at = send - 120000 - s * 104729 % 300000 if late else send
        k = int(e.props.split(":")[1].strip(" }"))
        originals[s] = (s, f"{device}-{s}", device, e.event_type, k, e.value, send, at, "late" if late else "")
    resent = []
    for s, row in originals.items():
        if s * 15485863 % 1000 < 50:
            target = originals.get(s * (s * 31 % 1000) // 1000)
            if target:
                resent.append((*target[:6], row[6] + 1, target[7], "re"))
    return sorted([*originals.values(), *resent])


def test_feed_matches_arithmetic(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = rows(feeds.build_feed(events).select(*feeds.FEED_COLUMNS))
    want = expected_feed(events.collect())
    assert got == want
    assert len(got) == 1050 and sum(r[-1] == "late" for r in got) == 10


def test_feed_does_not_depend_on_partitions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    one = feeds.build_feed(events.coalesce(1))
    many = feeds.build_feed(events.repartition(7, "user_id"))
    assert rows(one) == rows(many)


def test_large_sequence_numbers_do_not_overflow(spark):
    big = 3_000_000_000_000
    readings = spark.range(big, big + 2000).select(
        F.col("id").alias("s"), F.lit("dev-0").alias("device_id"), F.lit("c").alias("category"),
        F.lit(1).cast("bigint").alias("measure1"), F.lit(1.0).alias("measure2"),
    )
    originals = feeds.mark_late(feeds.base_feed(readings))
    got = {r.s: r for r in originals.collect()}
    for s in (big, big + 7, big + 1999):
        late = s * 7919 % 1000 < 10
        send = 1704067200000 + s * 50
        assert got[s].device_ms == (send - 120000 - s * 104729 % 300000 if late else send)
    feeds.resend(originals).collect()


def test_payload_round_trip(spark):
    feed = feeds.build_feed(spark.read.parquet(f"{SF}/events.parquet"))
    good, quarantine = feeds.from_payload(feeds.to_payload(feed))
    columns = [*codec.PAYLOAD_FIELDS, "send_ms"]
    assert rows(good.select(*columns)) == rows(feed.select(*columns))
    assert quarantine.count() == 0


def test_json_field_forms(spark):
    """The pattern for the plain form and the JSON parser give the same."""
    forms = [
        '{"k": 7}', '{"k":-12}', ' { "k" : 0 } ', '{"k": 007}', '{"a": 1, "k": 5}', '{"k": "9"}',
        '{"x": {"k": 1}}', '{}', "", None, '{"k": 123456789012345678}',
    ]
    df = spark.createDataFrame([(f,) for f in forms], "props string")
    got = df.select(
        feeds._k(F.col("props")).alias("fast"), F.get_json_object("props", "$.k").cast("bigint").alias("json")
    ).collect()
    assert all(r.fast == r.json for r in got)
    assert [r.fast for r in got][:3] == [7, -12, 0] and got[4].fast == 5 and got[6].fast is None


def test_resend_of_derived_rows_equals_the_feed(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    originals = feeds.mark_late(feeds.base_feed(feeds.readings(events)))
    copies = feeds.build_feed(events).filter("patterncode = 're'")
    assert rows(feeds.resend(originals)) == rows(copies)
