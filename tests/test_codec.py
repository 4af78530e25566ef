import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import LINES, rows
from tidemark.functions import codec, timewin as tw
from tidemark.session import session_conf


def parse(spark, lines):
    return codec.parse_payload(spark.createDataFrame([(l,) for l in lines], "value string"))


def test_documented_line(spark):
    parsed = parse(spark, ["123-12|123|1472209316326|cat1|456|789.12"])
    row = parsed.withColumn("t", tw.time_text(F.col("event_time"))).first()
    assert row.message_id == "123-12" and row.device_id == "123" and row.category == "cat1"
    assert (row.device_ms, row.measure1, row.measure2) == (1472209316326, 456, 789.12)
    assert row.t == "2016-08-26 11:01:56.326" and row.reason is None


def test_bad_lines_are_named(spark):
    lines = [
        "bad|line", "", None, "e|d|1|c|x|1", "e|d|1|c|1|", "e|d|1|c|1.5|1", "e|d|soon|c|1|1",
        "e|d|9223372036854775807|c|1|1", "e|d|99999999999999999999|c|1|1", "e|d|1|c|1|1|more",
    ]
    got = [r.reason for r in parse(spark, lines).collect()]
    assert got == [
        "too few fields", "too few fields", "empty value", "bad measure1", "bad measure2",
        "bad measure1", "bad timestamp", "bad timestamp", "bad timestamp", None,
    ]


def test_split_valid_loses_nothing(spark, messages):
    good, quarantine = codec.split_valid(codec.parse_payload(messages))
    assert good.count() == 6
    assert rows(quarantine) == [
        ("bad|line", "too few fields"), ("e|d|1472209330500|c2|x|1", "bad measure1")
    ]
    assert good.count() + quarantine.count() == len(LINES)


def test_parse_does_not_split_again_for_the_filter(messages):
    good, _ = codec.split_valid(codec.parse_payload(messages))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_strict_parsing_fails_even_when_no_checked_column_is_used(spark, messages):
    with pytest.raises(Exception, match="too few fields: bad|bad measure1: e"):
        codec.parse_strict(messages).agg(F.sum("measure2")).collect()
    good = spark.createDataFrame([(LINES[0],)], "value string")
    assert codec.parse_strict(good).count() == 1


FIELD = st.text(alphabet=st.characters(blacklist_characters="|", blacklist_categories=("Cs", "Cc")), max_size=8)


NAME = FIELD.filter(bool)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            NAME, NAME, st.integers(tw.MIN_MS, tw.MAX_MS), NAME,
            st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False),
        ),
        min_size=1, max_size=20,
    )
)
def test_round_trip(spark, data):
    df = spark.createDataFrame(
        data, "message_id string, device_id string, device_ms bigint, category string, "
        "measure1 bigint, measure2 double"
    )
    parsed = codec.parse_payload(df.select(codec.encode_events(df).alias("value")))
    assert parsed.filter("reason IS NOT NULL").count() == 0
    assert [tuple(r) for r in parsed.select(*df.columns).collect()] == data


def test_null_field_does_not_shift_the_others(spark):
    df = spark.createDataFrame(
        [("m", None, 5, None, 7, 1.5)],
        "message_id string, device_id string, device_ms bigint, category string, "
        "measure1 bigint, measure2 double",
    )
    assert df.select(codec.encode_events(df)).first()[0] == "m||5||7|1.5"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_labels_do_not_depend_on_the_session_zone(spark, zone):
    # The last two are in the hour New York skips and in the one it repeats.
    ms = [1472209316326, 0, -1, 1709992805000, 1730613600000]
    with session_conf(spark, spark__sql__session__timeZone=zone):
        df = spark.createDataFrame([(m,) for m in ms], "ms bigint")
        window = tw.window_of(tw.to_timestamp(F.col("ms")))
        got = df.select("ms", window.alias("w")).select(
            tw.ms_text(F.col("ms")), tw.label_start(F.col("ms")), tw.label_end(F.col("ms")),
            tw.window_label(F.col("w")), tw.window_label(F.col("w"), "start"),
        ).collect()
    assert got[0][:3] == ("2016-08-26 11:01:56", "2016-08-26 11:01:55", "2016-08-26 11:02:00")
    assert got[1][:3] == ("1970-01-01 00:00:00", "1970-01-01 00:00:00", "1970-01-01 00:00:05")
    assert got[2][:3] == ("1969-12-31 23:59:59", "1969-12-31 23:59:55", "1970-01-01 00:00:00")
    assert got[3][0] == "2024-03-09 14:00:05" and got[4][0] == "2024-11-03 06:00:00"
    for row in got:
        assert (row[2], row[1]) == (row[3], row[4])


def test_window_label_rejects_other_names(spark):
    with pytest.raises(ValueError):
        tw.window_label(F.lit(None), "middle")


def test_text_forms(spark):
    df = spark.createDataFrame(
        [("m-1", "dev", 1472209316326, "cat-1", 3, 2.5)],
        "message_id string, device_id string, device_ms bigint, category string, "
        "measure1 bigint, measure2 double",
    )
    tab, comma = df.select(codec.render_event("tab"), codec.render_event("comma")).first()
    assert tab == "m-1\tdev\t1472209316326\tcat-1\t3\t2.5\n"
    assert comma == "m-1,dev, 1472209316326, cat-1,3, 2.5"
    with pytest.raises(ValueError):
        codec.render_event("xml")
    window = tw.window_of(tw.to_timestamp(F.col("device_ms")))
    message = df.withColumn("w", window).select(codec.debug_message(F.col("w"))).first()[0]
    assert message == (
        "MESSAGE_ID=m-1, DEVICE_ID=dev, TIMESTAMP=1472209316326, time window start=1472209315000, "
        "time window end=1472209320000, CATEGORY=cat-1, M1=3, M2=2.5"
    )


def test_window_key_text(spark):
    key = spark.range(1).select(
        codec.window_key_text(F.lit("dev"), F.lit("cat-1"), F.lit(1472209315000)).alias("k")
    )
    assert key.first().k == "[dev, cat-1@1472209315000]"
    parts = codec.parse_window_key(F.col("k"))
    assert tuple(key.select(*parts.values()).first()) == ("dev", "cat-1", "2016-08-26 11:02:00")


def test_lateness(spark):
    got = spark.range(1).select(tw.lateness_seconds(F.lit(5000), F.lit(2500))).first()[0]
    assert got == 2.5


def test_faults_are_quarantined_and_nothing_is_lost(spark):
    lines = [
        "a|d|1000|c|1|1.5", "|d|1000|c|1|1.0", "|d|1001|c|2|1.0", "a||1002|c|4|1.0", "a|d|1002||4|1.0", "||1002||4|1.0",
        "a|d|1|c|1|NaN", "a|d|1|c|1|Infinity", "a|d|1|c|1|-Infinity", "a|d|1|c|1|1e300", "a|d|1|c|1|0.125",
    ]
    parsed = codec.parse_payload(spark.createDataFrame([(line,) for line in lines], "value string"), scale=2)
    good, quarantine = codec.split_valid(parsed)
    assert [r.measure2 for r in good.collect()] == [1.5]
    reasons = {r.value: r.reason for r in quarantine.collect()}
    assert len(reasons) == 10 and reasons["|d|1001|c|2|1.0"] == "empty message_id" and reasons["a||1002|c|4|1.0"] == "empty device_id"
    assert reasons["a|d|1002||4|1.0"] == "empty category"
    assert [reasons[line] for line in lines[6:11]] == ["bad measure2"] * 5
    plain = codec.split_valid(codec.parse_payload(spark.createDataFrame([(lines[10],)], "value string")))[0]
    assert plain.first().measure2 == 0.125


def test_finer_readings_fail_and_are_not_rounded(spark):
    from tidemark.functions.measures import CENTS

    values = spark.createDataFrame([(0.07,), (123456789.13,), (None,), (-1e9,)], "v double")
    assert values.agg(F.sum(CENTS.pack(F.col("v")))).first()[0] == 7 + 12345678913 - 10**11
    with pytest.raises(Exception, match="more than 2 decimals"):
        spark.createDataFrame([(0.125,)], "v double").select(CENTS.pack(F.col("v"))).collect()


def test_a_property_that_is_no_number_reaches_the_quarantine(spark):
    from tidemark.operators import feed as feeds

    events = spark.createDataFrame(
        [(0, 1, "c", '{"k": "x"}', 1.0), (1, 1, "c", '{"k": 5}', float("nan")), (2, 1, "c", '{"k": 5}', 1.0)],
        "event_id bigint, user_id bigint, event_type string, props string, value double",
    )
    good, quarantine = feeds.from_payload(feeds.to_payload(feeds.build_feed(events)), 2)
    assert {r.reason for r in quarantine.collect()} == {"bad measure1", "bad measure2"}
    assert {r.message_id for r in good.collect()} == {"dev-1-2"}
