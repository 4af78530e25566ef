import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark import schema
from tidemark.operators import upsert
from tidemark.session import work_dir
from tidemark.sources.tables import KeyedTables, count_tables

DDL = "k string, a bigint, b double"


def frame(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


def test_full_upsert(spark):
    old = frame(spark, [("x", 1, 1.0), ("y", 2, None)])
    new = frame(spark, [("y", None, 9.0), ("z", 3, 3.0)])
    once = upsert.upsert_full(old, new, ["k"])
    assert rows(once) == [("x", 1, 1.0), ("y", None, 9.0), ("z", 3, 3.0)]
    assert rows(upsert.upsert_full(once, new, ["k"])) == rows(once)


def test_full_upsert_with_order_inside_the_new_rows(spark):
    old = frame(spark, [("x", 1, 1.0)])
    new = frame(spark, [("x", 5, 0.5), ("x", 7, 0.1), ("x", 6, 0.9)])
    assert rows(upsert.upsert_full(old, new, ["k"], order=["a"])) == [("x", 7, 0.1)]


def test_partial_upsert_keeps_other_columns(spark):
    old = frame(spark, [("x", 1, 1.0), ("y", 2, 2.0)])
    new = frame(spark, [("y", 20), ("z", 30)], "k string, a bigint")
    once = upsert.upsert_partial(old, new, ["k"])
    assert rows(once) == [("x", 1, 1.0), ("y", 20, 2.0), ("z", 30, None)]
    assert rows(upsert.upsert_partial(once, new, ["k"])) == rows(once)


def test_null_key_is_refused(spark):
    with pytest.raises(Exception, match="NULL in key"):
        upsert.upsert_full(frame(spark, []), frame(spark, [(None, 1, 1.0)]), ["k"]).collect()


@pytest.fixture()
def tables(spark):
    t = KeyedTables(spark, work_dir(spark, "test-tables"))
    t.init()
    return t


def agg(spark, *data, side="downstream"):
    ddl = f"window_time string, device_id string, category string, m1_sum_{side} bigint, m2_sum_{side} double"
    return spark.createDataFrame(list(data), ddl)


def test_tables_start_empty_and_count(tables):
    assert {r.table_name: r.n for r in tables.counts().collect()} == {
        "raw_events": 0, "agg_events": 0, "debug": 0
    }


def test_missing_table_is_an_error(spark):
    with pytest.raises(ValueError, match="does not exist"):
        KeyedTables(spark, work_dir(spark, "none")).read("debug")


def test_seed_rows(spark, tables):
    seed = spark.sql(
        "SELECT 'sampledevice-1' message_id, 'sampledevice' device_id, "
        "timestamp_millis(1472209316326) device_time, timestamp_millis(1472209318532) send_time, "
        "'sample' category, 100L measure1, 1234.56D measure2"
    )
    tables.write("raw_events", seed, "seed")
    tables.write("raw_events", seed, "seed-again")
    assert tables.read("raw_events").count() == 1
    with pytest.raises(Exception, match="NULL in key"):
        tables.write("raw_events", seed.drop("send_time").withColumn("send_time", F.lit(None)), "bad")


def test_writers_fill_their_own_columns(spark, tables):
    tables.write("agg_events", agg(spark, ("w1", "d", "c", 1, 1.0), side="ingest_devicetime"), "truth")
    tables.write("agg_events", agg(spark, ("w1", "d", "c", 2, 2.0), ("w2", "d", "c", 3, 3.0)), "job", 0)
    got = {r.window_time: r for r in tables.read("agg_events").collect()}
    assert got["w1"].m1_sum_ingest_devicetime == 1 and got["w1"].m1_sum_downstream == 2
    assert got["w1"].m1_sum_ingest_sendtime is None and got["w2"].m2_sum_downstream == 3.0


def test_later_batch_wins_and_a_repeated_batch_replaces_itself(spark, tables):
    for batch, value in ((0, 1), (1, 5), (1, 5)):
        tables.write("agg_events", agg(spark, ("w", "d", "c", value, float(value))), "job", batch, run="r")
    assert tables.log("agg_events").count() == 2
    assert tables.read("agg_events").first().m1_sum_downstream == 5
    tables.write("agg_events", agg(spark, ("w", "d", "c", 4, 4.0)), "job", 1, run="r")
    assert tables.read("agg_events").first().m1_sum_downstream == 4


@pytest.mark.parametrize("order", [("job", "other"), ("other", "job")])
def test_the_last_write_wins_whoever_wrote_it(spark, tables, order):
    """Batch numbers are each writer's own and don't order writers."""
    for name, batch, value in zip(order, (5, 0), (1, 2)):
        tables.write("agg_events", agg(spark, ("w", "d", "c", value, 1.0)), name, batch)
        tables.write("debug", spark.createDataFrame([("1", f"by {name}")], schema.DEBUG), name, batch)
    assert tables.read("agg_events").first().m1_sum_downstream == 2
    assert tables.read("debug").first().message == f"by {order[1]}"


def test_a_write_leaves_the_files_of_others_alone(spark, tables):
    tables.write("debug", spark.createDataFrame([("1", "a")], schema.DEBUG), "t", 0, run="r")
    before = {r.f for r in spark.read.parquet(f"{tables.path}/debug").select(F.input_file_name().alias("f")).collect()}
    tables.write("debug", spark.createDataFrame([("1", "b")], schema.DEBUG), "t", 0, run="r")
    assert tables.read("debug").first().message == "b" and tables.log("debug").count() == 1
    assert spark.read.parquet(*before).count() == 1


def test_two_writes_of_a_writer_both_stay(spark, tables):
    """A job that runs every night has no batch numbers."""
    tables.write("agg_events", agg(spark, ("w1", "d", "c", 1, 1.0)), "job")
    tables.write("agg_events", agg(spark, ("w2", "d", "c", 2, 2.0)), "job")
    assert rows(tables.read("agg_events").select("window_time", "m1_sum_downstream")) == [("w1", 1), ("w2", 2)]


def test_an_attempt_without_a_commit_is_not_seen(spark, tables, monkeypatch):
    tables.write("debug", spark.createDataFrame([("1", "a")], schema.DEBUG), "t", 0, run="r")
    with monkeypatch.context() as m:
        m.setattr(tables.commits, "add", lambda *a: None)
        tables.write("debug", spark.createDataFrame([("1", "lost"), ("2", "lost")], schema.DEBUG), "t", 1, run="r")
    assert rows(tables.read("debug")) == [("1", "a")]
    tables.write("debug", spark.createDataFrame([("2", "b")], schema.DEBUG), "t", 1, run="r")
    assert rows(tables.read("debug")) == [("1", "a"), ("2", "b")]


def test_one_commit_covers_several_tables(spark, tables):
    debug = spark.createDataFrame([("1", "a")], schema.DEBUG)
    tables.write_all({"debug": debug, "agg_events": agg(spark, ("w", "d", "c", 1, 1.0))}, "job", 3, run="r")
    assert tables.commits.all().count() == 1
    assert tables.read("debug").count() == tables.read("agg_events").count() == 1
    tables.write_all({"debug": spark.createDataFrame([("2", "b")], schema.DEBUG)}, "job", 3, run="r")
    assert rows(tables.read("debug")) == [("2", "b")] and tables.read("agg_events").count() == 1


def test_order_is_that_of_the_commits(spark, tables):
    """Two openers of one folder take numbers from one sequence."""
    other = KeyedTables(spark, tables.path)
    for i, t in enumerate([tables, tables, other, tables, other]):
        t.write("debug", spark.createDataFrame([("1", str(i))], schema.DEBUG), "w")
    assert [r.place for r in tables.commits.all().orderBy("place").collect()] == [1, 2, 3, 4, 5]
    assert rows(other.read("debug")) == [("1", "4")]
    tables.reset()
    other.write("debug", spark.createDataFrame([("1", "new")], schema.DEBUG), "w")
    assert [r.place for r in tables.commits.all().collect()] == [1] and rows(tables.read("debug")) == [("1", "new")]


def test_a_damaged_commit_is_none(spark, tables):
    tables.write("debug", spark.createDataFrame([("1", "a")], schema.DEBUG), "w")
    folder = tables.path.removeprefix("file:")
    with open(f"{folder}/_commits/000000000000002.json", "w") as half:
        half.write('{"place": 2, "attempt": "x", "wri')
    tables.write("debug", spark.createDataFrame([("2", "b")], schema.DEBUG), "w")
    assert rows(tables.read("debug")) == [("1", "a"), ("2", "b")]


def test_reset_and_drop(spark, tables):
    tables.write("debug", spark.createDataFrame([("1", "hello")], schema.DEBUG), "t")
    assert tables.read("debug").count() == 1
    tables.reset()
    assert tables.read("debug").count() == 0
    tables.drop("debug")
    with pytest.raises(ValueError):
        tables.read("debug")
    tables.init()
    assert tables.read("debug").count() == 0


def test_stored_order(spark, tables):
    data = [(f"w{i % 7}", f"d{i % 3}", f"c{i}", i, 0.0) for i in range(50)]
    tables.write("agg_events", agg(spark, *data).repartition(3), "job")
    stored = spark.read.parquet(f"{tables.path}/agg_events").withColumn("file", F.input_file_name())
    for file in {r.file for r in stored.select("file").collect()}:
        part = spark.read.parquet(file).select(*schema.AGG_EVENTS_KEY).collect()
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)


def test_count_tables(spark):
    got = count_tables({"a": spark.range(3), "b": spark.range(0)})
    assert rows(got) == [("a", 3), ("b", 0)]


def test_layout_by_key(spark, tables):
    """Every device in one file, files in key order, all rows there once."""
    data = [(f"w{i % 7}", f"d{i % 5}", f"c{i}", i, 0.0) for i in range(60)]
    for part in (data[:40], data[30:]):
        tables.write("agg_events", agg(spark, *part).repartition(3), "job")
    laid = tables.lay_out("agg_events", 4)
    assert rows(laid) == rows(tables.read("agg_events")) and laid.count() == 60
    stored = laid.withColumn("file", F.input_file_name()).collect()
    homes = {}
    for r in stored:
        homes.setdefault(r.device_id, set()).add(r.file)
    assert all(len(files) == 1 for files in homes.values()) and 1 < len({r.file for r in stored}) <= 4
    for file in {r.file for r in stored}:
        part = [tuple(r) for r in spark.read.parquet(file).select(*schema.AGG_EVENTS_KEY).collect()]
        assert part == sorted(part)

