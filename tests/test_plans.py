"""Properties of the physical plans that matter on a large cluster."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.measures import CENTS
from tidemark.operators import aggregate, dedup, feed as feeds, lateness, reconcile
from tidemark.plans.queries import REGISTRY
from tidemark.session import session_conf, staged

SF = "/root/testdata/sf0.001"
STORED = ("stream_", "scenario_", "wordcount_stream", "dedup_within", "raw_", "scan_", "table_")
BATCH = [n for n in REGISTRY if not n.startswith(STORED)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def feed(spark):
    return feeds.build_feed(spark.read.parquet(f"{SF}/events.parquet"))


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    """An aggregator of the caller's own is Python, by Arrow batches; nothing else is."""
    plan = plan_of(REGISTRY[name](spark, SF))
    for word in ("Cartesian", "NestedLoop", "Python", "Pandas", *["Arrow"] * (name != "agg_own")):
        assert word not in plan


def test_watermarks_read_one_column(feed):
    plan = plan_of(lateness.batch_watermarks(feed))
    assert set(p.split(">")[0] for p in plan.split("ReadSchema: struct<")[1:]) == {"event_id:bigint"}


def test_truth_reads_no_repeats_and_shuffles_once(feed):
    plan = plan_of(reconcile.truth(feed, "ingest_devicetime", CENTS))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("partial_sum") == 2


def test_unpartitioned_window_only_over_block_maxima(feed):
    """The single-partition step comes after two aggregations."""
    lines = plan_of(lateness.batch_watermarks(feed)).splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate(keys=[block" in lines[single[0] + 1]


def test_staged_watermarks_spare_the_feed_a_shuffle(feed):
    watermarks = staged(lateness.batch_watermarks(feed))
    plan = plan_of(lateness.late_rows(staged(feed), watermarks=watermarks))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_large_watermark_side_is_not_broadcast(spark, feed):
    watermarks = staged(lateness.batch_watermarks(feed))
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="16"):
        plan = plan_of(lateness.late_rows(staged(feed), watermarks=watermarks))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_sums_after_dedup_are_partial_and_carry_few_columns(feed):
    plan = plan_of(aggregate.arrival_time_sums(feed, CENTS))
    assert "partial_min" in plan and "partial_sum" in plan and "patterncode" not in plan.split("partial_min")[1][:400]
    assert plan.count("Exchange hashpartitioning") - plan.count("SortMergeJoin") * 2 == 2


def shuffled_rows(df) -> list[int]:
    """Rows written by each exchange of a collected frame, outermost first."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop(0)
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_hot_keys_leave_each_task_once(spark, feed):
    """A third of 1050 rows are one message: each of 6 tasks sends it once."""
    third = F.col("s") % 3 == 0
    hot = staged(feed.withColumns({
        "message_id": F.when(third, "m").otherwise(F.col("message_id")),
        "device_ms": F.when(third, 0).otherwise(F.col("device_ms")),
    }))
    others = hot.filter("message_id <> 'm'").count()
    with session_conf(spark, spark__sql__adaptive__enabled="false"):
        spread = hot.repartition(6)
        df = dedup.first_per_window(spread, F.timestamp_millis("device_ms"))
        assert sum(r.message_id == "m" for r in df.collect()) == 1
        after, before = shuffled_rows(df)
    assert before == hot.count() and after <= others + 6 < before


def test_event_time_sums_read_the_feed_once(spark):
    """The watermark comes from the staged sums, so no plan reads the events for it."""
    plan = plan_of(REGISTRY["agg_event_time"](spark, SF))
    assert "events.parquet" not in plan and plan.count("FileScan parquet") <= 3
    plan = plan_of(REGISTRY["reconcile"](spark, SF))
    assert plan.count("events.parquet") == 1 and plan.count("FileScan parquet") <= 4


def test_key_filter_reaches_the_stored_table(spark):
    plan = plan_of(REGISTRY["filter_sort_limit"](spark, SF))
    assert re.search(r"FileScan parquet [^\n]*DataFilters: \[[^\n]*category#\d+ = view", plan)


@pytest.mark.parametrize("slide", [1000, 5000 // 50])
def test_sliding_windows_shuffle_no_more_rows_than_the_feed(spark, feed, slide):
    with session_conf(spark, spark__sql__adaptive__enabled="false"):
        df = aggregate.sliding_sums(feed, slide_ms=slide, measure=CENTS)
        df.collect()
        steps = shuffled_rows(df)
    n = feed.count()
    assert len(steps) == 4 and max(steps[2:]) <= n and max(steps[:2]) <= 2 * n


def test_a_read_by_key_opens_one_bucket_and_exchanges_nothing(spark):
    plan = plan_of(REGISTRY["key_lookup"](spark, SF))
    assert "SelectedBucketsCount: 1 out of 16" in plan and "Exchange" not in plan

