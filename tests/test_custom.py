import random
import statistics

import pytest

from helpers import rows
from tidemark.operators import custom

VARIANCE = custom.Aggregator(
    ("x", "y"), "n bigint, spread double, text string",
    start=lambda: (0, 0.0, 0.0),
    add=lambda v, r: (v[0] + len(r), v[1] + float(r["x"].sum()), v[2] + float((r["x"] * r["y"]).sum())),
    merge=lambda a, b: tuple(p + q for p, q in zip(a, b)),
    finish=lambda v: (v[0], v[2] / v[0] - (v[1] / v[0]) ** 2, f"of {v[0]}"),
)


def data(n, hot=0):
    rng = random.Random(n)
    return [(f"k{rng.randrange(7)}" if i >= hot else "hot", rng.randrange(3) or None, rng.randrange(-50, 50)) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("held", [2, 100_000])
def test_median_of_each_key(spark, monkeypatch, partitions, held):
    """Also where a third of all rows have one key, and where tasks hold two keys at most."""
    monkeypatch.setattr(custom, "HELD_KEYS", held)
    found = data(600, hot=200)
    df = spark.createDataFrame(found, "a string, b int, x bigint").repartition(partitions)
    want = {}
    for a, b, x in found:
        want.setdefault((a, b), []).append(x)
    got = custom.aggregate_by(df, ["a", "b"], custom.median_of("x"))
    assert got.columns == ["a", "b", "median", "n"]
    assert rows(got) == sorted(
        ((a, b, statistics.median_low(v), len(v)) for (a, b), v in want.items()), key=lambda r: tuple((v is not None, v) for v in r)
    )


def test_an_aggregator_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 5.0, 5.0)], "k string, x double, y double").repartition(3)
    assert rows(custom.aggregate_by(df, ["k"], VARIANCE)) == [("a", 2, 1.0, "of 2"), ("b", 1, 0.0, "of 1")]


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x bigint")
    assert custom.aggregate_by(df, ["k"], custom.median_of("x")).count() == 0


def test_rows_leave_a_task_as_one_value_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(1000)], "k string, x bigint").repartition(4)
    plan = custom.aggregate_by(df, ["k"], custom.median_of("x"))._jdf.queryExecution().toString()
    assert plan.count("FlatMapGroupsInArrow") >= 2 and "MapInArrow" in plan.replace("FlatMapGroupsInArrow", "")


def test_rows_of_a_rare_key_are_taken_in_at_once(spark):
    """Whatever number of tasks they come from; a key is frequent by the rows that a task looks at together."""
    calls = custom.Aggregator(("x",), "calls bigint, n bigint", lambda: (0, 0), lambda v, r: (v[0] + 1, v[1] + len(r)),
                              lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda v: v)
    df = spark.createDataFrame([(f"k{i % 50}", i) for i in range(200)] + [("often", i) for i in range(100)], "k string, x bigint").repartition(4)
    got = {r.k: (r.calls, r.n) for r in custom.aggregate_by(df, ["k"], calls).collect()}
    assert got.pop("often") == (4, 100) and set(got.values()) == {(1, 4)} and len(got) == 50
