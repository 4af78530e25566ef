"""Every registered query against its SQL text, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
QUERIES = REGISTRY
SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = oracle.compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert not result.startswith("FAIL"), result


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_offers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_scenario_tables(spark):
    """The store answers after a run, and a run starts from empty tables."""
    from tidemark.functions.measures import CENTS
    from tidemark.operators import feed as feeds
    from tidemark.plans import scenarios
    from tidemark.session import work_dir
    from tidemark.sources.tables import KeyedTables

    feed = feeds.build_feed(spark.read.parquet(f"{SF}/events.parquet"))
    tables = KeyedTables(spark, work_dir(spark, "scenario"))
    first = scenarios.run_scenario(tables, feed, "microbatch", CENTS).count()
    assert scenarios.first_debug_rows(tables).count() == 0
    second = scenarios.run_scenario(tables, feed, "event", CENTS).count()
    assert first == second == 209
    assert scenarios.first_debug_rows(tables).count() == 5
    with pytest.raises(ValueError):
        scenarios.run_scenario(tables, feed, "lunar", CENTS)
    tables.reset()
    assert {r.n for r in tables.counts().collect()} == {0}
