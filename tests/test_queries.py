"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from gridlake.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.checks())
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    problem, _, _ = compare(spark, duck, ROOT, name, catalog.queries()[name], catalog.checks()[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_season_groupings_need_no_shuffle(spark):
    """The entries are bucketed by season, so window and grouping run inside the buckets."""
    from gridlake.operators import season
    from gridlake.sources.star import race_tables

    frame = season.driver_season_totals(season.driver_rounds(race_tables(spark, ROOT)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "PushedFilters" in plan


@pytest.mark.parametrize("name", ["form_summary", "mixed_insights", "season_insights"])
def test_joins_of_entries_need_no_shuffle_in_any_session(spark, name):
    """Joins by season, round and driver run inside the buckets, also where the session was not set up for them."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    kept = {key: spark.conf.get(key) for key in (setting, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set(setting, "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog.queries()[name](spark, ROOT)
        assert "Exchange hashpartitioning(season_year" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
