"""Work per task and rows moved follow the input, whatever the session's number of partitions."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from gridlake.operators import common
from gridlake.plans import ingest
from gridlake.plans.store import bucket_count, drop_stored, stored
from gridlake.session import frees_shuffles
from gridlake.sources import star
from gridlake.tables import RaceTables


@pytest.fixture
def source(spark, tmp_path):
    """Two drivers, one of many line items, some of them delivered twice, and one item without a driver."""
    root = str(tmp_path / "source")
    days = [datetime.date(1995, 1 + n % 3, 1 + 7 * (n % 4)) for n in range(40)]
    spark.createDataFrame([(n, d) for n, d in enumerate(days)], "o_orderkey bigint, o_orderdate date").write.parquet(f"{root}/orders.parquet")
    items = [(n % 40, n // 40, n % 7, 3 if n % 9 else 24, 100.0 + n % 5, 1.0 + n % 50, n % 11 / 100, n % 9 / 100) for n in range(600)]
    items += items[:30] + [(5, 1, 1, None, 100.0, 1.0, 0.1, 0.02)]
    names = "orderkey linenumber partkey suppkey".split()
    kinds = [f"l_{n} bigint" for n in names] + [f"l_{n} double" for n in "extendedprice quantity discount tax".split()]
    spark.createDataFrame(items, ", ".join(kinds)).write.parquet(f"{root}/lineitem.parquet")
    yield root
    drop_stored(spark, root)


def _rows(frame):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in frame.collect())


@pytest.mark.parametrize("build", [star.build_laps, lambda spark, root: star.build_entries(spark, root, 4)])
def test_busy_drivers_are_numbered_like_the_others(spark, source, monkeypatch, build):
    usual = _rows(build(spark, source))
    drop_stored(spark, source)
    monkeypatch.setattr(star, "BUSY_ITEMS", 100)
    assert len(usual) > 10
    if build is star.build_laps:
        assert all(row[:3] != ("", "5", "") and row[2] for row in usual)  # no lap without a driver
    assert _rows(build(spark, source)) == usual


def test_line_items_move_once_to_their_order_and_once_to_their_group(spark, source):
    for frame in (star.build_laps(spark, source), star.build_entries(spark, source, 4)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # line items, orders, and what they make
        assert "SortMergeJoin" not in plan


def test_buckets_are_small(spark):
    assert bucket_count(spark, 640 << 20) >= 80


def test_very_many_seasons_share_folders(spark, event, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "SEASON_FOLDERS", 20)
    monkeypatch.setattr(ingest, "SEASON_BLOCKS", 4)
    store = ingest.RaceStore(spark, str(tmp_path / "store"))
    many = spark.range(2030, 2070).select(F.col("id").alias("season_year"))
    batch = {n: event[n] for n in ("circuits", "constructors", "drivers")} | {"seasons": many}
    batch |= {n: event[n].drop("season_year").crossJoin(many) for n in ("races", "race_results")}
    store.ingest(batch)
    folders = sorted(f.name for f in (tmp_path / "store" / "race_results").glob("season*"))
    assert folders == [f"season_block={n}" for n in range(4)]
    one = event.race_results.withColumn("season_year", F.lit(2033).cast("bigint")).withColumn("status", F.lit("Lapped"))
    found = store.ingest({"race_results": one}).first()
    assert (found.records_updated, found.records_inserted) == (6, 0)
    rows = store.read("race_results")
    assert rows.count() == 240 and rows.select("season_year").distinct().count() == 40
    assert {r.season_year for r in rows.where("status = 'Lapped'").select("season_year").collect()} == {2033}
    assert store.ingest(batch).where("entity_type = 'races'").first().records_skipped == 40


def test_names_are_sent_to_the_facts(spark, event, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = event.race_results.join(common.constructor_names(event), "constructor_id")
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(common, "BROADCAST_NAMES", 1)
        fresh = RaceTables(lambda name: event[name])
        rows = event.race_results.join(common.constructor_names(fresh), "constructor_id")
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}


def test_jobs_that_store_tables_leave_no_shuffle_files(spark, source):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept, before, seen = spark.conf.get(setting), _shuffle_files(spark), []
    with frees_shuffles(spark):
        spark.range(100).repartition(3, "id").write.format("noop").mode("overwrite").save()
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    stored(spark, source, "numbers", lambda: seen.append(spark.conf.get(setting)) or spark.range(3))
    assert seen == ["true"] and spark.conf.get(setting) == kept
