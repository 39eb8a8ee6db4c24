"""Upserts, audited ingestion and the streaming variant."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators import quality, upsert
from gridlake.plans import catalog_evidence
from gridlake.plans.ingest import DependencyError, RaceStore, RejectedError
from gridlake.sources.landing import landed_pages
from gridlake.streaming.ingest import stream_entity
from gridlake.tables import INGEST_ORDER, schema


def batch_of(event):
    return {name: event[name] for name in INGEST_ORDER}


def counts(frame):
    return {r.table: r["rows"] for r in frame.collect()}


def test_actions(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "y"), ("c", 3.0, "z")], "k string, v double, t string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 4, None), ("d", 5, None)], "k string, v int, t string")
    plan = upsert.plan_upsert("any", old, new, ["k"])
    assert {r.k: (r.v, r.action) for r in plan.collect()} == {
        "a": (1.0, "skipped"), "b": (2.0, "updated"), "c": (3.0, "kept"), "d": (5.0, "inserted"),
    }
    row = upsert.ingestion_stats(plan, "any").first()
    assert tuple(row)[1:] == (4, 1, 2, 1)  # the second row of d changes the first


def test_last_row_of_a_batch_wins(spark):
    old = spark.createDataFrame([("a", "first"), ("z", "stays")], "k string, t string")
    rows = [("a", 1, "Retired"), ("a", 3, "Disqualified"), ("a", 2, "Retired"), ("b", 9, "x"), ("b", 8, "y"), ("c", 1, "v")]
    plan = upsert.plan_upsert("any", old, spark.createDataFrame(rows, "k string, n int, t string"), ["k"], "n")
    assert {r.k: (r.t, r.action, r.copies, r.updates) for r in plan.collect()} == {
        "a": ("Disqualified", "updated", 3, 2), "b": ("x", "inserted", 2, 1), "c": ("v", "inserted", 1, 0),
        "z": ("stays", "kept", 0, 0),
    }
    assert tuple(upsert.ingestion_stats(plan, "any").first())[1:] == (6, 2, 3, 1)


def test_rows_without_a_key_meet_no_other_row(spark):
    old = spark.createDataFrame([("a", "1"), (None, "2")], "k string, t string")
    new = spark.createDataFrame([("a", "1"), (None, "2"), (None, "2")], "k string, t string")
    plan = upsert.plan_upsert("any", old, new, ["k"])
    got = sorted((r.k or "", r.t, r.action, r.copies, r.updates) for r in plan.collect())
    assert got == [("", "2", "inserted", 1, 0), ("", "2", "inserted", 1, 0), ("", "2", "kept", 0, 0), ("a", "1", "skipped", 1, 0)]


def _exchanges(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_an_upsert_exchanges_each_side_once(spark, event):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert.plan_upsert("lap_times", event.lap_times.where("lap_number < 3"), event.lap_times)
        assert _exchanges(upsert.ingestion_stats(plan, "lap_times")) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_that_repeats_keys_is_exchanged_once_with_the_stored_rows(spark, event):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = event.lap_times.withColumn("n", F.lit(1)).unionByName(event.lap_times.withColumn("n", F.lit(2)))
        plan = upsert.plan_upsert("lap_times", event.lap_times.where("lap_number < 3"), batch, order="n")
        assert _exchanges(upsert.ingestion_stats(plan, "lap_times")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_that_repeats_keys_is_sorted_once_in_tasks_that_follow_its_rows(spark, event, monkeypatch):
    monkeypatch.setattr(upsert, "ROWS_PER_TASK", 1)
    batch = event.lap_times.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    plan = upsert.plan_upsert("lap_times", event.lap_times, batch, order="n")
    stats = upsert.ingestion_stats(plan, "lap_times")
    assert [tuple(r)[1:] for r in stats.collect()] == [(8, 0, 0, 8)]
    text = stats._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Sort [" in line for line in text.splitlines()) == 1
    # Four stored rows and eight of the batch.
    assert "12), REPARTITION_BY_NUM" in text


def test_a_batch_that_repeats_one_key_settles_all_others(spark):
    stored = [("a", "1", 7), ("b", "1", 7), ("c", "1", 7), ("z", "1", 7), ("z", "2", 7), (None, "1", 7), (None, "2", 7)]
    old = spark.createDataFrame(stored, "k string, t string, more int")
    rows = [("a", 1, "2"), ("a", 2, "1"), ("b", 1, "1"), ("c", 1, "2"), ("d", 1, None), (None, 1, "1"), (None, 1, "1")]
    plan = upsert.plan_upsert("any", old, spark.createDataFrame(rows, "k string, n int, t string"), ["k"], "n")
    got = sorted((r.k or "", r.t or "", r.more or 0, r.action, r.copies, r.updates) for r in plan.collect())
    assert got == [
        ("", "1", 0, "inserted", 1, 0), ("", "1", 0, "inserted", 1, 0), ("", "1", 7, "kept", 0, 0), ("", "2", 7, "kept", 0, 0),
        ("a", "1", 7, "updated", 2, 2), ("b", "1", 7, "skipped", 1, 0), ("c", "2", 7, "updated", 1, 1),
        ("d", "", 0, "inserted", 1, 0), ("z", "1", 7, "kept", 0, 0), ("z", "2", 7, "kept", 0, 0),
    ]


def test_blank_keeps_the_last_text_of_the_batch(spark):
    old = spark.createDataFrame([("a", "1:30", 1)], "k string, time string, v int")
    rows = spark.createDataFrame([("a", 1, "1:31", 1), ("a", 2, "", 1), ("b", 1, "", 2), ("a", 3, None, 1)], "k string, n int, time string, v int")
    plan = upsert.plan_upsert("lap_times", old, rows, ["k"], "n")
    assert {r.k: (r.time, r.updates) for r in plan.collect()} == {"a": ("1:31", 1), "b": ("", 0)}


def test_blank_lap_text_keeps_the_stored_one(event):
    blank = event.lap_times.withColumn("time", F.lit(""))
    plan = upsert.plan_upsert("lap_times", event.lap_times, blank)
    assert {r.action for r in plan.collect()} == {"skipped"}
    assert {r.time for r in plan.where("time_millis IS NULL").collect()} == {"IN PIT"}


def test_second_run_changes_nothing(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    first = {r.entity_type: r for r in store.ingest(batch_of(event), 2030, 1).collect()}
    assert first["race_results"].records_inserted == 6
    before = counts(store.counts())
    second = store.ingest(batch_of(event), 2030, 1).collect()
    assert all(r.records_inserted == r.records_updated == 0 for r in second)
    assert counts(store.counts()) == before
    corrected = event.race_results.withColumn("status", F.when(F.col("driver_id") == "bea", "Lapped").otherwise(F.col("status")))
    third = store.ingest({"race_results": corrected}).first()
    assert (third.records_updated, third.records_skipped) == (1, 5)
    assert store.read("race_results").where("status = 'Lapped'").count() == 1
    log = quality.log_summary(store.log()).collect()
    assert [(r.status, r.runs) for r in log] == [("SUCCESS", 25)]


def test_idempotency_is_checked_on_all_tables(spark, event, monkeypatch):
    """A store that takes laps twice when they are delivered again is found out."""
    delivered = []

    class Store:
        def __init__(self, *_):
            pass

        def ingest(self, batch):
            delivered.append(set(batch))

        def read(self, table):
            again = table == "lap_times" and len(delivered) > 2
            return event[table].unionByName(event[table]) if again else event[table]

        def log(self):
            return spark.createDataFrame([], schema("etl_log"))

    monkeypatch.setattr(catalog_evidence, "RaceStore", Store)
    row = catalog_evidence._idempotent(event).first()
    assert delivered[:3] == [set(INGEST_ORDER)] * 3
    assert row.counts_equal is False and not row.is_idempotent


def test_other_seasons_stay(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    store.ingest(batch_of(event))
    later = {
        "seasons": event.seasons.withColumn("season_year", F.lit(2031).cast("bigint")),
        "races": event.races.withColumn("season_year", F.lit(2031).cast("bigint")),
        "race_results": event.race_results.withColumn("season_year", F.lit(2031).cast("bigint")),
    }
    store.ingest(later)
    by_season = {r.season_year: r["count"] for r in store.read("race_results").groupBy("season_year").count().collect()}
    assert by_season == {2030: 6, 2031: 6}


def test_failure_is_logged_and_nothing_is_written(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    with pytest.raises(DependencyError, match="races '2030/1' not found"):
        store.ingest({"drivers": event.drivers, "race_results": event.race_results})
    assert store.read("drivers").count() == 0
    log = {r.entity_type: r for r in store.log().collect()}
    assert log["race_results"].status == "FAILED" and "2030/1" in log["race_results"].error_message
    assert log["drivers"].status == "ROLLED_BACK"


def test_a_failing_run_leaves_every_table(spark, event, tmp_path):
    """The third entity fails while it is written; the two before it stay as they were."""
    root = tmp_path / "store"
    store = RaceStore(spark, str(root))
    store.ingest(batch_of(event))
    before = {n: sorted(map(str, store.read(n).collect())) for n in INGEST_ORDER}
    changed = event.drivers.withColumn("given_name", F.lit("Z"))
    bad = event.driver_standings.withColumn("wins", F.when(F.col("position") == 1, F.raise_error(F.lit("broken page " * 400)).cast("int")).otherwise(0))
    with pytest.raises(Exception, match="broken page"):
        store.ingest({"drivers": changed, "constructors": event.constructors, "driver_standings": bad})
    assert {n: sorted(map(str, store.read(n).collect())) for n in INGEST_ORDER} == before
    failed = store.log().where("run_id = 2 and status = 'FAILED'").collect()
    assert [r.entity_type for r in failed] == ["driver_standings"]
    assert failed[0].error_message.count("broken page") >= 400
    assert not list((root / "_staging").glob("*"))


def test_a_run_that_dies_after_its_commit_is_finished_by_the_next(spark, event, tmp_path, monkeypatch):
    """The process ends while the second of its tables is published; nothing is lost or half done in the end."""
    store = RaceStore(spark, str(tmp_path / "store"))
    store.ingest(batch_of(event))
    changed = {
        "drivers": event.drivers.withColumn("given_name", F.lit("Z")),
        "race_results": event.race_results.withColumn("status", F.lit("Lapped")),
    }
    delete = RaceStore._delete

    def dying(self, path):
        if path.endswith("_staging/2"):
            raise KeyboardInterrupt
        delete(self, path)

    def half(self, folder, rows, kind):
        if folder == "_published":
            raise KeyboardInterrupt
        append(self, folder, rows, kind)

    append = RaceStore._append
    monkeypatch.setattr(RaceStore, "_append", half)
    monkeypatch.setattr(RaceStore, "_delete", dying)
    with pytest.raises(KeyboardInterrupt):
        store.ingest(changed)
    monkeypatch.undo()
    # As if the results had not been published: an older state of the season lies there.
    event.race_results.write.mode("overwrite").partitionBy("season_year").parquet(f"{store.root}/race_results")
    again = RaceStore(spark, store.root)
    assert again.recover() == [2] and again.recover() == []
    assert again.read("race_results").where("status = 'Lapped'").count() == 6
    assert again.read("drivers").where("given_name = 'Z'").count() == 6
    assert not (tmp_path / "store" / "_staging" / "2").exists()
    assert {r.status for r in again.log().collect()} == {"SUCCESS"}


def test_only_touched_seasons_are_read_and_written(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    many = spark.range(2030, 2036).select(F.col("id").alias("season_year"))
    batch = {n: event[n] for n in ("circuits", "constructors", "drivers")} | {"seasons": many}
    batch |= {n: event[n].drop("season_year").crossJoin(many) for n in ("races", "race_results")}
    store.ingest(batch)
    folder = tmp_path / "store" / "race_results"
    before = {f.name: sorted(x.name for x in f.iterdir()) for f in folder.glob("season_year=*")}
    assert len(before) == 6
    two = event.race_results.drop("season_year").crossJoin(many.where("season_year in (2031, 2033)")).withColumn("status", F.lit("Lapped"))
    touched = store.touched("race_results", two)
    assert {r.season_year for r in touched.select("season_year").collect()} == {2031, 2033}
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
    store.ingest({"race_results": two})
    after = {f.name: sorted(x.name for x in f.iterdir()) for f in folder.glob("season_year=*")}
    assert {k for k in before if before[k] != after[k]} == {"season_year=2031", "season_year=2033"}
    assert store.read("race_results").count() == 36 and store.read("race_results").where("status = 'Lapped'").count() == 12


def test_a_replayed_delivery_replaces_its_rejects(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    for delivery in ("one", "one", "two"):
        store.ingest({"race_results": event.race_results}, orphans="reject", delivery=delivery)
    assert store.read("rejects").count() == 12
    assert {r.run_id for r in store.read("rejects").select("run_id").distinct().collect()} == {2, 3}


def test_rejects_are_kept_with_their_reason(spark, event, tmp_path):
    landing = tmp_path / "landing"
    land(event, str(landing), ["drivers"])
    page = '{"MRData": {"limit": "30", "offset": "0", "total": "2", "DriverTable": {"Drivers": [%s]}}}'
    good, bad = '{"driverId": "new", "givenName": "N", "familyName": "N"}', '{"driverId": "half", "familyName": "H"}'
    (landing / "drivers" / "more.txt").write_text(page % f"{good}, {bad}" + "\n{broken\n")
    store = RaceStore(spark, str(tmp_path / "store"))
    with pytest.raises(RejectedError, match="2 rows rejected"):
        store.ingest_landing(str(landing), strict=True)
    assert store.read("drivers").count() == store.read("rejects").count() == 0
    stats = {r.entity_type: r for r in store.ingest_landing(str(landing)).collect()}["drivers"]
    assert (stats.records_processed, stats.records_inserted, stats.records_rejected) == (7, 7, 2)
    rejects = store.read("rejects").collect()
    assert sorted(r.reason for r in rejects) == ["givenName is missing or empty", "page is not a JSON object"]
    assert all("more.txt" in r.endpoint for r in rejects)
    assert any('"driver_id":"half"' in r.record for r in rejects)
    assert {r.entity_type: r.records_rejected for r in store.log().where("status = 'SUCCESS'").collect()}["drivers"] == 2


def test_a_hot_season_is_written_by_several_tasks(spark, event, tmp_path):
    store = RaceStore(spark, str(tmp_path / "store"))
    store.ingest(batch_of(event))
    laps = spark.range(400_000).selectExpr("2030L season_year", "1 round", "'max' driver_id", "id + 100 lap_number", "1 position", "cast(rand(1) as string) time", "cast(id as int) time_millis")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        driver = event.drivers.limit(1).withColumn("driver_id", F.lit("max"))
        store.ingest({"drivers": driver, "lap_times": laps})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "store" / "lap_times" / "season_year=2030").glob("*.parquet"))
    assert len(files) > 1
    assert store.read("lap_times").count() == 400_000 + event.lap_times.count()
    store.vacuum()
    assert not (tmp_path / "store" / "_staging").exists()
    assert store.read("lap_times").count() == 400_000 + event.lap_times.count()


def land(event, root, names=INGEST_ORDER):
    for name in names:
        if event[name].count():
            landed_pages(event, name).select("payload").write.mode("append").text(f"{root}/{name}")


def test_landing_round_trip(spark, event, tmp_path):
    # No sprint was held, so there is no folder of sprint pages.
    landing = str(tmp_path / "landing")
    land(event, landing)
    store = RaceStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.ingest_landing(landing, 2030, 5, 1)
    store.ingest_landing(landing, 2030, 1, 1)
    for name in ("race_results", "pit_stops", "driver_standings"):
        stored = store.read(name).drop("q1_time", "duration_text")
        assert stored.count() == event[name].count(), name
    assert store.read("race_results").where("driver_id = 'bea'").first().time_millis == 4011350


def test_stream(spark, event, tmp_path):
    landing = str(tmp_path / "landing")
    store = RaceStore(spark, str(tmp_path / "store"))
    land(event, landing, ["drivers"])
    for _ in range(2):
        stream_entity(spark, landing, "drivers", store).awaitTermination()
    assert store.read("drivers").count() == 6
    assert store.log().count() == 1  # the second run found no new page
    renamed = type(event).of({"drivers": event.drivers.withColumn("given_name", F.lit("Z"))})
    land(renamed, landing, ["drivers"])
    stream_entity(spark, landing, "drivers", store).awaitTermination()
    assert store.read("drivers").where("given_name = 'Z'").count() == 6


def test_stream_keeps_what_it_cannot_store(spark, event, tmp_path):
    """A fact page before its parents is set aside, and two landing folders have their own progress."""
    store = RaceStore(spark, str(tmp_path / "store"))
    for name in ("one", "two"):
        land(event, str(tmp_path / name), ["race_results"])
    stream_entity(spark, str(tmp_path / "one"), "race_results", store).awaitTermination()
    assert store.read("race_results").count() == 0
    assert [r.reason for r in store.read("rejects").collect()] == ["parent not found"] * 6
    store.ingest({n: event[n] for n in ("seasons", "circuits", "constructors", "drivers", "races")})
    stream_entity(spark, str(tmp_path / "two"), "race_results", store).awaitTermination()
    assert store.read("race_results").count() == 6
