"""As-of and interval joins against plain loops, and documents of races."""

import json
import os
import random

import pytest

from gridlake.operators import attrition, event as events, temporal
from gridlake.sources import pages

ROWS = "k string, at int, v string"


def as_of(left, right):
    """For each left row the largest right row at the last time not after its own."""
    found = []
    for k, at, v in left:
        before = [r for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] <= at]
        last = max((r[1] for r in before), default=None)
        found.append((k, at, v, last, max((r[2] for r in before if r[1] == last), default=None)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_as_of_with_gaps_ties_repeats_and_a_hot_key(spark, ranges):
    rng = random.Random(ranges)
    left = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(-9, 40)]), f"l{k % 7}") for k in range(400)]
    right = [(rng.choice(["hot", "a", "c", None]), rng.choice([None, -5, 3, 4, 17, 30]), f"r{k}") for k in range(40)]
    got = temporal.as_of_join(
        spark.createDataFrame(left, ROWS).repartition(3), spark.createDataFrame(right, ROWS), ["k"], "at", ["v"], "last_", ranges
    )
    assert got.columns == ["k", "at", "v", "last_at", "last_v"]
    assert sorted(map(tuple, got.collect()), key=repr) == as_of(left, right)


def test_as_of_over_its_own_table_and_empty_sides(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], ROWS)
    same = temporal.as_of_join(rows, rows.where("at = 1"), ["k"], "at", ["v"], "p_")
    assert sorted(tuple(r) for r in same.collect()) == [("a", 1, "x", 1, "x"), ("a", 5, "y", 1, "x")]
    assert [r.p_v for r in temporal.as_of_join(rows, rows.limit(0), ["k"], "at", ["v"], "p_").collect()] == [None, None]
    assert temporal.as_of_join(rows.limit(0), rows, ["k"], "at", ["v"], "p_").count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_running_maximum_across_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "a", None]), k, rng.choice([None, *range(500)])) for k in rng.sample(range(-100, 400), 200)]
    frame = spark.createDataFrame(rows, "k string, at int, n int").repartition(3)
    got = temporal.max_before(frame, ["k"], ["at"], temporal.F.col("n"), "most", ranges)
    want = [(k, at, n, max((r[2] for r in rows if r[0] == k and r[1] < at and r[2] is not None), default=None)) for k, at, n in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_long_page_series_is_audited_in_many_groups(spark):
    page = '{"MRData": {"limit": "10", "offset": "%d", "total": "20000", "T": {}}}'
    whole = [("long", page % k) for k in range(0, 20000, 10)]
    short = [("gap", page % k) for k in range(0, 20000, 10) if k != 7770]
    frame = spark.createDataFrame(whole + short, "endpoint string, payload string")
    audit = {r.endpoint: r for r in pages.page_series_audit(frame).collect()}
    assert audit["long"].is_complete and audit["long"].gaps == 0 and audit["long"].covered == 20000
    assert not audit["gap"].is_complete and audit["gap"].gaps == 1


def test_intervals_of_all_lengths(spark):
    rng = random.Random(4)
    points = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice([None, *range(-40, 300)]), f"p{k % 50}") for k in range(300)]
    spans = []
    for k in range(60):
        start = rng.randrange(-60, 300)
        spans.append((rng.choice(["hot", "a", "b", None]), start, start + rng.choice([-3, 0, 0, 1, 2, 7, 8, 100, 10**12]), f"s{k}"))
    spans += [spans[0], ("hot", None, 5, "x"), ("hot", 5, None, "x")]
    want = [
        (k, at, v, s, e, n)
        for k, at, v in points
        for key, s, e, n in spans
        if None not in (k, at, s, e) and key == k and s <= at <= e
    ]
    left = spark.createDataFrame(points, ROWS).repartition(3)
    right = spark.createDataFrame(spans, "k string, s long, e long, name string")
    got = temporal.interval_join(left, right, ["k"], "at", "s", "e")
    assert got.columns == ["k", "at", "v", "s", "e", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert temporal.interval_join(left, right.limit(0), ["k"], "at", "s", "e").count() == 0
    assert temporal.interval_join(left.limit(0), right, ["k"], "at", "s", "e").count() == 0


def test_intervals_meet_without_a_nested_loop(spark):
    points = spark.range(1000).selectExpr("id % 3 AS k", "id AS at")
    spans = spark.range(50).selectExpr("id % 3 AS k", "id AS s", "id * id AS e")
    plan = temporal.interval_join(points, spans, ["k"], "at", "s", "e")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_attrition_of_overlapping_periods(spark, event):
    rows = [(2030, "all", 1, 9), (2030, "one", 1, 1), (2030, "later", 2, 9), (2030, "open", 1, None), (2031, "other", 1, 9)]
    periods = spark.createDataFrame(rows, "season_year long, name string, start_round int, end_round int")
    got = {r.name: r for r in attrition.attrition_over(event, periods).collect()}
    assert set(got) == {r[1] for r in rows}
    assert got["all"].entries == got["one"].entries == 6
    assert got["one"].dnf_results == 1 and got["one"].classified_finishes == 5
    assert [got[n].entries for n in ("later", "open", "other")] == [0, 0, 0]


def test_document_holds_every_part_in_order(event):
    document = events.race_documents(event, 2030, 1).collect()
    assert len(document) == 1
    row = document[0]
    assert row.overview.race_name == "First Grand Prix" and row.overview.total_result_count == 6
    assert [r.driver_id for r in row.results] == ["ada", "bea", "dov", "cem", "eli", "fay"]
    assert [r.driver_id for r in row.qualifying] == ["ada", "cem", "dov", "bea", "fay"]
    assert [(r.driver_id, r.stop_count) for r in row.pit_stops] == [("ada", 2), ("bea", 2), ("cem", 1), ("dov", 1)]
    for part, view in events.race_bundle(event, 2030, 1).items():
        if part != "overview":
            part = {"qualifying_order": "qualifying", "driver_pit_stops": "pit_stops", "driver_lap_times": "lap_times"}.get(part, part)
            assert len(row[part]) == view.count(), part


def test_written_documents_are_json_lines(event, tmp_path):
    path = str(tmp_path / "documents")
    events.write_race_documents(event, path)
    folder = f"{path}/season=2030"
    lines = [x for name in os.listdir(folder) if name.endswith(".json") for x in open(f"{folder}/{name}")]
    (document,) = [json.loads(x) for x in lines]
    assert document["season_year"] == 2030 and document["results"][0]["driver_id"] == "ada"
    assert document["results"][5]["source_position"] is None


def test_one_shuffle_nests_all_parts(event):
    """The parts meet in a single aggregation by race."""
    plan = events.race_documents(event)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 9 and plan.count("Union") == 1
