"""Pages as a results service lands them, good and bad."""

import json

import pytest
from pyspark.sql import functions as F

from gridlake.sources import pages


def page(table, body, wrapped=True, **paging):
    content = {"limit": "30", "offset": "0", "total": "1", **paging, table: body}
    return json.dumps({"MRData": content} if wrapped else content)


def frame(spark, *payloads):
    return spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(payloads)], "endpoint string, payload string")


def result(**changes):
    row = {
        "number": "1", "position": "1", "positionText": "1", "points": "30", "grid": "1", "laps": "40",
        "status": "Finished", "Driver": {"driverId": "ann"}, "Constructor": {"constructorId": "red"},
        "Time": {"millis": "4000100", "time": "1:06:40.100"},
        "FastestLap": {"rank": "1", "lap": "21", "Time": {"time": "1:37.250"}},
    }
    return {k: v for k, v in {**row, **changes}.items() if v is not None}


def race(**lists):
    return {"season": "2030", "round": "1", **lists}


def test_results(spark):
    body = {"Races": [race(Results=[result(), result(position=None, Time=None, FastestLap=None, points=None, laps=None)])]}
    for wrapped in (True, False):
        rows = pages.accepted(pages.parse_race_results(frame(spark, page("RaceTable", body, wrapped)))).collect()
        full, bare = sorted(rows, key=lambda r: r.source_position is None)
        assert (full.season_year, full.driver_id, float(full.points), full.fastest_lap_time_millis) == (2030, "ann", 30.0, 97250)
        assert (bare.source_position, bare.time_millis, float(bare.points), bare.laps_completed) == (None, None, 0.0, 0)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"status": " "}, "status is missing"),
        ({"grid": "x"}, "grid is not a valid int"),
        ({"points": "many"}, "points is not a valid"),
        ({"Driver": {}}, "driverId is missing"),
        ({"FastestLap": {"Time": {"time": "1:99.0"}}}, "fastest lap is not a valid time"),
    ],
)
def test_bad_records_are_set_aside(spark, change, reason):
    parsed = pages.parse_race_results(frame(spark, page("RaceTable", {"Races": [race(Results=[result(**change), result()])]})))
    assert pages.accepted(parsed).count() == 1
    assert pages.rejected(parsed).first().reject_reason.startswith(reason)
    with pytest.raises(Exception, match=reason):
        pages.strict(parsed).collect()


def test_structure(spark):
    payloads = ["{oops", page("CircuitTable", {}), page("RaceTable", {"Races": [race()]}),
                page("RaceTable", {"Races": [race(Results=[])]}), page("RaceTable", {})]
    rows = pages.parse_race_results(frame(spark, *payloads)).collect()
    assert {r.endpoint: r.reject_reason for r in rows} == {
        "p0": "page is not a JSON object", "p1": "page has no RaceTable", "p2": "race has no Results",
    }


def test_other_entities(spark):
    stop = {"driverId": "ann", "stop": "1", "lap": "9", "time": "15:00:00", "duration": "23.405"}
    stops = pages.parse_pit_stops(frame(spark, page("RaceTable", {"Races": [race(PitStops=[stop, {**stop, "stop": "0"}])]})))
    assert pages.accepted(stops).first().duration_millis == 23405
    assert pages.rejected(stops).first().reject_reason == "stop is below 1"
    laps = [{"number": "1", "Timings": [{"driverId": "ann", "position": "1", "time": "1:40.205"}]}, {"number": "2"},
            {"number": "3", "Timings": [{"driverId": "bob", "position": "2"}]}]
    rows = pages.accepted(pages.parse_lap_times(frame(spark, page("RaceTable", {"Races": [race(Laps=laps)]})))).collect()
    assert {(r.driver_id, r.lap_number, r.time, r.time_millis) for r in rows} == {("ann", 1, "1:40.205", 100205), ("bob", 3, "", None)}
    circuit = {"circuitId": "ring", "circuitName": "The Ring", "Location": {"lat": "12.25", "long": "34.75"}}
    row = pages.accepted(pages.parse_circuits(frame(spark, page("CircuitTable", {"Circuits": [circuit]})))).first()
    assert (str(row.latitude), row.country) == ("12.250000", None)
    calendar = [{**race(), "raceName": "A", "Circuit": {"circuitId": "ring"}, "date": "2030-05-04", "time": t} for t in ("15:00:00Z", "15:00", "25:00", None)]
    rows = pages.parse_races(frame(spark, page("RaceTable", {"Races": calendar}))).collect()
    assert [r.race_time for r in rows] == ["15:00:00", "15:00:00", None, None]
    assert [r.reject_reason for r in rows] == [None, None, "time is not a valid time", None]


def test_season_fallback(spark):
    seasons = pages.parse_seasons(frame(spark, page("SeasonTable", {"Seasons": [{"season": "2023"}]})))
    assert sorted(r.season_year for r in pages.with_season(seasons, 2024).collect()) == [2023, 2024]
    assert pages.with_season(seasons, 2023).count() == 1


def test_raw_records(spark):
    body = {"Circuits": [{"circuitId": "a"}, {"circuitId": "b"}]}
    for table in ("CircuitTable", "Elsewhere", None):
        rows = pages.raw_records(frame(spark, page("CircuitTable", body)), "Circuits", table)
        assert {json.loads(r.record)["circuitId"] for r in rows.collect()} == {"a", "b"}


def test_page_series(spark):
    def landed(endpoint, *offsets, total="3"):
        return [(endpoint, page("RaceTable", {}, limit="2", offset=str(o), total=total)) for o in offsets]

    rows = landed("whole", 0, 2) + landed("short", 0) + landed("gap", 0, 4, total="6") + landed("twice", 0, 0, 2)
    audit = pages.page_series_audit(spark.createDataFrame(rows, "endpoint string, payload string"))
    assert {r.endpoint: r.is_complete for r in audit.collect()} == {"whole": True, "short": False, "gap": False, "twice": True}
    # An overlap as long as a gap does not hide it.
    hidden = [("h", page("RaceTable", {}, limit="100", offset=str(o), total="300")) for o in (0, 50, 200)]
    row = pages.page_series_audit(spark.createDataFrame(hidden, "endpoint string, payload string")).first()
    assert (row.gaps, row.is_complete) == (1, False)
    bad = pages.page_metadata(frame(spark, '{"x": 1}', page("RaceTable", {}, limit="ten")))
    assert [r.reject_reason for r in bad.orderBy("endpoint").collect()] == ["missing MRData envelope", "invalid paging numbers"]


def test_known_lists_and_absent_entities(spark, tmp_path):
    rows = pages.entity_records(frame(spark, page("CircuitTable", {"Circuits": [{"circuitId": "a"}]})), "circuits")
    assert json.loads(rows.first().record) == {"circuitId": "a"}
    (tmp_path / "circuits").mkdir()
    (tmp_path / "circuits" / "p.json").write_text(json.dumps(json.loads(page("CircuitTable", {"Circuits": [{"circuitId": "a", "circuitName": "A"}]})), indent=1))
    parsed = pages.parse_landing(spark, str(tmp_path), one_per_line=False)
    assert pages.accepted(parsed["circuits"]).count() == 1
    assert parsed["sprint_results"].count() == 0
