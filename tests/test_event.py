"""Known answers of a small race."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators import attrition, conversion, event as ev, evidence, insights, quality, season, statistics
from gridlake.operators.common import present


def by(frame, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in frame.collect()}


def test_position_changes(event):
    assert by(ev.grid_vs_finish(event), "driver_id", "position_change") == {
        "ada": 0, "bea": 4, "dov": 1, "cem": -2, "fay": None, "eli": None,
    }


def test_overview(event):
    row = ev.race_overview(event, 2030, 1).first()
    assert (row.winner_given_name, row.winner_time_millis, row.classified_count, row.total_result_count) == (
        "ADA", 4000100, 5, 6,
    )
    assert ev.race_overview(event, 2029).count() == 0


def test_results_are_shown_classified_first(event):
    rows = present(ev.race_results(event, 2030, 1), "race_results").collect()
    assert [r.driver_id for r in rows] == ["ada", "bea", "dov", "cem", "eli", "fay"]
    assert [r.driver_id for r in ev.race_results(event, constructor_id="south", driver_id="dov").collect()] == ["dov"]


def test_teammate_qualifying_uses_the_deepest_session(event):
    assert by(ev.teammate_qualifying(event), "constructor_id", "delta_millis") == {"north": -580, "south": -140}


def test_pit_stops(event):
    got = by(ev.driver_pit_stops(event), "driver_id", "stop_count", "avg_duration_millis", "fastest_stop_millis")
    assert got == {
        "ada": (2, 23250, 23100), "bea": (2, 24400, 24000), "cem": (1, 26000, 26000), "dov": (1, None, None),
    }
    assert by(ev.constructor_pit_stops(event), "constructor_id", "total_stops", "avg_duration_millis") == {
        "north": (4, 23825), "south": (2, 26000),
    }


def test_laps(event):
    got = by(ev.driver_lap_times(event), "driver_id", "lap_count", "fastest_lap_millis", "avg_lap_millis")
    assert got == {"ada": (2, 97000, 98250), "cem": (2, 100200, 100200)}


def test_summary_counts_stops_once(event):
    row = ev.driver_race_summary(event, 2030, 1, "ada").first()
    assert (row.pit_stop_count, row.position_change, float(row.points)) == (2, 0, 30.0)


def test_teammate_events(event):
    got = by(
        ev.event_teammates(event), "constructor_id", "driver_a_id", "ahead_in_race", "is_comparable_finish", "is_comparable_qualifying"
    )
    assert got["north"] == ("ada", "ada", True, True)
    assert got["east"] == ("eli", None, False, False)


def test_season_figures(event):
    row = season.driver_seasons(event, driver_id="eli").first()
    assert (row.races_started, row.average_grid, row.best_finish, row.championship_standing) == (1, None, 10, None)
    shares = by(season.driver_contributions(event), "driver_id", "points_share_pct")
    assert shares["ada"] == round(30 / 50 * 100, 2) and shares["eli"] == 100.0
    team = season.constructor_seasons(event, constructor_id="south").first()
    assert [d.driver_id for d in team.driver_contributions] == ["dov", "cem"]
    assert (team.podiums, team.wins, team.championship_standing) == (1, 0, 2)


def test_parts_add_up(event):
    teams = by(season.constructor_seasons(event), "constructor_id", "total_points")
    parts = {}
    for r in season.driver_contributions(event).collect():
        parts[r.constructor_id] = parts.get(r.constructor_id, 0) + r.total_points
    assert parts == teams
    for r in season.season_teammates(event).collect():
        assert r.race_head_to_head_a + r.race_head_to_head_b <= r.race_comparable_rounds


def test_conversion(event):
    row = conversion.driver_conversion(event, driver_id="ada").first()
    assert (row.pole_to_win.total_poles, row.pole_to_win.pole_to_win_rate, row.grid_tiers["front"].eligible_starts) == (1, 100.0, 1)
    assert conversion.driver_conversion(event, driver_id="eli").first().pit_lane_starts_count == 1


def test_attrition_incomplete_period(event):
    rows = {r.period_name: r for r in attrition.attrition_report(event).collect()}
    assert set(rows) == {"Early", "Middle", "Late", "R01"}
    assert rows["R01"].is_complete and rows["R01"].total.entries == 6 and rows["R01"].total.dnf_results == 1
    assert not rows["Early"].is_complete and rows["Early"].total.entries is None and rows["Early"].drivers == {}


def test_single_values_have_no_spread(event):
    rows = by(statistics.pit_stop_stats(event.pit_stops), "driver_id", "stats")
    assert rows["cem"].mean == 26000 and rows["cem"].stddev is None and rows["cem"].q1 is None
    assert rows["dov"].sample_size == 0 and rows["dov"].mean is None


def test_race_insights(event):
    rows = insights.race_insights(event, 2030, 1).collect()
    ids = {r.insight_id for r in rows}
    assert "QUALIFYING_TEAMMATE_ADVANTAGE:2030:1:ada:bea" in ids
    assert "POSITION_GAIN:2030:1:bea:none" in ids and "POSITION_MAINTAINED:2030:1:ada:none" in ids
    # Only one car of the third team qualified, so its teammate rules stay silent.
    assert not [i for i in ids if "eli" in i]
    assert len(ids) == len(rows)
    cem = insights.for_entities(insights.race_insights(event), driver_id="cem").collect()
    assert all("cem" in (r.subject_id, r.comparison_subject_id) for r in cem) and cem
    trail = next(r for r in rows if r.rule_id == "QUALIFYING_TEAMMATE_ADVANTAGE" and r.subject_id == "cem").traceability
    assert (trail.observed_value, trail.constructor_id, trail.minimum_sample_size) == (-140.0, "south", 1)


def test_insights_repeat_exactly(event):
    first = sorted(map(str, insights.race_insights(event).collect()))
    assert first == sorted(map(str, insights.race_insights(event).collect()))


def test_fast_stop_is_reported_once(event):
    rows = insights.fast_pit_stop_insights(event.pit_stops).collect()
    assert by(insights.fast_pit_stop_insights(event.pit_stops), "subject_id", "magnitude") == {
        "ada": 23400.0, "bea": 24800.0,
    }
    assert len(rows) == 2


def test_scopes(event):
    with pytest.raises(ValueError):
        insights.scope_insights(event, "weekly")
    race = insights.scope_insights(event, "race", 2030, 1).count()
    both = insights.scope_insights(event, "mixed", 2030, 1).count()
    assert both == race + insights.scope_insights(event, "longitudinal", 2030).count()
    pair = insights.longitudinal_insights(event, 2030, drivers=("bea", "ada"))
    assert pair.count() == 0  # one round together is no evidence


def test_unknown_rule():
    from gridlake.operators.rules import get_rule

    with pytest.raises(KeyError):
        get_rule("NO_SUCH_RULE")
    assert get_rule("LONGITUDINAL_CONSTRUCTOR_TRAJECTORY").metric == "podium_rate"


def test_race_evidence(event):
    rows = insights.race_insights(event).withColumn("season_year", F.col("traceability.season_year"))
    package = evidence.evidence_packages(rows, ["season_year"]).first()
    import json

    payload = json.loads(package.payload)
    assert len(payload["insights"]) == 10 == package.insights
    first = payload["insights"][0]
    assert first["scope"] == "race" and "valid_observations" not in first and "explanation" not in first
    assert first["traceability"]["threshold"] == {} and "round_num" in first["traceability"]
    assert len(payload["limitations"]) == 3  # two fixed ones and the single-observation note


def test_quality(event):
    assert quality.duplicate_keys(event).count() == 0
    assert quality.orphan_keys(event).count() == 0
    doubled = type(event).of({**{n: event[n] for n in ("races", "race_results", "qualifying_results", "sprint_results",
        "driver_standings", "constructor_standings", "pit_stops", "lap_times")},
        "race_results": event.race_results.unionByName(event.race_results)})
    assert quality.duplicate_keys(doubled).count() == 6
