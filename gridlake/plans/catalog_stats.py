"""Registered queries: statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators import conversion, event, season, statistics
from gridlake.plans.catalog_event import over_star
from gridlake.plans.views import joined, rounded, stats_columns
from gridlake.tables import RaceTables

_QUALITY = "quality.*"


def _timed(rows: DataFrame, keys: list[str], prefix: str, fastest: str) -> DataFrame:
    return rows.select(*keys, *stats_columns("stats", prefix), _QUALITY, fastest)


def _lap_stats(t: RaceTables) -> DataFrame:
    keys = ["season_year", "round", "driver_id"]
    return _timed(statistics.lap_time_stats(t.lap_times, keys), keys, "lap", "fastest_recorded_millis")


def _pit_stats(t: RaceTables) -> DataFrame:
    keys = ["season_year", "round", "driver_id"]
    return _timed(statistics.pit_stop_stats(t.pit_stops, keys), keys, "stop", "fastest_duration_millis")


def _season_lap_stats(t: RaceTables) -> DataFrame:
    keys = ["season_year", "driver_id"]
    return _timed(statistics.lap_time_stats(t.lap_times, keys), keys, "lap", "fastest_recorded_millis")


_TEAM_PAIR = ["season_year", "constructor_id", "driver_a_id", "driver_b_id"]


def _qualifying_delta_stats(t: RaceTables) -> DataFrame:
    rows = statistics.qualifying_delta_stats(event.teammate_qualifying(t))
    return rows.select(*_TEAM_PAIR, *stats_columns("stats", "delta"), _QUALITY)


ONE_TEAM = "team_000000000000"


def _one_team_qualifying(t: RaceTables) -> DataFrame:
    rows = statistics.qualifying_delta_stats(event.teammate_qualifying(t), ONE_TEAM)
    return rows.select(*_TEAM_PAIR, *stats_columns("stats", "delta"), _QUALITY)


def _h2h_stats(t: RaceTables, constructor_id: str | None = None) -> DataFrame:
    rows = statistics.teammate_delta_stats(event.teammate_deltas(t), constructor_id)
    columns = [
        c for name in ("qualifying", "grid", "finish", "points") for c in stats_columns(f"{name}_delta", name)
    ]
    return rows.select(*_TEAM_PAIR, *columns, _QUALITY)


def _position_change_stats(t: RaceTables) -> DataFrame:
    changes = t.race_results.withColumn("position_change", F.col("grid_position") - F.col("source_position"))
    return statistics.position_change_stats(changes).select(
        "season_year",
        "driver_id",
        *stats_columns("stats", "change"),
        _QUALITY,
        "distribution.positive_count",
        "distribution.negative_count",
        "distribution.zero_count",
        rounded(F.col("distribution.positive_rate")).alias("positive_rate"),
    )


def _points_stats(t: RaceTables) -> DataFrame:
    rows = statistics.driver_points_stats(season.driver_rounds(t))
    return rows.select(
        *[c for c in rows.columns if c not in ("race_points_stats", "total_points_stats", "evidence")],
        *stats_columns("race_points_stats", "race_points"),
        *stats_columns("total_points_stats", "total_points"),
        F.col("evidence.evidence_strength").alias("evidence_strength"),
        joined(F.col("evidence.rounds_included")).alias("rounds"),
    )


def _driver_profile(t: RaceTables) -> DataFrame:
    return statistics.driver_profiles(season.driver_rounds(t)).select(
        "season_year",
        "driver_id",
        "up_to_round",
        *stats_columns("finish_position", "finish"),
        *stats_columns("grid_position", "grid"),
        *stats_columns("position_change.stats", "change"),
        "position_change.distribution.positive_count",
        "position_change.distribution.negative_count",
        F.col("finish_position_consistency.range").alias("finish_range"),
        F.col("grid_position_consistency.range").alias("grid_range"),
        F.col("position_change_consistency.range").alias("change_range"),
        F.col("points_consistency.range").alias("points_range"),
        F.col("evidence.evidence_strength").alias("evidence_strength"),
        joined(F.col("evidence.rounds_included")).alias("rounds"),
    )


def _rolling_form(t: RaceTables) -> DataFrame:
    return statistics.rolling_form(season.driver_rounds(t)).select(
        "season_year",
        "driver_id",
        "metric_name",
        "round",
        F.size("rounds_included").alias("window_rounds"),
        F.array_min("rounds_included").alias("first_round"),
        "valid_observations",
        "mean",
        "median",
        "stddev",
        "minimum",
        "maximum",
        F.col("evidence.evidence_strength").alias("evidence_strength"),
    )


def _form_summary(t: RaceTables) -> DataFrame:
    return statistics.driver_form(season.driver_rounds(t)).select(
        "season_year",
        "driver_id",
        "up_to_round",
        F.size("rolling_windows").alias("windows"),
        F.size("race_to_race_deltas").alias("deltas"),
    )


def _pairing_stats(t: RaceTables) -> DataFrame:
    records = [
        c
        for name in ("qualifying", "race")
        for c in (
            F.col(f"{name}_comparable_rounds").alias(f"{name}_rounds"),
            F.col(f"{name}_wins_a"),
            F.col(f"{name}_wins_b"),
            F.col(f"{name}_win_rate_a").alias(f"{name}_rate_a"),
            F.col(f"{name}_win_rate_b").alias(f"{name}_rate_b"),
            F.col(f"{name}_evidence.evidence_strength").alias(f"{name}_strength"),
            F.nullif(joined(F.col(f"{name}_evidence.rounds_included")), F.lit("")).alias(f"{name}_rounds_included"),
            *stats_columns(f"{name}_delta_stats", f"{name}_delta"),
        )
    ]
    points = [f"{kind}_{side}" for kind in ("points", "sprint_points", "total_points") for side in ("a", "b")]
    return statistics.pairing_stats(event.teammate_events(t)).select(
        *_TEAM_PAIR,
        "rounds_together",
        *records,
        *points,
        "points_difference",
        *stats_columns("points_delta_stats", "points_delta"),
        joined(F.col("points_evidence.rounds_included")).alias("points_rounds_included"),
    )


def _conversion_stats(t: RaceTables) -> DataFrame:
    stats = conversion.driver_conversion_stats(conversion.driver_conversion(t))

    def figure(name: str, struct: str, n: str, k: str, rate: str):
        e = F.col(f"{struct}.evidence")
        return F.struct(
            F.lit(name).alias("figure"),
            F.col(f"{struct}.{n}").alias("observations"),
            F.col(f"{struct}.{k}").alias("successes"),
            F.col(f"{struct}.{rate}").alias("rate"),
            e["total_races"].alias("total_races"),
            e["excluded_observations"].alias("excluded_observations"),
            e["is_available"].alias("is_available"),
            e["evidence_strength"].alias("evidence_strength"),
            joined(F.col("rounds_included")).alias("rounds_included"),
        )

    figures = F.array(
        figure("pole_to_win", "pole_to_win", "total_poles", "wins_from_pole", "conversion_rate"),
        figure("front_row", "front_row", "front_row_starts", "front_row_podiums", "retention_rate"),
        figure("top10", "top10_conversion", "top10_starts", "top10_conversions", "conversion_rate"),
    )
    return stats.select("season_year", "driver_id", F.inline(figures))


def _grid_tier_stats(t: RaceTables) -> DataFrame:
    rows = conversion.grid_tier_rows(conversion.driver_conversion_stats(conversion.driver_conversion(t)))
    return rows.select(
        *[c for c in rows.columns if c != "evidence"],
        "evidence.total_races",
        "evidence.is_available",
        "evidence.evidence_strength",
    )


_VIEWS = {
    "lap_stats": _lap_stats,
    "pit_stats": _pit_stats,
    "driver_season_lap_stats": _season_lap_stats,
    "qualifying_delta_stats": _qualifying_delta_stats,
    "h2h_stats": _h2h_stats,
    "one_team_qualifying_stats": _one_team_qualifying,
    "one_team_h2h_stats": lambda t: _h2h_stats(t, ONE_TEAM),
    "position_change_stats": _position_change_stats,
    "points_stats": _points_stats,
    "driver_profile": _driver_profile,
    "rolling_form": _rolling_form,
    "race_deltas": lambda t: statistics.race_deltas(season.driver_rounds(t)),
    "form_summary": _form_summary,
    "pairing_stats": _pairing_stats,
    "conversion_stats": _conversion_stats,
    "grid_tier_stats": _grid_tier_stats,
}

QUERIES = {name: over_star(view) for name, view in _VIEWS.items()}
