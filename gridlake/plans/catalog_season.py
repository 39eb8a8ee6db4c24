"""Registered queries: season views, conversion and attrition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators import attrition, conversion, season
from gridlake.plans.catalog_event import over_star
from gridlake.plans.views import joined
from gridlake.tables import RaceTables


def _constructor_season(t: RaceTables) -> DataFrame:
    drivers = F.transform("driver_contributions", lambda d: d["driver_id"])
    return season.constructor_seasons(t).withColumn("drivers", joined(drivers)).drop("driver_contributions")


def _latest_driver_standing(t: RaceTables) -> DataFrame:
    cutoffs = t.driver_standings.groupBy("season_year", "driver_id").agg(F.max("round").alias("up_to_round"))
    return season.latest_standing(t.driver_standings, cutoffs, "driver_id")


def _driver_conversion(t: RaceTables) -> DataFrame:
    return conversion.driver_conversion(t).select(
        "season_year",
        "driver_id",
        "driver_name",
        "constructor_id",
        "constructor_name",
        "pole_to_win.*",
        "front_row.*",
        "top10_conversion.*",
        joined(F.col("rounds_included")).alias("rounds_included"),
        "pit_lane_starts_count",
        "dns_count",
    )


def _winning_spans(t: RaceTables) -> DataFrame:
    """From the first to the last win of each driver in each season; spans of a season overlap."""
    return (
        t.race_results.where("source_position = 1")
        .groupBy("season_year", "driver_id")
        .agg(F.min("round").alias("start_round"), F.max("round").alias("end_round"))
    )


def _attrition_report(t: RaceTables) -> DataFrame:
    return attrition.attrition_report(t).select(
        "season_year",
        "up_to_round",
        "period_name",
        "is_complete",
        "total.entries",
        "total.dnf_rate",
        F.size("constructors").alias("constructors"),
        F.size("drivers").alias("drivers"),
    )


_VIEWS = {
    "driver_trajectory": season.driver_trajectory,
    "driver_season": season.driver_seasons,
    "driver_season_to_round_12": lambda t: season.driver_seasons(t, up_to_round=12).select(
        "season_year",
        "driver_id",
        "races_entered",
        "total_points",
        "best_finish",
        "up_to_round",
        "championship_standing",
    ),
    "constructor_trajectory": season.constructor_trajectory,
    "constructor_season": _constructor_season,
    "driver_contribution": season.driver_contributions,
    "latest_driver_standing": _latest_driver_standing,
    "season_teammates": season.season_teammates,
    "driver_conversion": _driver_conversion,
    "grid_tiers": lambda t: conversion.grid_tier_rows(conversion.driver_conversion(t)),
    "completed_rounds": attrition.completed_rounds,
    "attrition_phase": lambda t: attrition.attrition(t, kinds=("phase",)),
    "attrition_round": lambda t: attrition.attrition(t, kinds=("round",)),
    "attrition_report": _attrition_report,
    "attrition_in_winning_spans": lambda t: attrition.attrition_over(t, _winning_spans(t)),
}

QUERIES = {name: over_star(view) for name, view in _VIEWS.items()}
