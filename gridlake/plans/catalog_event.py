"""Registered queries: table scans and per-race views over a star-schema folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.scalars import attrition_class
from gridlake.operators import event
from gridlake.operators.common import RACE
from gridlake.operators.temporal import as_of_join
from gridlake.plans.views import plain
from gridlake.sources.star import race_tables
from gridlake.tables import RaceTables


def _scan(table: str, *dropped: str):
    return lambda t: t[table].drop(*dropped)


def _classification(t: RaceTables) -> DataFrame:
    entry = F.col("results")
    shown = F.transform(
        entry,
        lambda r: F.concat(
            r["driver_id"], F.lit(":"), F.coalesce(r["position_change"].cast("string"), F.lit("-"))
        ),
    )
    return event.race_classification(t).select(
        "season_year", "round", F.size(entry).alias("results"), F.array_join(shown, ",").alias("running_order")
    )


def _listed(part: str, *fields: str) -> list:
    """Number of a part's rows, and the rows in their order as text."""
    shown = F.transform(
        part, lambda r: F.concat_ws(":", *[F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields])
    )
    return [F.size(part).cast("bigint").alias(f"{part}_n"), F.array_join(shown, ",").alias(part)]


def _documents(t: RaceTables) -> DataFrame:
    return event.race_documents(t).select(
        "season_year",
        "round",
        "overview.race_name",
        "overview.total_result_count",
        *_listed("results", "driver_id", "source_position", "status", "time_text"),
        *_listed("grid_vs_finish", "driver_id", "grid_position", "position_change"),
        *_listed("qualifying", "driver_id", "position", "q1_time_millis", "q2_time_millis", "q3_time_millis"),
        *_listed("teammate_qualifying", "constructor_id", "driver_a_name", "driver_b_name", "delta_millis"),
        *_listed("pit_stops", "driver_id", "stop_count", "total_duration_millis", "fastest_stop_millis"),
        *_listed("constructor_pit_stops", "constructor_id", "total_stops", "avg_duration_millis"),
        *_listed("lap_times", "driver_id", "lap_count", "fastest_lap_millis", "avg_lap_millis"),
        *_listed("driver_standings", "driver_id", "position", "wins"),
        *_listed("constructor_standings", "constructor_id", "position", "wins"),
    )


def _as_of_scoring(t: RaceTables) -> DataFrame:
    """Every result with the standing of the last round up to it in which the driver scored."""
    scored = t.driver_standings.join(t.race_results.where("points > 0"), [*RACE, "driver_id"], "left_semi")
    results = t.race_results.select(*RACE, "driver_id", "source_position")
    return as_of_join(results, scored, ["season_year", "driver_id"], "round", ["position", "points"], "standing_")


_VIEWS = {
    "scan_seasons": _scan("seasons"),
    "scan_circuits": _scan("circuits", "url"),
    "scan_constructors": _scan("constructors", "url"),
    "scan_drivers": _scan("drivers", "url"),
    "scan_races": _scan("races", "url"),
    "scan_race_results": _scan("race_results"),
    "scan_qualifying_results": _scan("qualifying_results"),
    "scan_sprint_results": _scan("sprint_results"),
    "scan_lap_times": _scan("lap_times"),
    "scan_pit_stops": _scan("pit_stops"),
    "list_races": lambda t: event.list_races(t).drop("url", "race_time"),
    "existing_races": lambda t: event.existing_races(
        t, t.races.select("season_year", (F.col("round") + 1).cast("int").alias("round"))
    ),
    "attrition_class": lambda t: t.race_results.select(
        "season_year",
        "round",
        "driver_id",
        attrition_class(
            F.concat(F.lit(" "), F.lower("position_text"), F.lit(" ")), F.concat(F.upper("status"), F.lit("  "))
        ).alias("state"),
    ),
    "race_overview": event.race_overview,
    "race_results": event.race_results,
    "grid_vs_finish": event.grid_vs_finish,
    "race_classification": _classification,
    "race_documents": _documents,
    "results_as_of_scoring": _as_of_scoring,
    "qualifying_order": event.qualifying_order,
    "driver_standings": event.driver_standings,
    "constructor_standings": event.constructor_standings,
    "driver_lap_times": event.driver_lap_times,
    "driver_pit_stops": event.driver_pit_stops,
    "constructor_pit_stops": event.constructor_pit_stops,
    "driver_race_summary": event.driver_race_summary,
    "teammate_qualifying": event.teammate_qualifying,
    "teammate_comparison": event.teammate_comparison,
    "event_teammates": event.event_teammates,
}


def over_star(view):
    """A query over a star-schema folder from an operator over race tables."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        return plain(view(race_tables(spark, root)))

    return run


QUERIES = {name: over_star(view) for name, view in _VIEWS.items()}
