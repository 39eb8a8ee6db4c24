"""Registered queries: insight rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators import event, insights, statistics
from gridlake.plans.catalog_event import over_star
from gridlake.plans.views import joined, rounded
from gridlake.tables import RaceTables


def flat(rows: DataFrame) -> DataFrame:
    """Insights with the audit trail spread into plain columns."""
    trace = F.col("traceability")
    settings = F.transform(
        F.array_sort(F.map_entries(trace["rule_parameters"])),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    kept = (
        "source_metric",
        "source_function",
        "minimum_sample_size",
        "sign_convention",
        "season_year",
        "round_num",
        "driver_id",
        "constructor_id",
        "excluded_observations",
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("traceability", "magnitude")],
        rounded(F.col("magnitude")).alias("magnitude"),
        *[trace[c].alias(c) for c in kept],
        F.array_join(settings, ",").alias("rule_parameters"),
        rounded(trace["observed_value"]).alias("observed_value"),
        joined(trace["rounds_included"]).alias("rounds_included"),
    )


def _race_pace(t: RaceTables) -> DataFrame:
    pairs = insights.race_pace_pairs(statistics.lap_time_stats(t.lap_times), t.race_results)
    return insights.race_pace_insights(pairs)


def _position_changes(t: RaceTables) -> DataFrame:
    return t.race_results.withColumn("position_change", F.col("grid_position") - F.col("source_position"))


ONE_DRIVER = "driver_000000000001"
ONE_PAIR = ("driver_000000000003", "driver_000000000002")
ONE_TEAM = "team_000000000000"

_INSIGHTS = {
    "race_insights": insights.race_insights,
    "qualifying_mean_insights": lambda t: insights.qualifying_gap_insights(
        statistics.qualifying_delta_stats(event.teammate_qualifying(t)), mean_of_season=True
    ),
    "teammate_mean_insights": lambda t: insights.teammate_insights(
        statistics.teammate_delta_stats(event.teammate_deltas(t)), mean_of_season=True
    ),
    "multi_race_position_insights": lambda t: insights.multi_race_position_insights(
        statistics.position_change_stats(_position_changes(t))
    ),
    "fastest_lap_insights": lambda t: insights.fastest_lap_insights(statistics.lap_time_stats(t.lap_times)),
    "race_pace_insights": _race_pace,
    "fast_pit_stop_insights": lambda t: insights.fast_pit_stop_insights(t.pit_stops),
    "pit_stop_variability_insights": lambda t: insights.pit_stop_variability_insights(
        statistics.pit_stop_stats(t.pit_stops)
    ),
    "driver_insights": insights.driver_season_insights,
    "pair_insights": insights.pair_season_insights,
    "constructor_insights": insights.constructor_season_insights,
    "season_insights": insights.season_insights,
    "conversion_insights": insights.conversion_insights,
    "mixed_insights": lambda t: insights.scope_insights(t, "mixed"),
    # Selections of one driver, pair or team.
    "entity_insights": lambda t: insights.for_entities(insights.race_insights(t), driver_id=ONE_DRIVER),
    "team_entity_insights": lambda t: insights.for_entities(insights.race_insights(t), constructor_id=ONE_TEAM),
    "one_driver_insights": lambda t: insights.longitudinal_insights(t, driver_id=ONE_DRIVER),
    "one_pair_insights": lambda t: insights.longitudinal_insights(t, drivers=ONE_PAIR),
    "one_team_insights": lambda t: insights.longitudinal_insights(t, constructor_id=ONE_TEAM),
}


def _flat_view(view):
    return lambda t: flat(view(t))


def _counts(t: RaceTables) -> DataFrame:
    stored = t.keep("season_insights", lambda: insights.season_insights(t))
    return insights.counts_by_rule(
        stored.select("rule_id").unionByName(insights.conversion_insights(t).select("rule_id"))
    )


QUERIES = {name: over_star(_flat_view(view)) for name, view in _INSIGHTS.items()}
QUERIES["insight_counts"] = over_star(_counts)
