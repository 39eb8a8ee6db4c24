"""Season views: trajectories, aggregates, contributions and teammate records.

Two notions of a finish are kept apart on purpose.  A driver finish needs a
classified result.  A team finish is any result with a position, so a retired
car that was given one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even
from gridlake.functions.scalars import is_classified
from gridlake.operators.common import (
    RACE,
    constructor_names,
    driver_label,
    race_details,
    scoped,
    sum_if,
    with_pair_names,
    zero_points,
)
from gridlake.operators.event import pit_stop_counts, teammate_events
from gridlake.tables import RaceTables

DRIVER_SEASON = ["season_year", "driver_id"]
TEAM_SEASON = ["season_year", "constructor_id"]
PAIR = ["season_year", "constructor_id", "driver_a_id", "driver_b_id"]


def running(entity: str):
    return (
        Window.partitionBy("season_year", entity)
        .orderBy("round")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def driver_rounds(
    t: RaceTables, season: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """One row per driver and race: grid, classified finish, race and sprint points."""
    classified = is_classified(F.col("position_text"), F.col("status"))
    results = scoped(t.race_results, season, up_to_round=up_to_round, driver_id=driver_id).select(
        *RACE,
        "driver_id",
        "constructor_id",
        "grid_position",
        F.when(classified, F.col("source_position")).alias("finish_position"),
        "position_text",
        "status",
        classified.alias("is_classified"),
        F.coalesce("points", zero_points()).alias("race_points"),
        "laps_completed",
        "fastest_lap_rank",
    )
    sprint = scoped(t.sprint_results, season, up_to_round=up_to_round, driver_id=driver_id).select(
        *RACE, "driver_id", F.col("points").alias("sprint_points")
    )
    return (
        results.join(sprint, [*RACE, "driver_id"], "left")
        .withColumn("sprint_points", F.coalesce("sprint_points", zero_points()))
        .withColumn("total_round_points", F.col("race_points") + F.col("sprint_points"))
    )


def _cumulative(entity: str) -> list[Column]:
    return [
        F.sum(source).over(running(entity)).alias(f"cumulative_{name}_points")
        for name, source in (
            ("race", "race_points"),
            ("sprint", "sprint_points"),
            ("total", "total_round_points"),
        )
    ]


def driver_trajectory(
    t: RaceTables, season: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """A driver's season race by race, with running points and standing."""
    standing = scoped(t.driver_standings, season, up_to_round=up_to_round, driver_id=driver_id).select(
        *RACE, "driver_id", F.col("position").alias("championship_standing_position")
    )
    key = [*RACE, "driver_id"]
    return (
        driver_rounds(t, season, driver_id, up_to_round)
        .select("*", *_cumulative("driver_id"))
        .join(pit_stop_counts(t, season, up_to_round), key, "left")
        .join(standing, key, "left")
        .join(race_details(t), RACE)
        .join(constructor_names(t), "constructor_id")
        .select(
            *RACE,
            "driver_id",
            "race_name",
            "circuit_name",
            "race_date",
            "constructor_id",
            "constructor_name",
            "grid_position",
            "finish_position",
            "position_text",
            "status",
            "is_classified",
            "race_points",
            "sprint_points",
            "total_round_points",
            "cumulative_race_points",
            "cumulative_sprint_points",
            "cumulative_total_points",
            "championship_standing_position",
            F.coalesce("pit_stop_count", F.lit(0)).alias("pit_stop_count"),
            "fastest_lap_rank",
        )
    )


def latest_standing(standings: DataFrame, cutoffs: DataFrame, entity: str) -> DataFrame:
    """The last standing published at or before each entity's ``up_to_round``."""
    key = ["season_year", entity]
    return (
        standings.join(cutoffs.select(*key, "up_to_round"), key)
        .where(F.col("round") <= F.col("up_to_round"))
        .groupBy(*key)
        .agg(F.max_by("position", "round").alias("championship_standing"))
    )


def _cutoff(up_to_round: int | None) -> Column:
    """The requested cutoff, or else the last round seen for the entity."""
    return (F.max("round") if up_to_round is None else F.lit(up_to_round)).cast("int").alias("up_to_round")


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, round_half_even(total.cast("double") / count, 2))


def driver_season_totals(rounds: DataFrame, up_to_round: int | None = None) -> DataFrame:
    """Season totals per driver from ``driver_rounds`` rows, without names or standing."""
    status = F.lower("status")
    started = F.col("grid_position").isNotNull() | (
        ~status.isin("did not start", "dns") & ~F.col("status").startswith("DNS")
    )
    grid = F.when(F.col("grid_position") > 0, F.col("grid_position"))
    finish = F.col("finish_position")
    return rounds.groupBy(*DRIVER_SEASON).agg(
        _cutoff(up_to_round),
        F.max_by("constructor_id", "round").alias("constructor_id"),
        F.count(F.lit(1)).cast("int").alias("races_entered"),
        sum_if(started).alias("races_started"),
        sum_if(F.col("is_classified")).alias("races_classified"),
        sum_if(~F.col("is_classified")).alias("dnf_count"),
        sum_if(finish == 1).alias("wins"),
        sum_if(finish.between(1, 3)).alias("podiums"),
        sum_if(F.col("race_points") > 0).alias("points_finishes"),
        F.sum("race_points").alias("total_race_points"),
        F.sum("sprint_points").alias("total_sprint_points"),
        F.sum("total_round_points").alias("total_points"),
        _mean(F.sum(grid), F.count(grid)).alias("average_grid"),
        _mean(F.sum(finish), F.count(finish)).alias("average_finish"),
        F.min(grid).alias("best_grid"),
        F.min(finish).alias("best_finish"),
        F.coalesce(F.sum("laps_completed"), F.lit(0)).alias("total_laps_completed"),
    )


def driver_seasons(
    t: RaceTables, season: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """Season aggregate of every driver with a result in scope."""
    totals = driver_season_totals(driver_rounds(t, season, driver_id, up_to_round), up_to_round)
    standing = latest_standing(
        scoped(t.driver_standings, season, up_to_round=up_to_round, driver_id=driver_id), totals, "driver_id"
    )
    people = t.drivers.select("driver_id", F.col("code").alias("driver_code"), "given_name", "family_name")
    return (
        totals.join(standing, DRIVER_SEASON, "left")
        .join(people, "driver_id")
        .join(constructor_names(t), "constructor_id")
        .select(
            "season_year",
            "up_to_round",
            "driver_id",
            "driver_code",
            "given_name",
            "family_name",
            "constructor_id",
            "constructor_name",
            *[c for c in totals.columns if c not in ("season_year", "up_to_round", "driver_id", "constructor_id")],
            "championship_standing",
        )
    )


def constructor_rounds(
    t: RaceTables, season: int | None = None, constructor_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """One row per team and race: points of both sessions, best finish, podiums and cars."""
    position = F.col("source_position")
    key = [*RACE, "constructor_id"]
    results = (
        scoped(t.race_results, season, up_to_round=up_to_round, constructor_id=constructor_id)
        .groupBy(*key)
        .agg(
            F.sum(F.coalesce("points", zero_points())).alias("race_points"),
            F.min(position).alias("best_finish"),
            sum_if(position.between(1, 3)).alias("podiums"),
            F.count(position).cast("int").alias("cars_classified"),
            F.count(F.lit(1)).cast("int").alias("cars_entered"),
        )
    )
    sprint = (
        scoped(t.sprint_results, season, up_to_round=up_to_round, constructor_id=constructor_id)
        .groupBy(*key)
        .agg(F.sum("points").alias("sprint_points"))
    )
    return (
        results.join(sprint, key, "left")
        .withColumn("sprint_points", F.coalesce("sprint_points", zero_points()))
        .withColumn("total_round_points", F.col("race_points") + F.col("sprint_points"))
    )


def constructor_trajectory(
    t: RaceTables, season: int | None = None, constructor_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """A team's season race by race, with running points and standing."""
    standing = scoped(
        t.constructor_standings, season, up_to_round=up_to_round, constructor_id=constructor_id
    ).select(*RACE, "constructor_id", F.col("position").alias("championship_standing_position"))
    return (
        constructor_rounds(t, season, constructor_id, up_to_round)
        .select("*", *_cumulative("constructor_id"))
        .join(standing, [*RACE, "constructor_id"], "left")
        .join(race_details(t), RACE)
        .join(constructor_names(t), "constructor_id")
        .select(
            *RACE,
            "race_name",
            "circuit_name",
            "race_date",
            "constructor_id",
            "constructor_name",
            "race_points",
            "sprint_points",
            "total_round_points",
            "cumulative_race_points",
            "cumulative_sprint_points",
            "cumulative_total_points",
            "best_finish",
            "podiums",
            "cars_classified",
            "cars_entered",
            "championship_standing_position",
        )
    )


def _constructor_totals(rounds: DataFrame, up_to_round: int | None) -> DataFrame:
    return rounds.groupBy(*TEAM_SEASON).agg(
        _cutoff(up_to_round),
        F.count(F.lit(1)).cast("int").alias("races_entered"),
        F.sum("cars_entered").cast("int").alias("total_car_starts"),
        F.sum("cars_classified").cast("int").alias("total_car_finishes"),
        F.sum(F.col("cars_entered") - F.col("cars_classified")).cast("int").alias("dnf_count"),
        sum_if(F.col("best_finish") == 1).alias("wins"),
        F.sum("podiums").cast("int").alias("podiums"),
        F.sum("race_points").alias("total_race_points"),
        F.sum("sprint_points").alias("total_sprint_points"),
        F.sum("total_round_points").alias("total_points"),
        F.min("best_finish").alias("best_finish"),
    )


def _contributions(
    t: RaceTables, totals: DataFrame, season: int | None, constructor_id: str | None, up_to_round: int | None
) -> DataFrame:
    key = [*TEAM_SEASON, "driver_id"]
    drivers = (
        scoped(t.race_results, season, up_to_round=up_to_round, constructor_id=constructor_id)
        .groupBy(*key)
        .agg(
            F.sum(F.coalesce("points", zero_points())).alias("race_points"),
            F.count(F.lit(1)).cast("int").alias("races_entered"),
            F.min("source_position").alias("best_finish"),
        )
    )
    cutoffs = totals.select(*TEAM_SEASON, "up_to_round", F.col("total_points").alias("team_points"))
    sprint = (
        scoped(t.sprint_results, season, up_to_round=up_to_round, constructor_id=constructor_id)
        .join(cutoffs.drop("team_points"), TEAM_SEASON)
        .where(F.col("round") <= F.col("up_to_round"))
        .groupBy(*key)
        .agg(F.sum("points").alias("sprint_points"))
    )
    scored = (
        drivers.join(sprint, key, "left")
        .join(cutoffs, TEAM_SEASON)
        .join(driver_label(t), "driver_id")
        .withColumn("sprint_points", F.coalesce("sprint_points", zero_points()))
        .withColumn("total_points", F.col("race_points") + F.col("sprint_points"))
    )
    share = (F.col("total_points") * 100).cast("double") / F.col("team_points").cast("double")
    return scored.select(
        *TEAM_SEASON,
        "driver_id",
        "driver_name",
        "race_points",
        "sprint_points",
        "total_points",
        F.when(F.col("team_points") > 0, round_half_even(share, 2)).alias("points_share_pct"),
        "races_entered",
        "best_finish",
    )


def driver_contributions(
    t: RaceTables, season: int | None = None, constructor_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """Points and share of every driver inside each team's season."""
    totals = _constructor_totals(constructor_rounds(t, season, constructor_id, up_to_round), up_to_round)
    return _contributions(t, totals, season, constructor_id, up_to_round)


def constructor_seasons(
    t: RaceTables, season: int | None = None, constructor_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """Season aggregate of every team, with its drivers nested by points, then name."""
    totals = _constructor_totals(constructor_rounds(t, season, constructor_id, up_to_round), up_to_round)
    standing = latest_standing(
        scoped(t.constructor_standings, season, up_to_round=up_to_round, constructor_id=constructor_id),
        totals,
        "constructor_id",
    )
    shares = _contributions(t, totals, season, constructor_id, up_to_round)
    item = F.struct(*[c for c in shares.columns if c not in TEAM_SEASON])
    ranked = F.struct((-F.col("total_points")).alias("rank"), F.col("driver_name").alias("name"), item.alias("item"))
    nested = shares.groupBy(*TEAM_SEASON).agg(
        F.array_sort(F.collect_list(ranked)).getField("item").alias("driver_contributions")
    )
    return (
        totals.join(standing, TEAM_SEASON, "left")
        .join(nested, TEAM_SEASON, "left")
        .join(constructor_names(t), "constructor_id")
        .select(
            "season_year",
            "up_to_round",
            "constructor_id",
            "constructor_name",
            *[
                c
                for c in totals.columns
                if c not in ("season_year", "up_to_round", "constructor_id", "best_finish")
            ],
            "driver_contributions",
            "championship_standing",
        )
    )


def season_teammates(
    t: RaceTables, season: int | None = None, up_to_round: int | None = None, constructor_id: str | None = None
) -> DataFrame:
    """Season record of every pair; a substitute makes a pair of its own."""
    last_round = (
        scoped(t.races, season, up_to_round=up_to_round)
        .groupBy("season_year")
        .agg(_cutoff(up_to_round))
    )
    pairs = (
        teammate_events(t, season, up_to_round=up_to_round, constructor_id=constructor_id)
        .groupBy(*PAIR)
        .agg(
            F.count(F.lit(1)).cast("int").alias("rounds_together"),
            sum_if(F.col("ahead_in_qualifying") == F.col("driver_a_id")).alias("qualifying_head_to_head_a"),
            sum_if(F.col("ahead_in_qualifying") == F.col("driver_b_id")).alias("qualifying_head_to_head_b"),
            sum_if(F.col("is_comparable_qualifying")).alias("qualifying_comparable_rounds"),
            sum_if(F.col("ahead_in_race") == F.col("driver_a_id")).alias("race_head_to_head_a"),
            sum_if(F.col("ahead_in_race") == F.col("driver_b_id")).alias("race_head_to_head_b"),
            sum_if(F.col("is_comparable_finish")).alias("race_comparable_rounds"),
            *[
                F.sum(f"{kind}_{side}").alias(f"{kind}_{side}")
                for kind in ("points", "sprint_points")
                for side in ("a", "b")
            ],
        )
        .withColumn("total_points_a", F.col("points_a") + F.col("sprint_points_a"))
        .withColumn("total_points_b", F.col("points_b") + F.col("sprint_points_b"))
    )
    lead = ["season_year", "up_to_round", "constructor_id", "constructor_name"]
    names = ["driver_a_id", "driver_a_name", "driver_b_id", "driver_b_name"]
    return with_pair_names(pairs.join(last_round, "season_year"), t).select(
        *lead, *names, *[c for c in pairs.columns if c not in (*lead, *names)]
    )
