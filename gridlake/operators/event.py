"""Per-race views: results, qualifying, laps, pit stops and teammate pairs.

``season`` and ``round`` are optional filters; without them a view covers every
race at once.  Counts and averages are taken before names are joined, so a
dimension join never multiplies rows and only carries aggregated data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.scalars import (
    best_qualifying_millis,
    is_classified,
    position_change,
    truncated_mean,
)
from gridlake.operators.common import (
    RACE,
    constructor_names,
    delta,
    driver_names,
    first_two_by_driver,
    race_details,
    scoped,
    with_pair_names,
    zero_points,
)
from gridlake.tables import RaceTables


def list_races(t: RaceTables, season: int | None = None) -> DataFrame:
    """The race calendar with circuit and place."""
    circuits = t.circuits.select("circuit_id", "circuit_name", "locality", "country")
    return scoped(t.races, season).join(circuits, "circuit_id")


def existing_races(t: RaceTables, requested: DataFrame) -> DataFrame:
    """The requested (season_year, round) pairs that are in the calendar."""
    return requested.join(t.races, RACE, "left_semi")


def race_overview(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Winner, number of classified cars and number of results of each race."""
    winner = F.struct("driver_id", "constructor_id", "time_millis", "time_text")
    counts = (
        scoped(t.race_results, season, round)
        .groupBy(*RACE)
        .agg(
            F.count("source_position").alias("classified_count"),
            F.count(F.lit(1)).alias("total_result_count"),
            F.min(F.when(F.col("source_position") == 1, winner)).alias("winner"),
        )
        .select(*RACE, "classified_count", "total_result_count", "winner.*")
    )
    return (
        scoped(race_details(t), season, round)
        .join(counts, RACE, "left")
        .join(driver_names(t), "driver_id", "left")
        .join(constructor_names(t), "constructor_id", "left")
        .select(
            *RACE,
            "race_name",
            "circuit_name",
            "race_date",
            F.col("given_name").alias("winner_given_name"),
            F.col("family_name").alias("winner_family_name"),
            F.col("constructor_name").alias("winner_constructor"),
            F.col("time_millis").alias("winner_time_millis"),
            F.col("time_text").alias("winner_time_text"),
            F.coalesce("classified_count", F.lit(0)).cast("int").alias("classified_count"),
            F.coalesce("total_result_count", F.lit(0)).cast("int").alias("total_result_count"),
        )
    )


def race_results(
    t: RaceTables,
    season: int | None = None,
    round: int | None = None,
    driver_id: str | None = None,
    constructor_id: str | None = None,
) -> DataFrame:
    """Full results with driver and team names."""
    rows = scoped(t.race_results, season, round, driver_id=driver_id, constructor_id=constructor_id)
    return rows.join(driver_names(t), "driver_id").join(constructor_names(t), "constructor_id").select(
        *RACE,
        "driver_id",
        "given_name",
        "family_name",
        "constructor_id",
        "constructor_name",
        *[c for c in rows.columns if c not in (*RACE, "driver_id", "constructor_id")],
    )


def grid_vs_finish(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Grid against finish per car; a pit-lane start counts as grid 0 here."""
    return race_results(t, season, round).select(
        *RACE,
        "driver_id",
        "given_name",
        "family_name",
        "constructor_name",
        "grid_position",
        F.col("source_position").alias("finish_position"),
        position_change(F.col("grid_position"), F.col("source_position")).alias("position_change"),
        "status",
        "points",
    )


def qualifying_order(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    rows = scoped(t.qualifying_results, season, round)
    return rows.join(driver_names(t), "driver_id").join(constructor_names(t), "constructor_id").select(
        *RACE,
        "driver_id",
        "given_name",
        "family_name",
        "constructor_name",
        "position",
        "q1_time_millis",
        "q2_time_millis",
        "q3_time_millis",
    )


def driver_standings(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Championship standing of drivers after a round, as the source published it."""
    return (
        scoped(t.driver_standings, season, round)
        .join(driver_names(t), "driver_id")
        .select(*RACE, "driver_id", "given_name", "family_name", "position", "points", "wins")
    )


def constructor_standings(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    return (
        scoped(t.constructor_standings, season, round)
        .join(constructor_names(t), "constructor_id")
        .select(*RACE, "constructor_id", "constructor_name", "position", "points", "wins")
    )


def driver_lap_times(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Laps, fastest and average lap per car; untimed laps count but are not averaged."""
    laps = (
        scoped(t.lap_times, season, round)
        .groupBy(*RACE, "driver_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("lap_count"),
            F.min("time_millis").alias("fastest_lap_millis"),
            truncated_mean(F.sum("time_millis"), F.count("time_millis")).alias("avg_lap_millis"),
        )
    )
    return laps.join(driver_names(t), "driver_id").select(
        *RACE, "driver_id", "given_name", "family_name", "lap_count", "fastest_lap_millis", "avg_lap_millis"
    )


def _pit_stops_by_driver(t: RaceTables, season: int | None, round: int | None) -> DataFrame:
    return (
        scoped(t.pit_stops, season, round)
        .groupBy(*RACE, "driver_id")
        .agg(
            F.max("stop_number").alias("stop_count"),
            F.sum("duration_millis").alias("total_duration_millis"),
            F.count("duration_millis").alias("timed_stops"),
            F.min("duration_millis").alias("fastest_stop_millis"),
        )
    )


def driver_pit_stops(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Stops per car; the count is the highest stop number."""
    return (
        _pit_stops_by_driver(t, season, round)
        .join(driver_names(t), "driver_id")
        .select(
            *RACE,
            "driver_id",
            "given_name",
            "family_name",
            "stop_count",
            "total_duration_millis",
            truncated_mean(F.col("total_duration_millis"), F.col("timed_stops")).alias("avg_duration_millis"),
            "fastest_stop_millis",
        )
    )


def constructor_pit_stops(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Stops per team; the team comes from the race result, cars without one drop out."""
    team_of = scoped(t.race_results, season, round).select(*RACE, "driver_id", "constructor_id")
    teams = (
        _pit_stops_by_driver(t, season, round)
        .join(team_of, [*RACE, "driver_id"])
        .groupBy(*RACE, "constructor_id")
        .agg(
            F.sum("stop_count").alias("total_stops"),
            truncated_mean(F.sum("total_duration_millis"), F.sum("timed_stops")).alias("avg_duration_millis"),
            F.min("fastest_stop_millis").alias("fastest_stop_millis"),
        )
    )
    return teams.join(constructor_names(t), "constructor_id").select(
        *RACE, "constructor_id", "constructor_name", "total_stops", "avg_duration_millis", "fastest_stop_millis"
    )


def pit_stop_counts(t: RaceTables, season: int | None = None, up_to_round: int | None = None) -> DataFrame:
    """Number of recorded stops per car and race."""
    return (
        scoped(t.pit_stops, season, up_to_round=up_to_round)
        .groupBy(*RACE, "driver_id")
        .agg(F.count(F.lit(1)).alias("pit_stop_count"))
    )


def driver_race_summary(
    t: RaceTables, season: int | None = None, round: int | None = None, driver_id: str | None = None
) -> DataFrame:
    """One car's race on one row, with the number of recorded stops."""
    rows = scoped(t.race_results, season, round, driver_id=driver_id)
    return (
        rows.join(pit_stop_counts(t, season), [*RACE, "driver_id"], "left")
        .join(driver_names(t), "driver_id")
        .join(constructor_names(t), "constructor_id")
        .select(
            *RACE,
            "driver_id",
            "given_name",
            "family_name",
            "constructor_name",
            "grid_position",
            F.col("source_position").alias("finish_position"),
            position_change(F.col("grid_position"), F.col("source_position")).alias("position_change"),
            "points",
            "laps_completed",
            "status",
            F.coalesce("pit_stop_count", F.lit(0)).alias("pit_stop_count"),
            F.col("time_millis").alias("race_time_millis"),
        )
    )


def _best_times(t: RaceTables, season: int | None, round: int | None, up_to_round: int | None = None) -> DataFrame:
    times = [F.col(f"q{n}_time_millis") for n in (1, 2, 3)]
    return scoped(t.qualifying_results, season, round, up_to_round).select(
        *RACE,
        "driver_id",
        "constructor_id",
        F.col("position").alias("qualifying_position"),
        best_qualifying_millis(*times).alias("best_millis"),
    )


def teammate_qualifying(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """Qualifying gap between the first two drivers of each team, by driver id."""
    pairs = first_two_by_driver(
        _best_times(t, season, round), [*RACE, "constructor_id"], ["best_millis"]
    ).select(
        *RACE,
        "constructor_id",
        F.col("a.driver_id").alias("driver_a_id"),
        F.col("b.driver_id").alias("driver_b_id"),
        F.col("a.best_millis").alias("best_time_a_millis"),
        F.col("b.best_millis").alias("best_time_b_millis"),
        delta("a.best_millis", "b.best_millis").alias("delta_millis"),
    )
    return with_pair_names(pairs, t).select(
        *RACE,
        "constructor_id",
        "constructor_name",
        "driver_a_id",
        "driver_a_name",
        "driver_b_id",
        "driver_b_name",
        "best_time_a_millis",
        "best_time_b_millis",
        "delta_millis",
    )


def teammate_deltas(
    t: RaceTables, season: int | None = None, round: int | None = None, constructor_id: str | None = None
) -> DataFrame:
    """Qualifying, grid, finish and points gaps (a minus b) without names."""
    results = scoped(t.race_results, season, round, constructor_id=constructor_id).select(
        *RACE, "driver_id", "constructor_id", "grid_position", "source_position", "points"
    )
    times = _best_times(t, season, round).select(*RACE, "driver_id", "best_millis")
    rows = results.join(times, [*RACE, "driver_id"], "left")
    values = ["grid_position", "source_position", "points", "best_millis"]
    return first_two_by_driver(rows, [*RACE, "constructor_id"], values).select(
        *RACE,
        "constructor_id",
        F.col("a.driver_id").alias("driver_a_id"),
        F.col("b.driver_id").alias("driver_b_id"),
        delta("a.best_millis", "b.best_millis").alias("qualifying_delta_millis"),
        delta("a.grid_position", "b.grid_position").alias("grid_delta"),
        delta("a.source_position", "b.source_position").alias("finish_delta"),
        delta("a.points", "b.points").alias("points_delta"),
    )


def teammate_comparison(
    t: RaceTables, season: int | None = None, round: int | None = None, constructor_id: str | None = None
) -> DataFrame:
    """``teammate_deltas`` with team and driver names."""
    return with_pair_names(teammate_deltas(t, season, round, constructor_id), t).select(
        *RACE,
        "constructor_id",
        "constructor_name",
        "driver_a_id",
        "driver_a_name",
        "driver_b_id",
        "driver_b_name",
        "qualifying_delta_millis",
        "grid_delta",
        "finish_delta",
        "points_delta",
    )


def teammate_events(
    t: RaceTables,
    season: int | None = None,
    round: int | None = None,
    up_to_round: int | None = None,
    constructor_id: str | None = None,
) -> DataFrame:
    """Head-to-head of each team's first two drivers in each race, without names.

    A finish only compares between two classified cars.
    """
    results = scoped(t.race_results, season, round, up_to_round, constructor_id=constructor_id).select(
        *RACE,
        "driver_id",
        "constructor_id",
        F.col("grid_position").alias("grid"),
        F.when(is_classified(F.col("position_text"), F.col("status")), F.col("source_position")).alias("finish"),
        "status",
        "points",
    )
    times = _best_times(t, season, round, up_to_round).drop("constructor_id")
    sprint = scoped(t.sprint_results, season, round, up_to_round).select(
        *RACE, "driver_id", F.col("points").alias("sprint_points")
    )
    rows = (
        results.join(times, [*RACE, "driver_id"], "left")
        .join(sprint, [*RACE, "driver_id"], "left")
        .withColumn("sprint_points", F.coalesce("sprint_points", zero_points()))
    )
    values = ["grid", "finish", "status", "points", "sprint_points", "qualifying_position", "best_millis"]
    pair = first_two_by_driver(rows, [*RACE, "constructor_id"], values)

    def ahead(value: str):
        return F.when(F.col(f"a.{value}") < F.col(f"b.{value}"), F.col("a.driver_id")).when(
            F.col(f"b.{value}") < F.col(f"a.{value}"), F.col("b.driver_id")
        )

    def both(value: str):
        return F.col(f"a.{value}").isNotNull() & F.col(f"b.{value}").isNotNull()

    return pair.select(
        *RACE,
        "constructor_id",
        F.col("a.driver_id").alias("driver_a_id"),
        F.col("b.driver_id").alias("driver_b_id"),
        F.col("a.qualifying_position").alias("qualifying_a_pos"),
        F.col("b.qualifying_position").alias("qualifying_b_pos"),
        delta("a.best_millis", "b.best_millis").alias("qualifying_delta_millis"),
        *[
            F.col(f"{side}.{value}").alias(f"{value}_{side}")
            for value in ("grid", "finish", "status", "points", "sprint_points")
            for side in ("a", "b")
        ],
        both("qualifying_position").alias("is_comparable_qualifying"),
        both("finish").alias("is_comparable_finish"),
        ahead("qualifying_position").alias("ahead_in_qualifying"),
        ahead("finish").alias("ahead_in_race"),
    )


def event_teammates(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """``teammate_events`` with race, team and driver names."""
    events = teammate_events(t, season, round)
    named = with_pair_names(events.join(t.races.select(*RACE, "race_name"), RACE), t)
    lead = ["race_name", "constructor_id", "constructor_name"]
    pair = ["driver_a_id", "driver_a_name", "driver_b_id", "driver_b_name"]
    rest = [c for c in events.columns if c not in (*RACE, *lead, *pair)]
    return named.select(*RACE, *lead, *pair, *rest)


def race_classification(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """One row per race: the overview with its results nested in finishing order."""
    rows = race_results(t, season, round)
    entry = F.struct(
        F.coalesce("source_position", F.lit(2**31 - 1)).alias("order"),
        F.struct(
            *[c for c in rows.columns if c not in RACE],
            position_change(F.col("grid_position"), F.col("source_position")).alias("position_change"),
        ).alias("result"),
    )
    nested = rows.groupBy(*RACE).agg(F.array_sort(F.collect_list(entry)).getField("result").alias("results"))
    return race_overview(t, season, round).join(nested, RACE, "left")


# Part of a race document -> its view and the order of its rows, as SQL sort keys in ascending order.
_PARTS = {
    "results": (race_results, ["coalesce(source_position, 2147483647)", "driver_id"]),
    "grid_vs_finish": (grid_vs_finish, ["coalesce(finish_position, 2147483647)", "driver_id"]),
    "qualifying": (qualifying_order, ["position", "driver_id"]),
    "teammate_qualifying": (teammate_qualifying, ["constructor_id"]),
    "pit_stops": (driver_pit_stops, ["-stop_count", "driver_id"]),
    "constructor_pit_stops": (constructor_pit_stops, ["constructor_id"]),
    "lap_times": (driver_lap_times, ["coalesce(fastest_lap_millis, 2147483647)", "driver_id"]),
    "driver_standings": (driver_standings, ["position", "driver_id"]),
    "constructor_standings": (constructor_standings, ["position", "constructor_id"]),
}


def race_documents(t: RaceTables, season: int | None = None, round: int | None = None) -> DataFrame:
    """One row per race of the calendar: its overview, and every part of its page as an ordered list.

    The rows of all parts meet in one aggregation, each part in a column of its
    own, so the nesting costs one shuffle whatever the number of parts.  A list
    is bounded by the cars of a race; a part without rows is an empty list.
    """
    overview = race_overview(t, season, round)
    fields = [c for c in overview.columns if c not in RACE]
    rows = overview.select(*RACE, F.struct(*fields).alias("overview"))
    for part, (view, order) in _PARTS.items():
        frame = view(t, season, round)
        row = F.struct(*[c for c in frame.columns if c not in RACE]).alias("row")
        keys = [F.expr(key).alias(f"key_{k}") for k, key in enumerate(order)]
        rows = rows.unionByName(frame.select(*RACE, F.struct(*keys, row).alias(part)), allowMissingColumns=True)
    nested = [F.array_sort(F.collect_list(part)).getField("row").alias(part) for part in _PARTS]
    nested = rows.groupBy(*RACE).agg(F.max("overview").alias("overview"), *nested)
    return nested.where("overview IS NOT NULL")


def write_race_documents(t: RaceTables, path: str, season: int | None = None, round: int | None = None) -> None:
    """Race documents as JSON lines, one line a race, in a folder for each season; NULL fields are written."""
    documents = race_documents(t, season, round).withColumn("season", F.col("season_year"))
    documents.write.partitionBy("season").option("ignoreNullFields", False).mode("overwrite").json(path)


def race_bundle(t: RaceTables, season: int, round: int) -> dict[str, DataFrame]:
    """The per-race views a race page shows, each still lazy."""
    return {
        "overview": race_overview(t, season, round),
        "results": race_results(t, season, round),
        "grid_vs_finish": grid_vs_finish(t, season, round),
        "qualifying_order": qualifying_order(t, season, round),
        "teammate_qualifying": teammate_qualifying(t, season, round),
        "driver_pit_stops": driver_pit_stops(t, season, round),
        "constructor_pit_stops": constructor_pit_stops(t, season, round),
        "driver_lap_times": driver_lap_times(t, season, round),
        "driver_standings": driver_standings(t, season, round),
        "constructor_standings": constructor_standings(t, season, round),
    }
