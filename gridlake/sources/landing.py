"""Race tables rendered as the JSON pages a results service would land.

Pages have a fixed size, so no group that is collected into one page grows
with the data: a field has at most 20 cars, and stops, laps and reference
entities are cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.tables import RaceTables

LAPS_PER_PAGE = 50
ENTITIES_PER_PAGE = 100

_RACE = ["season_year", "round"]


def _s(name: str, alias: str) -> Column:
    return F.col(name).cast("string").alias(alias)


def _page(frame: DataFrame, endpoint: Column, table: Column, limit: int, offset: Column, total: Column) -> DataFrame:
    envelope = F.struct(
        F.lit("series").alias("series"),
        F.lit(limit).cast("string").alias("limit"),
        offset.cast("string").alias("offset"),
        total.cast("string").alias("total"),
        table,
    )
    return frame.select(endpoint.alias("endpoint"), F.to_json(F.struct(envelope.alias("MRData"))).alias("payload"))


def _sorted_list(order: Column, item: Column) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item"))))
    return listed.getField("item")


def _race_page(rows: DataFrame, name: str, key: str, order: str, item: Column, extra: list[str] | None = None) -> DataFrame:
    groups = [*_RACE, *(extra or [])]
    frame = rows.groupBy(*groups).agg(_sorted_list(F.col(order), item).alias("items"))
    race = F.struct(_s("season_year", "season"), _s("round", "round"), F.col("items").alias(key))
    table = F.struct(
        _s("season_year", "season"), _s("round", "round"), F.array(race).alias("Races")
    ).alias("RaceTable")
    endpoint = F.concat_ws("/", "season_year", "round", F.lit(name), *(extra or []))
    return _page(frame, endpoint, table, ENTITIES_PER_PAGE, F.lit(0), F.size("items"))


def _result_item() -> Column:
    lap = F.struct(
        _s("fastest_lap_rank", "rank"),
        _s("fastest_lap_number", "lap"),
        F.struct(F.col("fastest_lap_time").alias("time")).alias("Time"),
    )
    return F.struct(
        _s("car_number", "number"),
        _s("source_position", "position"),
        F.col("position_text").alias("positionText"),
        _s("points", "points"),
        F.struct(F.col("driver_id").alias("driverId")).alias("Driver"),
        F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"),
        _s("grid_position", "grid"),
        _s("laps_completed", "laps"),
        F.col("status").alias("status"),
        F.when(
            F.col("time_millis").isNotNull(), F.struct(_s("time_millis", "millis"), F.col("time_text").alias("time"))
        ).alias("Time"),
        F.when(F.col("fastest_lap_rank").isNotNull(), lap).alias("FastestLap"),
    )


def _qualifying_item() -> Column:
    return F.struct(
        _s("car_number", "number"),
        _s("position", "position"),
        F.struct(F.col("driver_id").alias("driverId")).alias("Driver"),
        F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"),
        F.col("q1_time").alias("Q1"),
        F.col("q2_time").alias("Q2"),
        F.col("q3_time").alias("Q3"),
    )


def _stop_item() -> Column:
    return F.struct(
        F.col("driver_id").alias("driverId"),
        _s("stop_number", "stop"),
        _s("lap", "lap"),
        F.col("time_of_day").alias("time"),
        F.col("duration_text").alias("duration"),
    )


def _lap_item() -> Column:
    timing = F.struct(F.col("driver_id").alias("driverId"), _s("position", "position"), F.col("time").alias("time"))
    return F.struct(_s("lap_number", "number"), F.array(timing).alias("Timings"))


def _block(number: str) -> Column:
    return F.call_function("div", F.col(number) - 1, F.lit(LAPS_PER_PAGE).cast("bigint"))


def _standings_page(rows: DataFrame, name: str, key: str, entity: Column) -> DataFrame:
    item = F.struct(_s("position", "position"), _s("points", "points"), _s("wins", "wins"), entity)
    frame = rows.groupBy(*_RACE).agg(_sorted_list(F.col("position"), item).alias("items"))
    listed = F.struct(_s("season_year", "season"), _s("round", "round"), F.col("items").alias(key))
    table = F.struct(F.array(listed).alias("StandingsLists")).alias("StandingsTable")
    endpoint = F.concat_ws("/", "season_year", "round", F.lit(name))
    return _page(frame, endpoint, table, ENTITIES_PER_PAGE, F.lit(0), F.size("items"))


def _listing(rows: DataFrame, name: str, table: str, key: str, block: Column, order: str, item: Column) -> DataFrame:
    frame = rows.groupBy(block.alias("block")).agg(_sorted_list(F.col(order), item).alias("items"))
    body = F.struct(F.col("items").alias(key)).alias(table)
    endpoint = F.concat_ws("/", F.lit(name), "block")
    return _page(frame, endpoint, body, ENTITIES_PER_PAGE, F.lit(0), F.size("items"))


def _slug_block(column: str) -> Column:
    """All but the last two digits of a slug: at most 100 slugs share a block."""
    return F.expr(f"left({column}, length({column}) - 2)")


def _circuit_item() -> Column:
    return F.struct(
        F.col("circuit_id").alias("circuitId"),
        F.col("circuit_name").alias("circuitName"),
        F.col("url"),
        F.struct(
            _s("latitude", "lat"), _s("longitude", "long"), F.col("locality"), F.col("country")
        ).alias("Location"),
    )


def _driver_item() -> Column:
    return F.struct(
        F.col("driver_id").alias("driverId"),
        _s("permanent_number", "permanentNumber"),
        F.col("code"),
        F.col("given_name").alias("givenName"),
        F.col("family_name").alias("familyName"),
        _s("date_of_birth", "dateOfBirth"),
        F.col("nationality"),
    )


def _calendar_item() -> Column:
    return F.struct(
        _s("season_year", "season"),
        _s("round", "round"),
        F.col("race_name").alias("raceName"),
        F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"),
        _s("race_date", "date"),
        F.concat("race_time", F.lit("Z")).alias("time"),
    )


def landed_pages(t: RaceTables, entity: str) -> DataFrame:
    """The pages of one entity: ``endpoint`` and ``payload``."""
    if entity == "race_results":
        return _race_page(t.race_results, "results", "Results", "driver_id", _result_item())
    if entity == "sprint_results":
        return _race_page(t.sprint_results, "sprint", "SprintResults", "driver_id", _result_item())
    if entity == "qualifying_results":
        return _race_page(t.qualifying_results, "qualifying", "QualifyingResults", "position", _qualifying_item())
    if entity == "pit_stops":
        stops = t.pit_stops.withColumn("block", _block("stop_number"))
        return _race_page(stops, "pitstops", "PitStops", "stop_number", _stop_item(), ["driver_id", "block"])
    if entity == "lap_times":
        laps = t.lap_times.withColumn("block", _block("lap_number"))
        return _race_page(laps, "laps", "Laps", "lap_number", _lap_item(), ["driver_id", "block"])
    if entity == "driver_standings":
        driver = F.struct(F.col("driver_id").alias("driverId")).alias("Driver")
        return _standings_page(t.driver_standings, "driverstandings", "DriverStandings", driver)
    if entity == "constructor_standings":
        team = F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor")
        return _standings_page(t.constructor_standings, "constructorstandings", "ConstructorStandings", team)
    if entity == "seasons":
        item = F.struct(_s("season_year", "season"), F.col("url"))
        block = F.call_function("div", F.col("season_year"), F.lit(10000).cast("bigint"))
        return _listing(t.seasons, "seasons", "SeasonTable", "Seasons", block, "season_year", item)
    if entity == "circuits":
        return _listing(
            t.circuits, "circuits", "CircuitTable", "Circuits", F.lit(0), "circuit_id", _circuit_item()
        )
    if entity == "constructors":
        item = F.struct(F.col("constructor_id").alias("constructorId"), F.col("name"), F.col("nationality"))
        return _listing(
            t.constructors, "constructors", "ConstructorTable", "Constructors",
            _slug_block("constructor_id"), "constructor_id", item,
        )
    if entity == "drivers":
        return _listing(
            t.drivers, "drivers", "DriverTable", "Drivers", _slug_block("driver_id"), "driver_id", _driver_item()
        )
    if entity == "races":
        return _listing(
            t.races, "races", "RaceTable", "Races", F.col("season_year"), "round", _calendar_item()
        )
    raise KeyError(entity)
