"""Pieces several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.scalars import full_name
from gridlake.tables import RaceTables

RACE = ["season_year", "round"]
# Names of up to this many drivers or teams are sent to every task.
BROADCAST_NAMES = 1_000_000


def scoped(
    rows: DataFrame,
    season: int | None = None,
    round: int | None = None,
    up_to_round: int | None = None,
    **equal: str | None,
) -> DataFrame:
    """Keep the requested season, round(s) and entities; Catalyst pushes this to the scan."""
    if season is not None:
        rows = rows.where(F.col("season_year") == season)
    if round is not None:
        rows = rows.where(F.col("round") == round)
    if up_to_round is not None:
        rows = rows.where(F.col("round") <= up_to_round)
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def _sent(tables: RaceTables, name: str, rows: DataFrame) -> DataFrame:
    """Names for every task, so that the facts they are joined to stay where they are; very many are shuffled."""
    return F.broadcast(rows) if tables.has_few(name, BROADCAST_NAMES) else rows


def driver_names(tables: RaceTables) -> DataFrame:
    return _sent(tables, "drivers", tables.drivers.select("driver_id", "given_name", "family_name"))


def driver_label(tables: RaceTables, key: str = "driver_id", name: str = "driver_name") -> DataFrame:
    label = full_name(F.col("given_name"), F.col("family_name")).alias(name)
    return _sent(tables, "drivers", tables.drivers.select(F.col("driver_id").alias(key), label))


def constructor_names(tables: RaceTables) -> DataFrame:
    return _sent(tables, "constructors", tables.constructors.select("constructor_id", F.col("name").alias("constructor_name")))


def race_details(tables: RaceTables) -> DataFrame:
    """Race name, circuit and date by race."""
    return tables.races.join(tables.circuits.select("circuit_id", "circuit_name"), "circuit_id").select(
        *RACE, "race_name", "circuit_name", "race_date"
    )


def first_two_by_driver(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The first two drivers of each group by id, as structs ``a`` and ``b``.

    Groups with a single driver drop out; a third driver and later ones are
    not compared.  Ranking and pairing use the same grouping, so there is one
    shuffle at most.
    """
    order = Window.partitionBy(*keys).orderBy("driver_id")
    driver = F.struct("driver_id", *values)

    def nth(n: int) -> Column:
        return F.max(F.when(F.col("_n") == n, driver))

    return (
        rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= 2)
        .groupBy(*keys)
        .agg(nth(1).alias("a"), nth(2).alias("b"))
        .where(F.col("b").isNotNull())
    )


def with_pair_names(pairs: DataFrame, tables: RaceTables) -> DataFrame:
    return (
        pairs.join(constructor_names(tables), "constructor_id")
        .join(driver_label(tables, "driver_a_id", "driver_a_name"), "driver_a_id")
        .join(driver_label(tables, "driver_b_id", "driver_b_name"), "driver_b_id")
    )


def delta(left: str, right: str) -> Column:
    return F.col(left) - F.col(right)


def sum_if(condition: Column) -> Column:
    """Count of rows where the condition holds; NULL counts as no."""
    return F.count(F.when(condition, 1)).cast("int")


def zero_points() -> Column:
    return F.lit(0).cast("decimal(5,2)")


# The order results are shown in, as SQL sort expressions.  A global sort is
# left to the caller because most jobs write partitioned output without one.
PRESENTATION_ORDER = {
    "races": ["season_year DESC", "round"],
    "race_results": ["source_position NULLS LAST"],
    "grid_vs_finish": ["finish_position NULLS LAST"],
    "qualifying_order": ["position"],
    "standings": ["position"],
    "driver_lap_times": ["fastest_lap_millis NULLS LAST"],
    "driver_pit_stops": ["stop_count DESC", "driver_id"],
    "constructor_pit_stops": ["constructor_id"],
    "teammate_qualifying": ["constructor_id"],
    "event_teammates": ["constructor_name"],
    "trajectory": ["round"],
    "driver_seasons": [
        "coalesce(championship_standing, 999)",
        "total_points DESC",
        "wins DESC",
        "coalesce(best_finish, 999)",
        "driver_id",
    ],
    "constructor_seasons": [
        "coalesce(championship_standing, 999)",
        "total_points DESC",
        "wins DESC",
        "constructor_name",
    ],
    "season_teammates": ["constructor_name", "driver_a_name"],
    "insights": ["category", "rule_id", "subject_id", "insight_id"],
}


def present(rows: DataFrame, what: str) -> DataFrame:
    """The rows in the order a reader expects for this kind of result."""
    return rows.sparkSession.sql(
        f"SELECT * FROM {{rows}} ORDER BY {', '.join(PRESENTATION_ORDER[what])}", rows=rows
    )
