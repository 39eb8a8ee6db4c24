"""Reliability and attrition per season phase and per round.

No cause is inferred; results are only counted by state.  A period whose
rounds are not all in the data is reported as incomplete, with NULL figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.scalars import (
    SEASON_PHASES,
    attrition_class_stored,
    full_name,
    rate_percent_or_null,
)
from gridlake.operators.common import RACE, constructor_names, driver_names, scoped, sum_if
from gridlake.operators.temporal import interval_join
from gridlake.tables import RaceTables

_COUNTS = (
    "entries",
    "starts",
    "classified_finishes",
    "dnf_results",
    "dns_results",
    "dsq_results",
    "unknown_non_classified",
)
METRICS = (*_COUNTS, "non_classified_results", "dnf_rate", "non_classification_rate")
KINDS = ("phase", "round")
PERIOD = ["season_year", "period_name", "start_round", "end_round"]


def completed_rounds(t: RaceTables, season: int | None = None, up_to_round: int | None = None) -> DataFrame:
    """Rounds of the calendar with at least one result."""
    return scoped(t.races, season, up_to_round=up_to_round).select(*RACE).join(
        t.race_results.select(*RACE), RACE, "left_semi"
    )


def _period(name: Column, start: Column, end: Column) -> Column:
    return F.struct(
        name.alias("period_name"), start.cast("int").alias("start_round"), end.cast("int").alias("end_round")
    )


def _phases() -> list[Column]:
    return [_period(F.lit(n), F.lit(a), F.lit(b)) for n, a, b in SEASON_PHASES]


def _single_round(number: Column) -> Column:
    return _period(F.format_string("R%02d", number), number, number)


def periods(
    t: RaceTables, season: int | None = None, up_to_round: int | None = None, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Every phase and every single round (as ``kinds`` says) of each season, with its completeness."""
    done = completed_rounds(t, season, up_to_round)
    seasons = done.groupBy("season_year").agg(
        (F.max("round") if up_to_round is None else F.lit(up_to_round)).cast("int").alias("up_to_round"),
        F.collect_set("round").alias("done"),
    )
    single = F.transform(F.sequence(F.lit(1), F.col("up_to_round")), _single_round)
    of_kind = {"phase": F.array(*_phases()), "round": single}
    listed = F.explode(F.concat(*[of_kind[k] for k in kinds])).alias("p")
    return seasons.select("season_year", "up_to_round", "done", listed).select(
        "season_year",
        "up_to_round",
        "p.*",
        (
            F.size(F.array_except(F.sequence("p.start_round", "p.end_round"), F.col("done"))) == 0
        ).alias("is_complete"),
    )


def _metrics() -> list[Column]:
    state = F.col("state")
    return [
        F.count(F.lit(1)).cast("int").alias("entries"),
        sum_if(state != "DNS").alias("starts"),
        sum_if(state == "CLASSIFIED").alias("classified_finishes"),
        sum_if(state == "DNF").alias("dnf_results"),
        sum_if(state == "DNS").alias("dns_results"),
        sum_if(state == "DSQ").alias("dsq_results"),
        sum_if(state == "UNKNOWN_NON_CLASSIFIED").alias("unknown_non_classified"),
    ]


def attrition(
    t: RaceTables, season: int | None = None, up_to_round: int | None = None, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Attrition by period at three levels: ``total``, ``constructor`` and ``driver``.

    A result belongs to its phase and to its own round, both of which follow
    from the round number, so no range join is needed.  Entities of incomplete
    periods are left out; the period itself keeps one ``total`` row of NULLs.
    """
    number = F.col("round")
    phase = F.filter(
        F.array(*_phases()), lambda p: number.between(p["start_round"], p["end_round"])
    )
    own = {"phase": phase, "round": F.array(_single_round(number))}
    results = scoped(t.race_results, season, up_to_round=up_to_round).select(
        "season_year",
        "driver_id",
        "constructor_id",
        attrition_class_stored(F.col("position_text"), F.col("status")).alias("state"),
        F.explode(F.concat(*[own[k] for k in kinds])).alias("p"),
    )
    counted = (
        results.select("season_year", "p.*", "driver_id", "constructor_id", "state")
        .groupingSets(
            [
                [*map(F.col, PERIOD)],
                [*map(F.col, PERIOD), F.col("constructor_id")],
                [*map(F.col, PERIOD), F.col("driver_id")],
            ],
            *PERIOD,
            "constructor_id",
            "driver_id",
        )
        .agg(*_metrics())
        .select(
            *PERIOD,
            F.when(F.col("driver_id").isNotNull(), "driver")
            .when(F.col("constructor_id").isNotNull(), "constructor")
            .otherwise("total")
            .alias("level"),
            F.coalesce("driver_id", "constructor_id").alias("entity_id"),
            *_COUNTS,
        )
    )
    lost = F.col("dnf_results") + F.col("dsq_results") + F.col("unknown_non_classified")
    rated = (
        counted.withColumn("non_classified_results", lost)
        .withColumn("dnf_rate", rate_percent_or_null(F.col("dnf_results"), F.col("starts")))
        .withColumn("non_classification_rate", rate_percent_or_null(lost, F.col("starts")))
    )
    every = periods(t, season, up_to_round, kinds)
    complete = every.where("is_complete").join(rated, PERIOD)
    # A single round without results and an unfinished phase have no figures.
    blank = every.where("NOT is_complete").select(
        "*",
        F.lit("total").alias("level"),
        F.lit(None).cast("string").alias("entity_id"),
        *[F.lit(None).cast(rated.schema[m].dataType).alias(m) for m in METRICS],
    )
    names = constructor_names(t).select(
        F.lit("constructor").alias("level"),
        F.col("constructor_id").alias("entity_id"),
        F.col("constructor_name").alias("entity_name"),
    ).unionByName(
        driver_names(t).select(
            F.lit("driver").alias("level"),
            F.col("driver_id").alias("entity_id"),
            F.trim(full_name(F.col("given_name"), F.col("family_name"))).alias("entity_name"),
        )
    )
    return (
        complete.unionByName(blank)
        .join(names, ["level", "entity_id"], "left")
        .select(
            "season_year", "up_to_round", *PERIOD[1:], "is_complete", "level", "entity_id", "entity_name", *METRICS
        )
    )


def attrition_over(t: RaceTables, periods: DataFrame) -> DataFrame:
    """Result counts of any table of periods: season_year, start_round, end_round and what else names them.

    Periods may overlap, repeat and be of any length; both ends belong to them.
    Every period keeps its row, with zeros where no result lies in it (also if
    a bound is null).  Results are counted per race and state before they meet
    the periods, so a period costs at most a row for each state and round.
    """
    counted = (
        t.race_results.select(*RACE, attrition_class_stored(F.col("position_text"), F.col("status")).alias("state"))
        .groupBy(*RACE, "state")
        .agg(F.count(F.lit(1)).alias("results"))
    )
    bounds = ["season_year", "start_round", "end_round"]
    met = interval_join(counted, periods.select(*bounds).distinct(), ["season_year"], "round", "start_round", "end_round")

    def of(*states: str) -> Column:
        return F.sum(F.when(F.col("state").isin(*states), F.col("results")).otherwise(0))

    totals = met.groupBy(*[F.col(c).alias(f"_{c}") for c in bounds]).agg(
        F.sum("results").alias("entries"),
        F.sum(F.when(F.col("state") != "DNS", F.col("results")).otherwise(0)).alias("starts"),
        of("CLASSIFIED").alias("classified_finishes"),
        of("DNF").alias("dnf_results"),
        of("DNS").alias("dns_results"),
        of("DSQ").alias("dsq_results"),
        of("UNKNOWN_NON_CLASSIFIED").alias("unknown_non_classified"),
    )
    same = [F.col(c) == F.col(f"_{c}") for c in bounds]
    return periods.join(totals, same, "left").select(
        *periods.columns, *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in _COUNTS]
    )


def attrition_report(t: RaceTables, season: int | None = None, up_to_round: int | None = None) -> DataFrame:
    """``attrition`` nested to one row per season and period."""
    metrics = F.struct(*METRICS)
    entity = F.struct("entity_id", F.struct("entity_id", "entity_name", metrics.alias("metrics")).alias("summary"))

    def entities(level: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("level") == level, entity)))

    return (
        attrition(t, season, up_to_round)
        .groupBy("season_year", "up_to_round", *PERIOD[1:], "is_complete")
        .agg(
            F.max(F.when(F.col("level") == "total", metrics)).alias("total"),
            entities("constructor").alias("constructors"),
            entities("driver").alias("drivers"),
        )
    )
