"""What drivers make of their grid: poles to wins, front rows to podiums, tiers.

Pole and front row follow the qualifying classification, tiers and top ten the
actual grid.  A car that did not start counts as neither; a pit-lane start is
counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even
from gridlake.functions.scalars import (
    GRID_TIERS,
    evidence,
    is_actual_start,
    is_classified,
    rate_percent,
)
from gridlake.operators.common import RACE, constructor_names, driver_label, scoped, sum_if
from gridlake.operators.season import DRIVER_SEASON
from gridlake.tables import RaceTables

# Observations a conversion figure needs ----------------------
POLE_MINIMUM = 3
FRONT_ROW_MINIMUM = 3
GRID_TIER_MINIMUM = 5
TOP_TEN_MINIMUM = 5
# ---------------------------------------------------------------------------


def _weekends(
    t: RaceTables, season: int | None, driver_id: str | None, up_to_round: int | None
) -> DataFrame:
    """Qualifying and race of a driver side by side, either of which may be missing."""
    key = [*RACE, "driver_id"]
    qualifying = scoped(t.qualifying_results, season, up_to_round=up_to_round, driver_id=driver_id).select(
        *key, F.col("position").alias("qualified")
    )
    results = scoped(t.race_results, season, up_to_round=up_to_round, driver_id=driver_id).select(
        *key,
        "constructor_id",
        "grid_position",
        F.when(is_classified(F.col("position_text"), F.col("status")), F.col("source_position")).alias("finish"),
        is_actual_start(F.col("status"), F.col("position_text")).alias("started"),
    )
    both = results.join(qualifying, key, "full_outer")
    return both.join(t.races.select(*RACE), RACE, "left_semi")


def _tier_sums(name: str, low: int, high: int, from_grid: Column) -> list[Column]:
    grid, finish = F.col("grid_position"), F.col("finish")
    inside = from_grid & grid.between(low, high)
    return [
        sum_if(inside).alias(f"{name}_starts"),
        sum_if(inside & finish.isNotNull()).alias(f"{name}_finishes"),
        F.coalesce(F.sum(F.when(inside, grid - finish)), F.lit(0)).cast("int").alias(f"{name}_gained"),
    ]


def conversion_counts(
    t: RaceTables, season: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """All conversion counts per driver and season, from one aggregation."""
    grid, finish, qualified = F.col("grid_position"), F.col("finish"), F.col("qualified")
    started = F.coalesce("started", F.lit(False))
    from_grid = started & (grid > 0)
    front_row = started & qualified.isin(1, 2)
    return (
        _weekends(t, season, driver_id, up_to_round)
        .groupBy(*DRIVER_SEASON)
        .agg(
            F.max_by("constructor_id", F.when(F.col("constructor_id").isNotNull(), F.col("round"))).alias(
                "constructor_id"
            ),
            F.count("started").alias("race_results"),
            sum_if(qualified == 1).alias("total_poles"),
            sum_if(started & (qualified == 1) & (finish == 1)).alias("wins_from_pole"),
            sum_if(front_row).alias("front_row_starts"),
            sum_if(front_row & (finish <= 3)).alias("front_row_podiums"),
            sum_if(from_grid & (grid <= 10)).alias("top10_starts"),
            sum_if(from_grid & (grid <= 10) & finish.between(1, 10)).alias("top10_conversions"),
            *[c for tier in GRID_TIERS for c in _tier_sums(*tier, from_grid)],
            F.array_sort(F.collect_set("round")).alias("rounds_included"),
            sum_if(started & (grid.isNull() | (grid <= 0))).alias("pit_lane_starts_count"),
            sum_if(~started).alias("dns_count"),
        )
    )


def _tier(name: str, low: int, high: int) -> Column:
    starts, finishes, gained = (F.col(f"{name}_{part}") for part in ("starts", "finishes", "gained"))
    return F.struct(
        F.lit(name).alias("tier_name"),
        F.lit(low).alias("min_grid"),
        F.lit(high).alias("max_grid"),
        starts.alias("eligible_starts"),
        finishes.alias("classified_finishes"),
        (starts - finishes).alias("non_classified_results"),
        gained.alias("total_positions_gained"),
        F.when(finishes > 0, round_half_even(gained.cast("double") / finishes, 4)).alias("avg_position_delta"),
    )


def _with_names(counts: DataFrame, t: RaceTables) -> DataFrame:
    return counts.join(driver_label(t), "driver_id").join(constructor_names(t), "constructor_id", "left")


def driver_conversion(
    t: RaceTables,
    season: int | None = None,
    driver_id: str | None = None,
    up_to_round: int | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Conversion profile per driver and season.

    ``active_only`` keeps drivers with at least one race result.
    """
    counts = conversion_counts(t, season, driver_id, up_to_round)
    if active_only:
        counts = counts.where(F.col("race_results") > 0)
    poles, fronts, top = F.col("total_poles"), F.col("front_row_starts"), F.col("top10_starts")
    return _with_names(counts, t).select(
        "season_year",
        "driver_id",
        F.trim("driver_name").alias("driver_name"),
        "constructor_id",
        "constructor_name",
        F.struct(
            "total_poles",
            "wins_from_pole",
            rate_percent(F.col("wins_from_pole"), poles).alias("pole_to_win_rate"),
        ).alias("pole_to_win"),
        F.struct(
            "front_row_starts",
            "front_row_podiums",
            rate_percent(F.col("front_row_podiums"), fronts).alias("front_row_podium_rate"),
        ).alias("front_row"),
        F.struct(
            "top10_starts",
            "top10_conversions",
            rate_percent(F.col("top10_conversions"), top).alias("top10_conversion_rate"),
        ).alias("top10_conversion"),
        F.create_map(*[c for tier in GRID_TIERS for c in (F.lit(tier[0]), _tier(*tier))]).alias("grid_tiers"),
        "rounds_included",
        "pit_lane_starts_count",
        "dns_count",
    )


def grid_tier_rows(conversion: DataFrame) -> DataFrame:
    """The tier map of ``driver_conversion`` as one row per driver and tier."""
    return conversion.select(
        "season_year", "driver_id", F.inline(F.map_values("grid_tiers"))
    )


def driver_conversion_stats(conversion: DataFrame) -> DataFrame:
    """Conversion profile with an evidence record for every figure."""
    rounds, dns = F.col("rounds_included"), F.col("dns_count")
    total = F.size(rounds)

    def with_evidence(struct: str, rate: str, new_rate: str, starts: str, needed: int, spare: Column) -> Column:
        valid = F.col(f"{struct}.{starts}")
        left_out = F.greatest(F.lit(0), total - valid + spare)
        figure = F.col(struct)
        kept = [f for f in conversion.schema[struct].dataType.fieldNames() if f != rate]
        return F.struct(
            *[figure[f].alias(f) for f in kept],
            figure[rate].alias(new_rate),
            evidence(total, valid, rounds, needed, excluded=left_out).alias("evidence"),
        ).alias(struct)

    tiers = F.transform_values(
        "grid_tiers",
        lambda _, tier: tier.withField(
            "evidence",
            evidence(
                total, tier["eligible_starts"], rounds, GRID_TIER_MINIMUM, excluded=tier["non_classified_results"]
            ),
        ),
    )
    none = F.lit(0)
    return conversion.select(
        "season_year",
        "driver_id",
        "driver_name",
        "constructor_id",
        "constructor_name",
        with_evidence("pole_to_win", "pole_to_win_rate", "conversion_rate", "total_poles", POLE_MINIMUM, none),
        with_evidence(
            "front_row", "front_row_podium_rate", "retention_rate", "front_row_starts", FRONT_ROW_MINIMUM, dns
        ),
        with_evidence(
            "top10_conversion", "top10_conversion_rate", "conversion_rate", "top10_starts", TOP_TEN_MINIMUM, dns
        ),
        tiers.alias("grid_tiers"),
        "rounds_included",
        "pit_lane_starts_count",
        "dns_count",
    )
