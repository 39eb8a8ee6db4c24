"""Statistics with explicit sample-size rules, as aggregate expressions and frames.

Spread is taken from exact integer sums, so it does not depend on the order in
which partial results meet and a threshold test never turns on a last digit.
Quantiles are exact; their buffer holds distinct values, and all inputs are
positions, points or milliseconds, whose value range is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even
from gridlake.functions.scalars import evidence, raced_position_change, ratio_or_null
from gridlake.operators.common import RACE, sum_if
from gridlake.operators.season import DRIVER_SEASON, PAIR, TEAM_SEASON

FORM_WINDOW = 3
# Decimal digits kept exactly by the spread of points; times and positions are whole.
POINT_DIGITS = 2


def exact_stddev(value: Column, digits: int = 0) -> Column:
    """Sample standard deviation from integer sums; NULL below two values."""
    whole = (value * 10**digits).cast("bigint") if digits else value.cast("bigint")
    count = F.count(whole)
    squares = F.sum((whole * whole).cast("decimal(20,0)"))
    total = F.sum(whole).cast("decimal(19,0)")
    spread = count.cast("decimal(13,0)") * squares - total * total
    variance = spread.cast("double") / (count.cast("double") * (count - 1))
    return F.when(count >= 2, F.sqrt(variance) / float(10**digits))


def describe(value: Column, digits: int = 0) -> Column:
    """Aggregate: size, mean, median, spread, extremes and inclusive quartiles.

    NULLs are left out; zero and negative values count.  One value has a mean
    but neither spread nor quartiles.
    """
    x = value.cast("double")
    count = F.count(x)
    quartiles = F.percentile(x, [0.25, 0.5, 0.75])
    q1 = F.when(count >= 2, quartiles[0])
    q3 = F.when(count >= 2, quartiles[2])
    return F.struct(
        count.cast("int").alias("sample_size"),
        F.avg(x).alias("mean"),
        quartiles[1].alias("median"),
        exact_stddev(value, digits).alias("stddev"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
    )


def consistency(stats: Column, allow_cv: bool = False) -> Column:
    """Range, interquartile range and, for strictly positive measures, variation."""
    variation = F.when(stats["mean"] > 0, stats["stddev"] / stats["mean"]) if allow_cv else F.lit(None)
    return F.struct(
        stats.alias("stats"),
        (stats["maximum"] - stats["minimum"]).alias("range"),
        stats["iqr"].alias("iqr"),
        variation.cast("double").alias("coefficient_of_variation"),
    )


def quality(valid: Column) -> Column:
    """Aggregate: rows seen, rows with a value, rows without."""
    total, good = F.count(F.lit(1)), F.count(valid)
    return F.struct(
        total.alias("total_observations"),
        good.alias("valid_observations"),
        (total - good).alias("excluded_observations"),
    )


def distribution(change: Column) -> Column:
    """Aggregate: how often positions were gained, lost or kept, and at what rate."""
    count = F.count(change)
    kinds = (("positive", change > 0), ("negative", change < 0), ("zero", change == 0))
    return F.struct(
        count.cast("int").alias("sample_size"),
        *[sum_if(test).alias(f"{name}_count") for name, test in kinds],
        *[F.when(count > 0, sum_if(test) / count).alias(f"{name}_rate") for name, test in kinds],
    )


def position_change_summary(change: Column) -> Column:
    return F.struct(
        describe(change).alias("stats"),
        distribution(change).alias("distribution"),
        quality(change).alias("quality"),
    )


def timing_stats(rows: DataFrame, keys: list[str], value: str, fastest: str) -> DataFrame:
    """Statistics of a millisecond column per key, with its quality and its best value."""
    millis = F.col(value)
    return rows.groupBy(*keys).agg(
        describe(millis).alias("stats"), quality(millis).alias("quality"), F.min(millis).alias(fastest)
    )


def lap_time_stats(laps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return timing_stats(laps, keys or [*RACE, "driver_id"], "time_millis", "fastest_recorded_millis")


def pit_stop_stats(stops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return timing_stats(stops, keys or [*RACE, "driver_id"], "duration_millis", "fastest_duration_millis")


def _first_pair() -> list[Column]:
    """The pair of the earliest comparison stands for the team."""
    return [F.min_by(d, "round").alias(d) for d in ("driver_a_id", "driver_b_id")]


def qualifying_delta_stats(comparisons: DataFrame, constructor_id: str | None = None) -> DataFrame:
    """Qualifying gaps of each team's pair over a season."""
    if constructor_id is not None:
        comparisons = comparisons.where(F.col("constructor_id") == constructor_id)
    gap = F.col("delta_millis")
    return comparisons.groupBy(*TEAM_SEASON).agg(
        *_first_pair(), describe(gap).alias("stats"), quality(gap).alias("quality")
    )


def teammate_delta_stats(comparisons: DataFrame, constructor_id: str | None = None) -> DataFrame:
    """Qualifying, grid, finish and points gaps of each team's pair over a season."""
    if constructor_id is not None:
        comparisons = comparisons.where(F.col("constructor_id") == constructor_id)
    gaps = [F.col(c) for c in ("qualifying_delta_millis", "grid_delta", "finish_delta", "points_delta")]
    return comparisons.groupBy(*TEAM_SEASON).agg(
        *_first_pair(),
        describe(gaps[0]).alias("qualifying_delta"),
        describe(gaps[1]).alias("grid_delta"),
        describe(gaps[2]).alias("finish_delta"),
        describe(gaps[3], POINT_DIGITS).alias("points_delta"),
        quality(F.coalesce(*[g.cast("double") for g in gaps])).alias("quality"),
    )


def position_change_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Position changes per driver and season from ``grid_vs_finish`` rows."""
    return (
        rows.groupBy(*(keys or DRIVER_SEASON))
        .agg(position_change_summary(F.col("position_change")).alias("s"))
        .select(*(keys or DRIVER_SEASON), "s.*")
    )


def _points(rounds: Column) -> Column:
    entered = F.count(F.lit(1))
    started = (F.lower("status") != "did not start") & (F.lower("position_text") != "dns")
    starts = sum_if(started)
    race, sprint, total = (
        F.sum(c) for c in ("race_points", "sprint_points", "total_round_points")
    )
    return F.struct(
        total.alias("total_championship_points"),
        race.alias("total_race_points"),
        sprint.alias("total_sprint_points"),
        starts.alias("grand_prix_starts"),
        entered.cast("int").alias("rounds_entered"),
        ratio_or_null(race, starts, 4).alias("points_per_gp_start"),
        ratio_or_null(race, entered, 4).alias("points_per_gp_entry"),
        ratio_or_null(total, entered, 4).alias("points_per_round_total"),
        describe(F.col("race_points"), POINT_DIGITS).alias("race_points_stats"),
        describe(F.col("total_round_points"), POINT_DIGITS).alias("total_points_stats"),
        evidence(entered, entered, rounds).alias("evidence"),
    )


def driver_points_stats(rounds: DataFrame) -> DataFrame:
    """Points rates per driver and season from ``driver_rounds`` rows."""
    return (
        rounds.groupBy(*DRIVER_SEASON)
        .agg(_points(F.collect_list("round")).alias("p"))
        .select(*DRIVER_SEASON, "p.*")
    )


def driver_profiles(rounds: DataFrame) -> DataFrame:
    """Finish, grid, position change and points of a season, from one aggregation."""
    finish, grid = F.col("finish_position"), F.when(F.col("grid_position") > 0, F.col("grid_position"))
    change = raced_position_change(F.col("grid_position"), finish)
    listed = F.collect_list("round")
    entered = F.count(F.lit(1))
    stats = rounds.groupBy(*DRIVER_SEASON).agg(
        F.max("round").alias("up_to_round"),
        describe(finish).alias("finish_position"),
        describe(grid).alias("grid_position"),
        position_change_summary(change).alias("position_change"),
        _points(listed).alias("points"),
        evidence(entered, entered, listed).alias("evidence"),
    )
    return stats.select(
        *DRIVER_SEASON,
        "up_to_round",
        "finish_position",
        consistency(F.col("finish_position")).alias("finish_position_consistency"),
        "grid_position",
        consistency(F.col("grid_position")).alias("grid_position_consistency"),
        "position_change",
        consistency(F.col("position_change.stats")).alias("position_change_consistency"),
        "points",
        consistency(F.col("points.total_points_stats")).alias("points_consistency"),
        "evidence",
    )


_FORM_METRICS = (
    ("finish_position", "finish_position", 0),
    ("points", "total_round_points", POINT_DIGITS),
    ("position_change", "_change", 0),
)


# Figures of one window: ``v`` holds its values as whole numbers, ``s`` the same
# sorted.  A window has few values, so they are kept rather than summed anew.
_WINDOW_FIGURES = """
    v -> transform(array(array_sort(v)), s -> named_struct(
      'valid_observations', size(s),
      'mean', IF(size(s) = 0, NULL, aggregate(s, 0L, (total, x) -> total + x) / {unit}D / size(s)),
      'median', IF(size(s) = 0, NULL, (s[(size(s) - 1) div 2] + s[size(s) div 2]) / {unit}D / 2),
      'stddev', IF(size(s) < 2, NULL, sqrt(
        CAST(size(s) * aggregate(s, 0L, (total, x) -> total + x * x)
             - pow(aggregate(s, 0L, (total, x) -> total + x), 2) AS DOUBLE) / (size(s) * (size(s) - 1.0D))) / {unit}D),
      'minimum', array_min(s) / {unit}D,
      'maximum', array_max(s) / {unit}D))[0]"""


def rolling_window_stats(
    rows: DataFrame,
    entity: list[str],
    metrics: tuple[tuple[str, str, int], ...],
    window_size: int = FORM_WINDOW,
    min_observations: int = 1,
) -> DataFrame:
    """Trailing-window statistics per entity, round and metric.

    ``metrics`` lists (label, column, exact decimal digits).  The window counts
    rounds, not values: a missing value narrows the sample, it is not filled
    from an earlier round.  All metrics share one sort.
    """
    frame = Window.partitionBy(*entity).orderBy("round").rowsBetween(-(window_size - 1), Window.currentRow)
    values = [
        F.collect_list((F.col(column) * 10**digits).cast("bigint")).over(frame).alias(label)
        for label, column, digits in metrics
    ]
    wide = rows.select(*entity, "round", F.collect_list("round").over(frame).alias("rounds_included"), *values)
    parts = [
        F.struct(
            F.lit(label).alias("metric_name"),
            F.call_function(
                "transform", F.array(F.col(label)), F.expr(_WINDOW_FIGURES.format(unit=float(10**digits)))
            )[0].alias("f"),
        )
        for label, _, digits in metrics
    ]
    long = wide.select(*entity, "round", "rounds_included", F.inline(F.array(*parts))).select(
        *entity, "round", "rounds_included", "metric_name", "f.*"
    )
    enough = (F.col("valid_observations") >= min_observations) & (F.col("valid_observations") > 0)
    figures = ("mean", "median", "stddev", "minimum", "maximum")
    return long.select(
        *entity,
        "metric_name",
        F.lit(window_size).alias("window_size_requested"),
        "round",
        "rounds_included",
        "valid_observations",
        *[F.when(enough, round_half_even(F.col(f), 4)).alias(f) for f in figures],
        evidence(
            F.size("rounds_included"),
            F.col("valid_observations"),
            F.col("rounds_included"),
            min_observations,
            window_size,
        ).alias("evidence"),
    )


def rolling_form(rounds: DataFrame, window_size: int = FORM_WINDOW) -> DataFrame:
    """Rolling finish, points and position change per driver."""
    change = raced_position_change(F.col("grid_position"), F.col("finish_position"))
    return rolling_window_stats(rounds.withColumn("_change", change), DRIVER_SEASON, _FORM_METRICS, window_size)


def race_deltas(rounds: DataFrame) -> DataFrame:
    """Change of finish and of points from one entered race to the next."""
    order = Window.partitionBy(*DRIVER_SEASON).orderBy("round")

    def step(column: str) -> Column:
        return (F.col(column) - F.lag(column).over(order)).cast("double")

    steps = rounds.select(
        *DRIVER_SEASON,
        F.lag("round").over(order).alias("from_round"),
        F.col("round").alias("to_round"),
        F.array(
            F.struct(F.lit("finish_position").alias("metric_name"), step("finish_position").alias("delta")),
            F.struct(F.lit("points").alias("metric_name"), step("total_round_points").alias("delta")),
        ).alias("steps"),
    )
    return steps.where(F.col("from_round").isNotNull()).select(
        *DRIVER_SEASON, "from_round", "to_round", F.inline("steps")
    )


_STEPS = "array<struct<from_round:int,to_round:int,metric_name:string,delta:double>>"


def driver_form(rounds: DataFrame, window_size: int = FORM_WINDOW) -> DataFrame:
    """Rolling windows and race-to-race deltas nested per driver and season."""
    windows = rolling_form(rounds, window_size)
    window = F.struct(*[c for c in windows.columns if c not in DRIVER_SEASON])
    nested = windows.groupBy(*DRIVER_SEASON).agg(
        F.array_sort(F.collect_list(window)).alias("rolling_windows"),
        F.max("round").alias("up_to_round"),
        F.array_sort(F.collect_set("round")).alias("_rounds"),
    )
    step = F.struct("from_round", "to_round", "metric_name", "delta")
    deltas = race_deltas(rounds).groupBy(*DRIVER_SEASON).agg(
        F.array_sort(F.collect_list(step)).alias("race_to_race_deltas")
    )
    return nested.join(deltas, DRIVER_SEASON, "left").select(
        *DRIVER_SEASON,
        "up_to_round",
        "rolling_windows",
        F.coalesce("race_to_race_deltas", F.array().cast(_STEPS)).alias("race_to_race_deltas"),
        evidence(F.size("_rounds"), F.size("_rounds"), F.col("_rounds"), 1, window_size).alias("evidence"),
    )


def pairing_stats(events: DataFrame) -> DataFrame:
    """Head-to-head statistics per pair from ``teammate_events`` rows.

    A qualifying only counts here if both drivers also have a time, so wins
    and rates share one denominator.
    """
    timed = F.col("is_comparable_qualifying") & F.col("qualifying_delta_millis").isNotNull()
    both_finish = F.col("is_comparable_finish")
    first, second = F.col("driver_a_id"), F.col("driver_b_id")
    together = F.count(F.lit(1))
    round_total = [
        F.col(f"points_{side}") + F.col(f"sprint_points_{side}") for side in ("a", "b")
    ]
    qualifying_gap = F.when(timed, F.col("qualifying_delta_millis"))
    finish_gap = F.when(both_finish, F.col("finish_a") - F.col("finish_b"))
    points_gap = round_total[0] - round_total[1]

    def record(name: str, counted: Column, ahead: str) -> list[Column]:
        rounds = sum_if(counted)
        wins = [sum_if(counted & (F.col(ahead) == who)) for who in (first, second)]
        return [
            wins[0].alias(f"{name}_wins_a"),
            wins[1].alias(f"{name}_wins_b"),
            rounds.alias(f"{name}_comparable_rounds"),
            ratio_or_null(wins[0], rounds, 4).alias(f"{name}_win_rate_a"),
            ratio_or_null(wins[1], rounds, 4).alias(f"{name}_win_rate_b"),
            evidence(together, rounds, F.collect_list(F.when(counted, F.col("round")))).alias(f"{name}_evidence"),
        ]

    sums = events.groupBy(*PAIR).agg(
        together.cast("int").alias("rounds_together"),
        *record("qualifying", timed, "ahead_in_qualifying"),
        describe(qualifying_gap).alias("qualifying_delta_stats"),
        *record("race", both_finish, "ahead_in_race"),
        describe(finish_gap).alias("race_delta_stats"),
        *[
            F.sum(f"{kind}_{side}").alias(f"{kind}_{side}")
            for kind in ("points", "sprint_points")
            for side in ("a", "b")
        ],
        F.sum(round_total[0]).alias("total_points_a"),
        F.sum(round_total[1]).alias("total_points_b"),
        F.sum(points_gap).alias("points_difference"),
        describe(points_gap, POINT_DIGITS).alias("points_delta_stats"),
        evidence(together, together, F.collect_list("round")).alias("points_evidence"),
    )
    return sums.withColumn(
        "qualifying_delta_consistency", consistency(F.col("qualifying_delta_stats"))
    ).withColumn("race_delta_consistency", consistency(F.col("race_delta_stats")))

