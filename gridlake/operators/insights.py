"""Insight rules over metric frames.

Every evaluator reads its frame once: a row yields the array of insights it
fires, and the array is exploded.  Insight rows carry their audit trail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.rounding import fixed, percent_text, round_half_even
from gridlake.functions.scalars import round_span
from gridlake.operators import conversion, event, season, statistics
from gridlake.operators import rules as R
from gridlake.operators.common import RACE, first_two_by_driver, scoped, sum_if
from gridlake.operators.rules import get_rule
from gridlake.operators.season import DRIVER_SEASON, TEAM_SEASON
from gridlake.tables import RaceTables

SORT_ORDER = ["category", "rule_id", "subject_id", "insight_id"]


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _insight(
    rule_id: str,
    *,
    subject: Column,
    direction: str | Column,
    magnitude: Column,
    observed: Column,
    unit: str,
    size: Column,
    source: str,
    sign: str,
    other: Column | None = None,
    span: Column | None = None,
    metric: str | None = None,
    source_metric: str | None = None,
    other_in_id: Column | None = None,
    round_number: Column | None = None,
    driver: Column | None = None,
    constructor: Column | None = None,
    rounds: Column | None = None,
    excluded: Column | None = None,
    parameters: dict[str, float] | None = None,
    explanation: Column | None = None,
) -> Column:
    """One insight a row may fire: a constant part from the rule and a part from the row."""
    rule = get_rule(rule_id)
    settings = rule.thresholds if parameters is None else parameters
    entries = ", ".join(f"{_quoted(k)}, {float(v)}D" for k, v in settings.items())
    constant = {
        "rule_id": _quoted(rule_id),
        "category": _quoted(rule.category),
        "metric": _quoted(metric or rule.metric),
        "source_metric": _quoted(source_metric or rule.metric),
        "source_function": _quoted(source),
        "sign_convention": _quoted(sign),
        "unit": _quoted(unit),
        "minimum_sample_size": str(rule.min_sample_size),
        "rule_parameters": f"CAST(map({entries}) AS MAP<STRING, DOUBLE>)",
    }
    fields = ", ".join(f"{_quoted(name)}, {value}" for name, value in constant.items())

    def or_null(value: Column | None, kind: str) -> Column:
        return F.expr(f"CAST(NULL AS {kind})") if value is None else value.cast(kind)

    return F.struct(
        F.expr(f"named_struct({fields})").alias("rule"),
        subject.alias("subject"),
        or_null(other, "string").alias("other"),
        or_null(span, "string").alias("span"),
        or_null(other if other_in_id is None else other_in_id, "string").alias("other_in_id"),
        (F.lit(direction) if isinstance(direction, str) else direction).alias("direction"),
        magnitude.cast("double").alias("magnitude"),
        observed.cast("double").alias("observed"),
        size.cast("int").alias("size"),
        or_null(round_number, "int").alias("number"),
        or_null(driver, "string").alias("driver"),
        or_null(constructor, "string").alias("constructor"),
        or_null(rounds, "array<int>").alias("rounds"),
        or_null(excluded, "int").alias("excluded"),
        or_null(explanation, "string").alias("explanation"),
    )


# Fixed format: ``rule:season:span:subject:other``, where an absent season or
# span reads ``na`` and an absent other ``none``.
_ID = """
    concat_ws(':', rule.rule_id, coalesce(nullif(CAST(season_year AS STRING), '0'), 'na'),
              coalesce(nullif(span, '0'), 'na'), subject, coalesce(other_in_id, 'none'))"""
_STRENGTH = """
    CASE WHEN size < rule.minimum_sample_size OR size <= 0 THEN 'INSUFFICIENT' WHEN size = 1 THEN 'LOW'
         WHEN size <= 4 THEN 'MODERATE' ELSE 'HIGH' END"""
_TRACE = """
    struct(rule.source_metric AS source_metric, rule.source_function AS source_function, rule.rule_id AS rule_id,
           rule.rule_parameters AS rule_parameters, observed AS observed_value, rule.unit AS unit,
           size AS sample_size, rule.minimum_sample_size AS minimum_sample_size,
           rule.sign_convention AS sign_convention, CAST(season_year AS BIGINT) AS season_year, number AS round_num,
           driver AS driver_id, constructor AS constructor_id, rounds AS rounds_included,
           excluded AS excluded_observations)"""


def _fire(rows: DataFrame, candidates: list[tuple[Column, Column]], keep: list[str] | None = None) -> DataFrame:
    """The insights whose test holds, one row each."""
    fired = F.call_function(
        "filter", F.array(*[F.when(test, row) for test, row in candidates]), F.expr("i -> i IS NOT NULL")
    )
    return rows.select("season_year", *(keep or []), F.inline(fired)).selectExpr(
        *(keep or []),
        f"{_ID} AS insight_id",
        "rule.rule_id AS rule_id",
        "rule.category AS category",
        "subject AS subject_id",
        "other AS comparison_subject_id",
        "rule.metric AS metric",
        "direction",
        "magnitude",
        "rule.unit AS unit",
        f"{_STRENGTH} AS evidence_strength",
        "size AS sample_size",
        f"{_TRACE} AS traceability",
        "explanation",
    )


def _sentence(template: str, *values: Column) -> Column:
    return F.format_string(template, *[v.cast("string") for v in values])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def deduplicate(insights: DataFrame, sequence: str) -> DataFrame:
    """One row per insight id, the first by ``sequence``."""
    columns = [c for c in insights.columns if c != sequence]
    return (
        insights.groupBy("insight_id")
        .agg(F.min_by(F.struct(*columns), sequence).alias("i"))
        .select("i.*")
    )


# Race level ------------------------------------------------------------------


def _round_of(rows: DataFrame) -> Column:
    return F.col("round") if "round" in rows.columns else F.lit(None).cast("int")


def qualifying_gap_insights(rows: DataFrame, mean_of_season: bool = False) -> DataFrame:
    """Advantage, deficit or tie from single gaps, or from season means of ``qualifying_delta_stats``."""
    gap = F.col("stats.mean") if mean_of_season else F.col("delta_millis")
    size = F.col("stats.sample_size") if mean_of_season else F.when(gap.isNotNull(), 1).otherwise(0)
    number = _round_of(rows)

    def row(rule: str, direction: str) -> Column:
        return _insight(
            rule,
            subject=F.col("driver_a_id"),
            other=F.col("driver_b_id"),
            span=number,
            direction=direction,
            magnitude=F.abs(gap),
            observed=gap,
            unit="milliseconds",
            size=size,
            source="compute_qualifying_delta_stats" if mean_of_season else "get_teammate_qualifying_comparison",
            sign="delta = driver_a - driver_b; negative means driver_a was faster",
            round_number=number,
            driver=F.col("driver_a_id"),
            constructor=F.col("constructor_id"),
        )

    return _fire(
        rows,
        [
            (gap < 0, row("QUALIFYING_TEAMMATE_ADVANTAGE", "faster")),
            (gap > 0, row("QUALIFYING_TEAMMATE_DEFICIT", "slower")),
            (gap == 0, row("QUALIFYING_TEAMMATE_EQUAL", "equal")),
        ],
    )


def position_change_insights(rows: DataFrame) -> DataFrame:
    """Gain, loss or hold per result, and a second row for a large gain."""
    change = F.col("position_change")

    def row(rule: str, direction: str, sign: str) -> Column:
        return _insight(
            rule,
            subject=F.col("driver_id"),
            span=F.col("round"),
            direction=direction,
            magnitude=F.abs(change),
            observed=change,
            unit="positions",
            size=F.lit(1),
            source="get_grid_vs_finish",
            sign=sign,
            round_number=F.col("round"),
            driver=F.col("driver_id"),
        )

    sign = "position_change = grid_position - finish_position; positive means gained positions"
    return _fire(
        rows,
        [
            (change > 0, row("POSITION_GAIN", "gained", sign)),
            (change < 0, row("POSITION_LOSS", "lost", sign)),
            (change == 0, row("POSITION_MAINTAINED", "stable", sign)),
            (change >= R.LARGE_GAIN, row("LARGE_POSITION_GAIN", "gained", "position_change >= 5")),
        ],
    )


def multi_race_position_insights(stats: DataFrame) -> DataFrame:
    """Gain, loss or hold on average, from ``position_change_stats``."""
    mean = F.col("stats.mean")

    def row(rule: str, direction: str) -> Column:
        return _insight(
            rule,
            subject=F.col("driver_id"),
            span=F.lit("all"),
            direction=direction,
            magnitude=F.abs(mean),
            observed=mean,
            unit="positions",
            size=F.col("stats.sample_size"),
            source="compute_position_change_stats",
            sign="mean position change; positive means gained positions on average",
            metric="mean_position_change",
            source_metric="mean_position_change",
            driver=F.col("driver_id"),
        )

    return _fire(
        stats,
        [
            (mean > 0, row("POSITION_GAIN", "gained")),
            (mean < 0, row("POSITION_LOSS", "lost")),
            (mean == 0, row("POSITION_MAINTAINED", "stable")),
        ],
    )


def fastest_lap_insights(stats: DataFrame) -> DataFrame:
    """Fastest recorded lap per driver and race, from ``lap_time_stats``."""
    fastest = F.col("fastest_recorded_millis")
    row = _insight(
        "FASTEST_RECORDED_LAP",
        subject=F.col("driver_id"),
        span=F.col("round"),
        direction="faster",
        magnitude=fastest,
        observed=fastest,
        unit="milliseconds",
        size=F.lit(1),
        source="compute_lap_time_stats",
        sign="minimum recorded lap time in milliseconds",
        round_number=F.col("round"),
        driver=F.col("driver_id"),
    )
    return _fire(stats, [(fastest.isNotNull(), row)])


def race_pace_pairs(stats: DataFrame, results: DataFrame) -> DataFrame:
    """Lap statistics of each team's first two drivers side by side."""
    teams = results.select(*RACE, "driver_id", "constructor_id")
    timed = stats.select(
        *RACE, "driver_id", F.col("stats.mean").alias("mean"), F.col("stats.sample_size").alias("size")
    )
    return first_two_by_driver(
        timed.join(teams, [*RACE, "driver_id"]), [*RACE, "constructor_id"], ["mean", "size"]
    )


def race_pace_insights(pairs: DataFrame) -> DataFrame:
    """Which teammate had the lower mean lap, from ``race_pace_pairs``."""
    gap = F.col("a.mean") - F.col("b.mean")

    def row(rule: str, direction: str) -> Column:
        return _insight(
            rule,
            subject=F.col("a.driver_id"),
            other=F.col("b.driver_id"),
            span=F.col("round"),
            direction=direction,
            magnitude=F.abs(gap),
            observed=gap,
            unit="milliseconds",
            size=F.least("a.size", "b.size"),
            source="compute_lap_time_stats",
            sign="delta = mean_a - mean_b; negative means driver_a had faster average pace",
            source_metric="mean_lap_time_millis",
            round_number=F.col("round"),
            driver=F.col("a.driver_id"),
            constructor=F.col("constructor_id"),
        )

    return _fire(
        pairs,
        [
            (gap < 0, row("RACE_PACE_TEAMMATE_ADVANTAGE", "faster")),
            (gap > 0, row("RACE_PACE_TEAMMATE_DEFICIT", "slower")),
        ],
    )


def fast_pit_stop_insights(stops: DataFrame) -> DataFrame:
    """Stops under the threshold; a driver's first one in a race is kept."""
    millis = F.col("duration_millis")
    row = _insight(
        "FAST_PIT_STOP",
        subject=F.col("driver_id"),
        span=F.col("round"),
        direction="faster",
        magnitude=millis,
        observed=millis,
        unit="milliseconds",
        size=F.lit(1),
        source="compute_pit_stop_stats",
        sign="pit stop duration under 25000 ms",
        round_number=F.col("round"),
    )
    return deduplicate(_fire(stops, [(millis < R.FAST_STOP_MILLIS, row)], ["stop_number"]), "stop_number")


def pit_stop_variability_insights(stats: DataFrame) -> DataFrame:
    """Drivers whose stops in a race vary widely, from ``pit_stop_stats``."""
    spread = F.col("stats.stddev")
    number = _round_of(stats)
    row = _insight(
        "PIT_STOP_HIGH_VARIABILITY",
        subject=F.col("driver_id"),
        span=number,
        direction="higher",
        magnitude=spread,
        observed=spread,
        unit="milliseconds",
        size=F.col("stats.sample_size"),
        source="compute_pit_stop_stats",
        sign="sample standard deviation exceeds 1500 ms",
        round_number=number,
    )
    return _fire(stats, [(spread > R.STOP_SPREAD_MILLIS, row)])


def teammate_insights(rows: DataFrame, mean_of_season: bool = False) -> DataFrame:
    """Grid, finish and points gaps, each judged on its own.

    Reads single comparisons, or season means of ``teammate_delta_stats``.
    """
    number = _round_of(rows)

    def gap(name: str) -> Column:
        return (F.col(f"{name}.mean") if mean_of_season else F.col(name)).cast("double")

    def row(rule: str, name: str, direction: str, unit: str, sign: str) -> Column:
        return _insight(
            rule,
            subject=F.col("driver_a_id"),
            other=F.col("driver_b_id"),
            span=number,
            direction=direction,
            magnitude=F.abs(gap(name)),
            observed=gap(name),
            unit=unit,
            size=F.col("quality.valid_observations") if mean_of_season else F.lit(1),
            source="compute_teammate_head_to_head_stats" if mean_of_season else "get_teammate_comparison",
            sign=sign,
            round_number=number,
            driver=F.col("driver_a_id"),
            constructor=F.col("constructor_id"),
        )

    grid = "grid_a - grid_b; negative means driver_a started ahead on the grid"
    finish = "finish_a - finish_b; negative means driver_a finished ahead"
    points = "points_a - points_b; positive means driver_a scored more"
    return _fire(
        rows,
        [
            (gap("grid_delta") < 0, row("TEAMMATE_GRID_ADVANTAGE", "grid_delta", "higher", "positions", grid)),
            (
                gap("finish_delta") < 0,
                row("TEAMMATE_FINISH_ADVANTAGE", "finish_delta", "higher", "positions", finish),
            ),
            (gap("points_delta") > 0, row("TEAMMATE_POINTS_ADVANTAGE", "points_delta", "higher", "points", points)),
            (gap("points_delta") < 0, row("TEAMMATE_POINTS_DEFICIT", "points_delta", "lower", "points", points)),
        ],
    )


def race_insights(t: RaceTables, season_year: int | None = None, round_number: int | None = None) -> DataFrame:
    """All race-level insights the engine reports.

    Teammate rules only run for teams with two drivers in qualifying.  An id
    names rule, race and drivers, and each rule looks at a race's driver or pair
    once, so ids are unique without a shuffle by id.
    """
    times = [F.col(f"q{n}_time_millis") for n in (1, 2, 3)]
    qualified = scoped(t.qualifying_results, season_year, round_number).select(
        *RACE, "driver_id", "constructor_id", F.coalesce(*reversed(times)).alias("best")
    )
    pairs = first_two_by_driver(qualified, [*RACE, "constructor_id"], ["best"]).select(
        *RACE,
        "constructor_id",
        F.col("a.driver_id").alias("driver_a_id"),
        F.col("b.driver_id").alias("driver_b_id"),
        (F.col("a.best") - F.col("b.best")).alias("delta_millis"),
    )
    changes = scoped(t.race_results, season_year, round_number).select(
        *RACE, "driver_id", (F.col("grid_position") - F.col("source_position")).alias("position_change")
    )
    gaps = event.teammate_deltas(t, season_year, round_number).join(
        pairs.select(*RACE, "constructor_id"), [*RACE, "constructor_id"], "left_semi"
    )
    return _union([qualifying_gap_insights(pairs), position_change_insights(changes), teammate_insights(gaps)])


# Season level ----------------------------------------------------------------


def _driver_rule(
    rule: str,
    rounds: Column,
    direction: str,
    value: Column,
    unit: str,
    size: Column,
    sign: str,
    excluded: Column,
    explanation: Column,
    *,
    source: str = "compute_driver_longitudinal_stats",
    magnitude: Column | None = None,
    span: Column | None = None,
    round_number: Column | None = None,
) -> Column:
    return _insight(
        rule,
        subject=F.col("driver_id"),
        span=round_span(rounds, single=False, empty="all") if span is None else span,
        direction=direction,
        magnitude=value if magnitude is None else magnitude,
        observed=value,
        unit=unit,
        size=size,
        source=source,
        sign=sign,
        round_number=round_number,
        driver=F.col("driver_id"),
        rounds=rounds,
        excluded=excluded,
        explanation=explanation,
    )


def driver_longitudinal_insights(profiles: DataFrame, form: DataFrame | None = None) -> DataFrame:
    """Season insights per driver from ``driver_profiles`` and, if given, ``rolling_form`` rows."""
    if form is not None:
        windows = form.where(
            (F.col("metric_name") == "finish_position")
            & (F.col("window_size_requested") == R.FORM_WINDOW_SIZE)
        )
        latest = windows.groupBy(*DRIVER_SEASON).agg(
            F.max_by(
                F.struct("round", "mean", "valid_observations", F.array_sort("rounds_included").alias("rounds")),
                "round",
            ).alias("latest")
        )
        profiles = profiles.join(latest, DRIVER_SEASON, "left")
    year, driver = F.col("season_year"), F.col("driver_id")
    rounds = F.col("evidence.rounds_included")
    entered = F.col("evidence.total_races")
    grid, finish = F.col("grid_position"), F.col("finish_position")
    change, points = F.col("position_change"), F.col("points")
    mean_change = change["stats"]["mean"]
    change_size = change["quality"]["valid_observations"]
    starts, per_start = points["grand_prix_starts"], points["points_per_gp_start"]
    entries, per_round = points["rounds_entered"], points["points_per_round_total"]
    candidates = [
        (
            (grid["sample_size"] >= 3) & (grid["stddev"] <= R.GRID_SPREAD),
            _driver_rule(
                "LONGITUDINAL_QUALIFYING_CONSISTENCY",
                rounds,
                "stable",
                round_half_even(grid["stddev"], 3),
                "positions",
                grid["sample_size"],
                "lower standard deviation indicates higher grid position consistency",
                F.col("evidence.excluded_observations"),
                _sentence(
                    "Across %s qualifying sessions in %s, %s achieved high grid consistency with a standard "
                    "deviation of %s positions (mean grid P%s).",
                    grid["sample_size"], year, driver, fixed(grid["stddev"], 2), fixed(grid["mean"], 1),
                ),
            ),
        ),
        (
            (finish["sample_size"] >= 3) & (finish["stddev"] <= R.FINISH_SPREAD),
            _driver_rule(
                "LONGITUDINAL_FINISH_CONSISTENCY",
                rounds,
                "stable",
                round_half_even(finish["stddev"], 3),
                "positions",
                finish["sample_size"],
                "lower standard deviation indicates higher finish position consistency; DNFs excluded",
                entered - finish["sample_size"],
                _sentence(
                    "Across %s classified finishes in %s, %s achieved high finish consistency with a standard "
                    "deviation of %s positions (mean finish P%s).",
                    finish["sample_size"], year, driver, fixed(finish["stddev"], 2), fixed(finish["mean"], 1),
                ),
            ),
        ),
        *[
            (
                (change_size >= 3) & fires,
                _driver_rule(
                    rule,
                    rounds,
                    direction,
                    round_half_even(mean_change, 2),
                    "positions",
                    change_size,
                    f"{side} mean indicates positions {direction} from grid to finish",
                    change["quality"]["excluded_observations"],
                    _sentence(
                        f"Across %s valid races in %s, %s {direction} an average of %s positions from starting "
                        "grid to classified finish.",
                        change_size, year, driver, fixed(F.abs(mean_change), 1),
                    ),
                    magnitude=round_half_even(F.abs(mean_change), 2),
                ),
            )
            for rule, fires, direction, side in (
                ("LONGITUDINAL_POSITION_GAIN_PATTERN", mean_change >= R.MEAN_GAIN, "gained", "positive"),
                ("LONGITUDINAL_POSITION_LOSS_PATTERN", mean_change <= R.MEAN_LOSS, "lost", "negative"),
            )
        ],
        (
            (starts >= 3) & (per_start >= R.POINTS_PER_START),
            _driver_rule(
                "LONGITUDINAL_POINTS_PER_START",
                rounds,
                "higher",
                round_half_even(per_start, 2),
                "points",
                starts,
                "total_race_points / grand_prix_starts; sprint points excluded",
                entered - starts,
                _sentence(
                    "Across %s Grand Prix starts in %s, %s scored %s race points, averaging %s points per start "
                    "(excluding sprint sessions).",
                    starts, year, driver, points["total_race_points"], fixed(per_start, 2),
                ),
                source="compute_driver_points_stats",
            ),
        ),
        (
            (entries >= 3) & (per_round >= R.POINTS_PER_ROUND),
            _driver_rule(
                "LONGITUDINAL_POINTS_PER_ROUND",
                rounds,
                "higher",
                round_half_even(per_round, 2),
                "points",
                entries,
                "total_championship_points / rounds_entered; includes sprint and race points",
                F.lit(0),
                _sentence(
                    "Across %s championship rounds in %s, %s scored %s total points (%s race, %s sprint), "
                    "averaging %s points per round.",
                    entries, year, driver, points["total_championship_points"], points["total_race_points"],
                    points["total_sprint_points"], fixed(per_round, 2),
                ),
                source="compute_driver_points_stats",
            ),
        ),
    ]
    if form is not None:
        last = F.col("latest")
        counted = last["valid_observations"]
        lost = F.size(last["rounds"]) - counted
        note = F.when(lost == 1, _sentence(" (%s DNF excluded)", lost)).when(
            lost > 1, _sentence(" (%s DNFs excluded)", lost)
        )
        candidates.append(
            (
                (counted >= 2) & (last["mean"] <= R.FORM_FINISH),
                _driver_rule(
                    "LONGITUDINAL_RECENT_FORM",
                    last["rounds"],
                    "higher",
                    round_half_even(last["mean"], 2),
                    "positions",
                    counted,
                    "mean finishing position over trailing window; DNFs excluded",
                    lost,
                    F.concat(
                        _sentence(
                            f"Over the most recent {R.FORM_WINDOW_SIZE} rounds (R%s-R%s), %s recorded an average "
                            "finish of P%s across %s valid finishes",
                            F.array_min(last["rounds"]), F.array_max(last["rounds"]), driver,
                            fixed(last["mean"], 1), counted,
                        ),
                        F.coalesce(note, F.lit("")),
                        F.lit("."),
                    ),
                    source="compute_rolling_window_stats",
                    span=_sentence(f"w{R.FORM_WINDOW_SIZE}_r%s", last["round"]),
                    round_number=last["round"],
                ),
            )
        )
    return _fire(profiles, candidates)


def teammate_longitudinal_insights(pairings: DataFrame) -> DataFrame:
    """Qualifying, race and points dominance per pair, from ``pairing_stats``."""
    year, team = F.col("season_year"), F.col("constructor_id")
    a, b = F.col("driver_a_id"), F.col("driver_b_id")

    def pair_rule(
        rule: str, winner: Column, loser: Column, direction: str, value: Column, unit: str, size: Column,
        sign: str, rounds: Column, excluded: Column, explanation: Column,
    ) -> Column:
        return _insight(
            rule,
            subject=winner,
            other=loser,
            span=team,
            direction=direction,
            magnitude=value,
            observed=value,
            unit=unit,
            size=size,
            source="compute_longitudinal_teammate_h2h_stats",
            sign=sign,
            driver=winner,
            constructor=team,
            rounds=rounds,
            excluded=excluded,
            explanation=explanation,
        )

    def record(kind: str, rule: str, direction: str, sign: str, what: str, verb: str, tail: Column) -> list:
        size = F.col(f"{kind}_comparable_rounds")
        rates = [F.col(f"{kind}_win_rate_{s}") for s in ("a", "b")]
        wins = [F.col(f"{kind}_wins_{s}") for s in ("a", "b")]
        a_leads = F.coalesce(rates[0] >= R.WIN_RATE, F.lit(False))

        def row(rate: Column, won: Column, lost: Column, winner: Column, loser: Column) -> Column:
            text = F.concat(
                _sentence(
                    f"Across %s comparable {what} for %s in %s, %s {verb} %s %s-%s (%s)",
                    size, team, year, winner, loser, won, lost, percent_text(rate),
                ),
                tail,
                F.lit("."),
            )
            return pair_rule(
                rule, winner, loser, direction, round_half_even(rate, 3), "win_rate", size, sign,
                F.col(f"{kind}_evidence.rounds_included"), F.col("rounds_together") - size, text,
            )

        return [
            ((size >= 3) & a_leads, row(rates[0], wins[0], wins[1], a, b)),
            ((size >= 3) & ~a_leads & (rates[1] >= R.WIN_RATE), row(rates[1], wins[1], wins[0], b, a)),
        ]

    mean_gap = F.abs(F.col("qualifying_delta_stats.mean"))
    gap_text = F.coalesce(_sentence(" with an average delta of %s ms", fixed(mean_gap, 1)), F.lit(""))
    gap_tail = F.when(mean_gap.isNotNull(), gap_text).otherwise("")
    difference = F.col("points_difference").cast("double")
    together = F.col("rounds_together")

    def outscored(winner: Column, loser: Column, w: str, l: str) -> Column:
        text = _sentence(
            "Across %s rounds together for %s in %s, %s scored %s points vs %s %s points (differential: +%s points; "
            "race: %s vs %s, sprint: %s vs %s).",
            together, team, year, winner, F.col(f"total_points_{w}"), loser, F.col(f"total_points_{l}"),
            fixed(F.abs(difference), 1), F.col(f"points_{w}"), F.col(f"points_{l}"),
            F.col(f"sprint_points_{w}"), F.col(f"sprint_points_{l}"),
        )
        return pair_rule(
            "LONGITUDINAL_TEAMMATE_POINTS_H2H", winner, loser, "higher", round_half_even(F.abs(difference), 2),
            "points", together, "total_points_winner - total_points_loser; includes sprint points",
            F.col("points_evidence.rounds_included"), F.lit(0), text,
        )

    return _fire(
        pairings,
        [
            *record(
                "qualifying",
                "LONGITUDINAL_TEAMMATE_QUALIFYING_H2H",
                "faster",
                "qualifying_wins / comparable_qualifying_rounds",
                "qualifying sessions",
                "out-qualified",
                gap_tail,
            ),
            *record(
                "race",
                "LONGITUDINAL_TEAMMATE_RACE_H2H",
                "higher",
                "race_wins / comparable_finish_rounds; both cars classified",
                "two-car finishes",
                "finished ahead of",
                F.lit(""),
            ),
            ((together >= 3) & (difference >= R.POINTS_GAP), outscored(a, b, "a", "b")),
            ((together >= 3) & (difference <= -R.POINTS_GAP), outscored(b, a, "b", "a")),
        ],
    )


def constructor_longitudinal_insights(rounds: DataFrame) -> DataFrame:
    """Podium rate per team, from ``constructor_rounds`` rows."""
    totals = rounds.groupBy(*TEAM_SEASON).agg(
        F.count(F.lit(1)).alias("n"),
        sum_if(F.col("podiums") > 0).alias("podium_rounds"),
        F.sum("total_round_points").alias("points"),
        F.array_sort(F.collect_list("round")).alias("rounds"),
    )
    n, won = F.col("n"), F.col("podium_rounds")
    rate = won / n
    year, team = F.col("season_year"), F.col("constructor_id")
    row = _insight(
        "LONGITUDINAL_CONSTRUCTOR_PODIUM_RATE",
        subject=team,
        span=round_span(F.col("rounds"), single=False, empty="all"),
        direction="higher",
        magnitude=round_half_even(rate, 3),
        observed=round_half_even(rate, 3),
        unit="rate",
        size=n,
        source="get_constructor_trajectory",
        sign="podium_rounds / rounds_entered",
        constructor=team,
        rounds=F.col("rounds"),
        excluded=F.lit(0),
        explanation=_sentence(
            "Across %s rounds in %s, %s achieved podium finishes in %s rounds (%s), accumulating %s championship "
            "points.",
            n, year, team, won, percent_text(rate), F.col("points"),
        ),
    )
    return _fire(totals, [((n >= 3) & (rate >= R.PODIUM_RATE), row)])


def driver_season_insights(
    t: RaceTables, season_year: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    rounds = season.driver_rounds(t, season_year, driver_id, up_to_round)
    finishes = statistics.rolling_window_stats(
        rounds, DRIVER_SEASON, (("finish_position", "finish_position", 0),), R.FORM_WINDOW_SIZE
    )
    return driver_longitudinal_insights(statistics.driver_profiles(rounds), finishes)


def constructor_season_insights(
    t: RaceTables, season_year: int | None = None, constructor_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    return constructor_longitudinal_insights(
        season.constructor_rounds(t, season_year, constructor_id, up_to_round)
    )


def pair_season_insights(
    t: RaceTables,
    season_year: int | None = None,
    drivers: tuple[str, str] | None = None,
    up_to_round: int | None = None,
) -> DataFrame:
    """Pair insights; the two drivers may be named in either order."""
    events = event.teammate_events(t, season_year, up_to_round=up_to_round)
    if drivers is not None:
        first, second = sorted(drivers)
        events = events.where((F.col("driver_a_id") == first) & (F.col("driver_b_id") == second))
    return teammate_longitudinal_insights(statistics.pairing_stats(events))


def season_insights(t: RaceTables, season_year: int | None = None, up_to_round: int | None = None) -> DataFrame:
    """Season insights of all drivers, pairs and teams; their ids are unique as in ``race_insights``."""
    return _union(
        [
            driver_season_insights(t, season_year, up_to_round=up_to_round),
            pair_season_insights(t, season_year, up_to_round=up_to_round),
            constructor_season_insights(t, season_year, up_to_round=up_to_round),
        ]
    )


def longitudinal_insights(
    t: RaceTables,
    season_year: int | None = None,
    up_to_round: int | None = None,
    driver_id: str | None = None,
    constructor_id: str | None = None,
    drivers: tuple[str, str] | None = None,
) -> DataFrame:
    """Season insights for a pair, else a driver, else a team, else everyone."""
    if drivers is not None:
        return pair_season_insights(t, season_year, drivers, up_to_round)
    if driver_id is not None:
        return driver_season_insights(t, season_year, driver_id, up_to_round)
    if constructor_id is not None:
        return constructor_season_insights(t, season_year, constructor_id, up_to_round)
    return season_insights(t, season_year, up_to_round)


# Conversion ------------------------------------------------------------------


def conversion_rule_insights(stats: DataFrame) -> DataFrame:
    """Pole, front-row, tier and top-ten insights from ``driver_conversion_stats``."""
    year, driver, rounds = F.col("season_year"), F.col("driver_id"), F.col("rounds_included")
    span = round_span(rounds, single=True, empty="none")

    def row(
        rule: str, value: Column, direction: str | Column, size: Column, unit: str, source: str, sign: str,
        excluded: Column, explanation: Column, other: str | None = None, magnitude: Column | None = None,
    ) -> Column:
        definition = get_rule(rule)
        return _insight(
            rule,
            subject=driver,
            span=span,
            other_in_id=F.lit(other),
            direction=direction,
            magnitude=value if magnitude is None else magnitude,
            observed=value,
            unit=unit,
            size=size,
            source=source,
            sign=sign,
            driver=driver,
            constructor=F.col("constructor_id"),
            rounds=rounds,
            excluded=excluded,
            parameters={**definition.thresholds, "min_sample_size": float(definition.min_sample_size)},
            explanation=explanation,
        )

    percent = "Percentage between 0.0% and 100.0%"
    places = "Positive means positions gained; negative means positions lost"

    def share(rule: str, struct: str, starts: str, kept: str, rate: str, template: str, source: str, direction):
        figure = F.col(struct)
        value = figure[rate]
        text = _sentence(template, figure[starts], year, driver, figure[kept], fixed(value, 1))
        made = row(
            rule, value, direction(value), figure[starts], "percentage", source, percent,
            figure["evidence"]["excluded_observations"], text,
        )
        return figure, value, made

    def even(value: Column) -> Column:
        return F.when(value >= R.EVEN_RATE, "higher").otherwise("lower")

    pole, _, pole_row = share(
        "POLE_TO_WIN_CONVERSION", "pole_to_win", "total_poles", "wins_from_pole", "conversion_rate",
        "Across %s pole starts in %s, %s converted %s into Grand Prix wins (%s%% conversion rate).",
        "compute_pole_to_win_stats", even,
    )
    front, _, front_row = share(
        "FRONT_ROW_PODIUM_RETENTION", "front_row", "front_row_starts", "front_row_podiums", "retention_rate",
        "Across %s front-row starts in %s, %s retained %s as podium finishes (%s%% podium retention rate).",
        "compute_front_row_stats", even,
    )
    top, top_rate, top_row = share(
        "TOP10_CONVERSION_HIGH", "top10_conversion", "top10_starts", "top10_conversions", "conversion_rate",
        "Across %s top-10 grid starts in %s, %s converted %s into classified top-10 finishes (%s%% conversion rate).",
        "compute_top10_conversion_stats", lambda value: "higher",
    )

    def tier(rule: str, name: str, direction: str, lead: str, verb: str) -> tuple[Column, Column]:
        figure = F.col("grid_tiers")[name]
        value = figure["avg_position_delta"]
        text = _sentence(
            f"When starting from the {lead} across %s races in %s, %s {verb} of %s positions across %s classified "
            "finishes (net %s positions).",
            figure["eligible_starts"], year, driver, fixed(value, 2, sign=True), figure["classified_finishes"],
            F.format_string("%+d", figure["total_positions_gained"]),
        )
        return figure, row(
            rule, value, direction, figure["eligible_starts"], "positions", "compute_grid_tier_stats", places,
            figure["non_classified_results"], text, other=name, magnitude=F.abs(value),
        )

    front_tier, loss_row = tier(
        "GRID_TIER_POSITION_LOSS", "front", "lost", "front tier (P1-P4)", "experienced an average position change"
    )
    lower_tier, gain_row = tier(
        "GRID_TIER_POSITION_GAIN", "lower", "gained", "lower tier (P11-P20)", "achieved an average position gain"
    )

    def available(figure: Column) -> Column:
        return figure["evidence"]["is_available"]

    return _fire(
        stats,
        [
            (available(pole), pole_row),
            (available(front), front_row),
            (available(front_tier) & (front_tier["avg_position_delta"] <= R.FRONT_TIER_LOSS), loss_row),
            (available(lower_tier) & (lower_tier["avg_position_delta"] >= R.LOWER_TIER_GAIN), gain_row),
            (available(top) & (top_rate >= R.TOP_TEN_RATE), top_row),
        ],
    )


def conversion_insights(
    t: RaceTables, season_year: int | None = None, driver_id: str | None = None, up_to_round: int | None = None
) -> DataFrame:
    """Conversion insights of one driver or of all active drivers."""
    profile = conversion.driver_conversion(t, season_year, driver_id, up_to_round, active_only=driver_id is None)
    return conversion_rule_insights(conversion.driver_conversion_stats(profile))


# Selection -------------------------------------------------------------------


def for_entities(
    insights: DataFrame, driver_id: str | None = None, constructor_id: str | None = None
) -> DataFrame:
    """Insights about a driver (as subject or comparison) and a team (as subject or in the trail)."""
    if driver_id is not None:
        insights = insights.where(
            (F.col("subject_id") == driver_id)
            | F.coalesce(F.col("comparison_subject_id") == driver_id, F.lit(False))
        )
    if constructor_id is not None:
        insights = insights.where(
            (F.col("subject_id") == constructor_id)
            | F.coalesce(F.col("traceability.constructor_id") == constructor_id, F.lit(False))
        )
    return insights


def scope_insights(
    t: RaceTables,
    scope: str,
    season_year: int | None = None,
    round_number: int | None = None,
    up_to_round: int | None = None,
    driver_id: str | None = None,
    constructor_id: str | None = None,
    drivers: tuple[str, str] | None = None,
) -> DataFrame:
    """Race insights, season insights, or (``mixed``) both one after the other."""
    if scope not in ("race", "longitudinal", "mixed"):
        raise ValueError(f"unknown scope '{scope}'")

    def race() -> DataFrame:
        return for_entities(race_insights(t, season_year, round_number), driver_id, constructor_id)

    def longitudinal() -> DataFrame:
        return longitudinal_insights(t, season_year, up_to_round, driver_id, constructor_id, drivers)

    if scope == "race":
        return race()
    if scope == "longitudinal":
        return longitudinal()
    return race().unionByName(longitudinal())


def counts_by_rule(insights: DataFrame) -> DataFrame:
    return insights.groupBy("rule_id").agg(F.count(F.lit(1)).alias("insights"))
