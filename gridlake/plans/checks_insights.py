"""SQL for the insight rules, written out rule by rule."""

from __future__ import annotations

from gridlake.operators.rules import REGISTRY
from gridlake.plans.checks_stats import strength
from gridlake.plans.oracle import cte, half_even, query


def _text(value: str | None) -> str:
    return f"CAST({value or 'NULL'} AS VARCHAR)"


def row(
    rule: str,
    source: str,
    where: str,
    *,
    subject: str,
    direction: str,
    observed: str,
    unit: str,
    size: str,
    function: str,
    sign: str,
    magnitude: str | None = None,
    other: str | None = None,
    span: str = "'na'",
    identity: str | None = None,
    metric: str | None = None,
    source_metric: str | None = None,
    number: str = "NULL",
    driver: str | None = None,
    constructor: str | None = None,
    rounds: str | None = None,
    excluded: str = "NULL",
    parameters: dict | None = None,
    explanation: str | None = None,
) -> str:
    """One SELECT that yields the insights of one rule, in the flat layout."""
    meta = REGISTRY[rule]
    settings = meta.thresholds if parameters is None else parameters
    shown = ",".join(f"{k}={float(v)}" for k, v in sorted(settings.items()))
    identity = identity or (
        f"'{rule}:' || season_year || ':' || {span} || ':' || {subject} || ':' || coalesce({_text(other)}, 'none')"
    )
    n = f"CAST({size} AS BIGINT)"
    return f"""
      SELECT {identity} AS insight_id, '{rule}' AS rule_id, '{meta.category}' AS category, {subject} AS subject_id,
        {_text(other)} AS comparison_subject_id, '{metric or meta.metric}' AS metric, {direction} AS direction,
        round(CAST({magnitude or f'abs({observed})'} AS DOUBLE), 6) AS magnitude, '{unit}' AS unit,
        {strength(n, meta.min_sample_size)} AS evidence_strength, {n} AS sample_size,
        '{source_metric or meta.metric}' AS source_metric, '{function}' AS source_function,
        '{shown}' AS rule_parameters, round(CAST({observed} AS DOUBLE), 6) AS observed_value,
        {meta.min_sample_size} AS minimum_sample_size, '{sign}' AS sign_convention, season_year,
        CAST({number} AS BIGINT) AS round_num, {_text(driver)} AS driver_id, {_text(constructor)} AS constructor_id,
        {_text(rounds)} AS rounds_included, CAST({excluded} AS BIGINT) AS excluded_observations,
        {_text(explanation)} AS explanation
      FROM {source} WHERE {where}"""


def union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


_ROUND = "CAST(round AS VARCHAR)"


def _gap(rule: str, test: str, direction: str, source: str = "teammate_qualifying_t", mean: bool = False) -> str:
    value = "mean_delta" if mean else "delta_millis"
    return row(
        rule,
        source,
        f"{value} {test} 0",
        subject="driver_a_id",
        other="driver_b_id",
        span="'na'" if mean else _ROUND,
        direction=f"'{direction}'",
        observed=value,
        unit="milliseconds",
        size="n" if mean else "1",
        function="compute_qualifying_delta_stats" if mean else "get_teammate_qualifying_comparison",
        sign="delta = driver_a - driver_b; negative means driver_a was faster",
        number="NULL" if mean else "round",
        driver="driver_a_id",
        constructor="constructor_id",
    )


_GAPS = (
    ("QUALIFYING_TEAMMATE_ADVANTAGE", "<", "faster"),
    ("QUALIFYING_TEAMMATE_DEFICIT", ">", "slower"),
    ("QUALIFYING_TEAMMATE_EQUAL", "=", "equal"),
)
_CHANGES = (
    ("POSITION_GAIN", "> 0", "gained"),
    ("POSITION_LOSS", "< 0", "lost"),
    ("POSITION_MAINTAINED", "= 0", "stable"),
    ("LARGE_POSITION_GAIN", ">= 5", "gained"),
)


def _change(rule: str, test: str, direction: str) -> str:
    sign = (
        "position_change >= 5"
        if rule == "LARGE_POSITION_GAIN"
        else "position_change = grid_position - finish_position; positive means gained positions"
    )
    return row(
        rule,
        "race_results_t",
        f"grid_position - source_position {test}",
        subject="driver_id",
        span=_ROUND,
        direction=f"'{direction}'",
        observed="(grid_position - source_position)",
        unit="positions",
        size="1",
        function="get_grid_vs_finish",
        sign=sign,
        number="round",
        driver="driver_id",
    )


def _mean_change(rule: str, test: str, direction: str) -> str:
    return row(
        rule,
        "mean_change_t",
        f"mean_change {test}",
        subject="driver_id",
        span="'all'",
        direction=f"'{direction}'",
        observed="mean_change",
        unit="positions",
        size="n",
        function="compute_position_change_stats",
        sign="mean position change; positive means gained positions on average",
        metric="mean_position_change",
        source_metric="mean_position_change",
        driver="driver_id",
    )


_TEAMMATE = (
    ("TEAMMATE_GRID_ADVANTAGE", "grid", "<", "higher", "positions", "grid_a - grid_b; negative means driver_a started ahead on the grid"),
    ("TEAMMATE_FINISH_ADVANTAGE", "finish", "<", "higher", "positions", "finish_a - finish_b; negative means driver_a finished ahead"),
    ("TEAMMATE_POINTS_ADVANTAGE", "points", ">", "higher", "points", "points_a - points_b; positive means driver_a scored more"),
    ("TEAMMATE_POINTS_DEFICIT", "points", "<", "lower", "points", "points_a - points_b; positive means driver_a scored more"),
)


def _teammate(source: str, mean: bool) -> list[str]:
    return [
        row(
            rule,
            source,
            f"{kind}_delta {test} 0",
            subject="driver_a_id",
            other="driver_b_id",
            span="'na'" if mean else _ROUND,
            direction=f"'{direction}'",
            observed=f"{kind}_delta",
            unit=unit,
            size="n" if mean else "1",
            function="compute_teammate_head_to_head_stats" if mean else "get_teammate_comparison",
            sign=sign,
            number="NULL" if mean else "round",
            driver="driver_a_id",
            constructor="constructor_id",
        )
        for rule, kind, test, direction, unit, sign in _TEAMMATE
    ]


cte(
    "qualified_deltas_t",
    """
    SELECT d.* FROM teammate_deltas_t d SEMI JOIN teammate_qualifying_t q
      ON q.season_year = d.season_year AND q.round = d.round AND q.constructor_id = d.constructor_id""",
)
cte(
    "mean_gap_t",
    """
    SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id,
           arg_min(driver_b_id, round) AS driver_b_id, avg(delta_millis) AS mean_delta, count(delta_millis) AS n
    FROM teammate_qualifying_t GROUP BY season_year, constructor_id""",
)
cte(
    "mean_deltas_t",
    """
    SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id,
           arg_min(driver_b_id, round) AS driver_b_id, avg(grid_delta) AS grid_delta, avg(finish_delta) AS finish_delta,
           avg(points_delta) AS points_delta, count(points_delta) AS n
    FROM teammate_deltas_t GROUP BY season_year, constructor_id""",
)
cte(
    "mean_change_t",
    """
    SELECT season_year, driver_id, avg(grid_position - source_position) AS mean_change,
           count(grid_position - source_position) AS n
    FROM race_results_t GROUP BY season_year, driver_id""",
)
cte(
    "race_laps_t",
    """
    SELECT season_year, round, driver_id, constructor_id, min(l.time_millis) AS fastest, avg(l.time_millis) AS mean_lap,
           count(l.time_millis) AS n
    FROM lap_times_t l JOIN race_results_t USING (season_year, round, driver_id) GROUP BY ALL""",
)
cte(
    "pace_t",
    """
    SELECT a.season_year, a.round, a.constructor_id, a.driver_id AS driver_a_id, b.driver_id AS driver_b_id,
           a.mean_lap - b.mean_lap AS pace_delta, least(a.n, b.n) AS n
    FROM race_laps_t a JOIN race_laps_t b
      ON a.season_year = b.season_year AND a.round = b.round AND a.constructor_id = b.constructor_id
     AND a.driver_id < b.driver_id""",
)
cte(
    "fast_stops_t",
    """
    SELECT season_year, round, driver_id, arg_min(duration_millis, stop_number) AS duration_millis
    FROM pit_stops_t WHERE duration_millis < 25000 GROUP BY season_year, round, driver_id""",
)
cte(
    "stop_spread_t",
    """
    SELECT season_year, round, driver_id, stddev_samp(duration_millis) AS spread, count(duration_millis) AS n
    FROM pit_stops_t GROUP BY season_year, round, driver_id""",
)


def _timed(rule: str, source: str, where: str, value: str, unit_sign: str, function: str, **more) -> str:
    return row(
        rule,
        source,
        where,
        subject="driver_id",
        span=_ROUND,
        observed=value,
        unit="milliseconds",
        function=function,
        sign=unit_sign,
        number="round",
        **more,
    )


def _pace(rule: str, test: str, direction: str) -> str:
    return row(
        rule,
        "pace_t",
        f"pace_delta {test} 0",
        subject="driver_a_id",
        other="driver_b_id",
        span=_ROUND,
        direction=f"'{direction}'",
        observed="pace_delta",
        unit="milliseconds",
        size="n",
        function="compute_lap_time_stats",
        sign="delta = mean_a - mean_b; negative means driver_a had faster average pace",
        source_metric="mean_lap_time_millis",
        number="round",
        driver="driver_a_id",
        constructor="constructor_id",
    )


_SPAN = "'rounds_' || first_round || '-' || last_round"


def _f(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value})"


def _driver(rule: str, source: str, where: str, value: str, digits: int, **more) -> str:
    return row(
        rule,
        source,
        where,
        subject="driver_id",
        span=more.pop("span", _SPAN),
        observed=half_even(value, digits),
        driver="driver_id",
        rounds=more.pop("rounds", "rounds"),
        **more,
    )


cte(
    "last_window_t",
    """
    SELECT season_year, driver_id, max(round) AS round, arg_max(mean, round) AS mean,
           arg_max(valid_observations, round) AS n, arg_max(first_round, round) AS first_round,
           arg_max(window_rounds, round) AS total
    FROM rolling_t WHERE metric_name = 'finish_position' GROUP BY season_year, driver_id""",
)
cte(
    "last_rounds_t",
    """
    SELECT w.*, (SELECT string_agg(CAST(d.round AS VARCHAR), ',' ORDER BY d.round) FROM driver_rounds_t d
                 WHERE d.season_year = w.season_year AND d.driver_id = w.driver_id
                   AND d.round BETWEEN w.first_round AND w.round) AS rounds
    FROM last_window_t w""",
)


def _pattern(rule: str, test: str, direction: str, side: str) -> str:
    return _driver(
        rule,
        "profile_t",
        f"change_n >= 3 AND change_mean {test}",
        "change_mean",
        2,
        magnitude=half_even("abs(change_mean)", 2),
        direction=f"'{direction}'",
        unit="positions",
        size="change_n",
        function="compute_driver_longitudinal_stats",
        sign=f"{side} mean indicates positions {direction} from grid to finish",
        excluded="entered - change_n",
        explanation=f"'Across ' || change_n || ' valid races in ' || season_year || ', ' || driver_id || "
        f"' {direction} an average of ' || {_f('abs(change_mean)', 1)} || "
        "' positions from starting grid to classified finish.'",
    )


def _spread(rule: str, kind: str, sign: str, what: str, label: str, excluded: str) -> str:
    return _driver(
        rule,
        "profile_t",
        f"{kind}_n >= 3 AND {kind}_sd <= 1.5",
        f"{kind}_sd",
        3,
        direction="'stable'",
        unit="positions",
        size=f"{kind}_n",
        function="compute_driver_longitudinal_stats",
        sign=sign,
        excluded=excluded,
        explanation=f"'Across ' || {kind}_n || ' {what} in ' || season_year || ', ' || driver_id || ' achieved high "
        f"{label} consistency with a standard deviation of ' || {_f(f'{kind}_sd', 2)} || ' positions (mean {label} P' "
        f"|| {_f(f'{kind}_mean', 1)} || ').'",
    )


def _dec(value: str) -> str:
    return f"printf('%.2f', {value})"


DRIVER_SEASON = (
    _spread(
        "LONGITUDINAL_QUALIFYING_CONSISTENCY",
        "grid",
        "lower standard deviation indicates higher grid position consistency",
        "qualifying sessions",
        "grid",
        "0",
    ),
    _spread(
        "LONGITUDINAL_FINISH_CONSISTENCY",
        "finish",
        "lower standard deviation indicates higher finish position consistency; DNFs excluded",
        "classified finishes",
        "finish",
        "entered - finish_n",
    ),
    _pattern("LONGITUDINAL_POSITION_GAIN_PATTERN", ">= 2.0", "gained", "positive"),
    _pattern("LONGITUDINAL_POSITION_LOSS_PATTERN", "<= -2.0", "lost", "negative"),
    _driver(
        "LONGITUDINAL_POINTS_PER_START",
        "points_stats_t",
        "grand_prix_starts >= 3 AND points_per_gp_start >= 15",
        "points_per_gp_start",
        2,
        direction="'higher'",
        unit="points",
        size="grand_prix_starts",
        function="compute_driver_points_stats",
        sign="total_race_points / grand_prix_starts; sprint points excluded",
        excluded="rounds_entered - grand_prix_starts",
        explanation="'Across ' || grand_prix_starts || ' Grand Prix starts in ' || season_year || ', ' || driver_id || "
        f"' scored ' || {_dec('total_race_points')} || ' race points, averaging ' || {_f('points_per_gp_start', 2)} || "
        "' points per start (excluding sprint sessions).'",
    ),
    _driver(
        "LONGITUDINAL_POINTS_PER_ROUND",
        "points_stats_t",
        "rounds_entered >= 3 AND points_per_round_total >= 15",
        "points_per_round_total",
        2,
        direction="'higher'",
        unit="points",
        size="rounds_entered",
        function="compute_driver_points_stats",
        sign="total_championship_points / rounds_entered; includes sprint and race points",
        excluded="0",
        explanation="'Across ' || rounds_entered || ' championship rounds in ' || season_year || ', ' || driver_id || "
        f"' scored ' || {_dec('total_championship_points')} || ' total points (' || {_dec('total_race_points')} || "
        f"' race, ' || {_dec('total_sprint_points')} || ' sprint), averaging ' || {_f('points_per_round_total', 2)} || "
        "' points per round.'",
    ),
    _driver(
        "LONGITUDINAL_RECENT_FORM",
        "last_rounds_t",
        "n >= 2 AND mean <= 5.0",
        "mean",
        2,
        span="'w3_r' || round",
        direction="'higher'",
        unit="positions",
        size="n",
        function="compute_rolling_window_stats",
        sign="mean finishing position over trailing window; DNFs excluded",
        number="round",
        excluded="total - n",
        explanation="'Over the most recent 3 rounds (R' || first_round || '-R' || round || '), ' || driver_id || "
        f"' recorded an average finish of P' || {_f('mean', 1)} || ' across ' || n || ' valid finishes' || "
        "CASE total - n WHEN 0 THEN '' WHEN 1 THEN ' (1 DNF excluded)' ELSE ' (' || (total - n) || ' DNFs excluded)' END "
        "|| '.'",
    ),
)


def _record(kind: str, rule: str, direction: str, sign: str, what: str, verb: str, tail: str) -> list[str]:
    selects = []
    for w, l, guard in (("a", "b", ""), ("b", "a", f"AND coalesce({kind}_rate_a, 0) < 0.7 ")):
        winner, loser = f"driver_{w}_id", f"driver_{l}_id"
        rate = f"{kind}_rate_{w}"
        selects.append(
            row(
                rule,
                "pairing_t",
                f"{kind}_rounds >= 3 {guard}AND {rate} >= 0.7",
                subject=winner,
                other=loser,
                identity=f"'{rule}:' || season_year || ':' || constructor_id || ':' || {winner} || ':' || {loser}",
                direction=f"'{direction}'",
                observed=half_even(rate, 3),
                unit="win_rate",
                size=f"{kind}_rounds",
                function="compute_longitudinal_teammate_h2h_stats",
                sign=sign,
                driver=winner,
                constructor="constructor_id",
                rounds=f"{kind}_rounds_included",
                excluded=f"rounds_together - {kind}_rounds",
                explanation=f"'Across ' || {kind}_rounds || ' comparable {what} for ' || constructor_id || ' in ' || "
                f"season_year || ', ' || {winner} || ' {verb} ' || {loser} || ' ' || {kind}_wins_{w} || '-' || "
                f"{kind}_wins_{l} || ' (' || printf('%.0f', {rate} * 100) || '%)' || {tail} || '.'",
            )
        )
    return selects


def _outscored(w: str, l: str, test: str) -> str:
    rule = "LONGITUDINAL_TEAMMATE_POINTS_H2H"
    winner, loser = f"driver_{w}_id", f"driver_{l}_id"
    return row(
        rule,
        "pairing_t",
        f"rounds_together >= 3 AND points_difference {test}",
        subject=winner,
        other=loser,
        identity=f"'{rule}:' || season_year || ':' || constructor_id || ':' || {winner} || ':' || {loser}",
        direction="'higher'",
        observed="abs(points_difference)",
        unit="points",
        size="rounds_together",
        function="compute_longitudinal_teammate_h2h_stats",
        sign="total_points_winner - total_points_loser; includes sprint points",
        driver=winner,
        constructor="constructor_id",
        rounds="points_rounds_included",
        excluded="0",
        explanation=f"'Across ' || rounds_together || ' rounds together for ' || constructor_id || ' in ' || season_year "
        f"|| ', ' || {winner} || ' scored ' || {_dec(f'total_points_{w}')} || ' points vs ' || {loser} || ' ' || "
        f"{_dec(f'total_points_{l}')} || ' points (differential: +' || {_f('abs(points_difference)', 1)} || "
        f"' points; race: ' || {_dec(f'points_{w}')} || ' vs ' || {_dec(f'points_{l}')} || ', sprint: ' || "
        f"{_dec(f'sprint_points_{w}')} || ' vs ' || {_dec(f'sprint_points_{l}')} || ').'",
    )


PAIR_SEASON = (
    *_record(
        "qualifying",
        "LONGITUDINAL_TEAMMATE_QUALIFYING_H2H",
        "faster",
        "qualifying_wins / comparable_qualifying_rounds",
        "qualifying sessions",
        "out-qualified",
        f"' with an average delta of ' || {_f('abs(qualifying_gap_mean)', 1)} || ' ms'",
    ),
    *_record(
        "race",
        "LONGITUDINAL_TEAMMATE_RACE_H2H",
        "higher",
        "race_wins / comparable_finish_rounds; both cars classified",
        "two-car finishes",
        "finished ahead of",
        "''",
    ),
    _outscored("a", "b", ">= 15"),
    _outscored("b", "a", "<= -15"),
)
# The unrounded mean gap, for the sentence.
cte(
    "pairing_means_t",
    """
    SELECT p.*, g.gap AS qualifying_gap_mean FROM pairing_t p JOIN (
      SELECT season_year, constructor_id, driver_a_id, driver_b_id,
             avg(qualifying_delta_millis) FILTER (WHERE is_comparable_qualifying) AS gap
      FROM teammate_events_t GROUP BY ALL) g USING (season_year, constructor_id, driver_a_id, driver_b_id)""",
)
PAIR_SEASON = tuple(s.replace("FROM pairing_t ", "FROM pairing_means_t ") for s in PAIR_SEASON)
cte(
    "podium_t",
    """
    SELECT season_year, constructor_id, count(*) AS n, count(*) FILTER (WHERE podiums > 0) AS won,
           CAST(sum(total_points) AS DOUBLE) AS points, min(round) AS first_round, max(round) AS last_round,
           string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS rounds
    FROM team_results_t GROUP BY season_year, constructor_id""",
)
TEAM_SEASON = (
    row(
        "LONGITUDINAL_CONSTRUCTOR_PODIUM_RATE",
        "podium_t",
        "n >= 3 AND won / n >= 0.6",
        subject="constructor_id",
        span=_SPAN,
        direction="'higher'",
        observed=half_even("won / n", 3),
        unit="rate",
        size="n",
        function="get_constructor_trajectory",
        sign="podium_rounds / rounds_entered",
        constructor="constructor_id",
        rounds="rounds",
        excluded="0",
        explanation="'Across ' || n || ' rounds in ' || season_year || ', ' || constructor_id || ' achieved podium "
        "finishes in ' || won || ' rounds (' || printf('%.0f', won / n * 100.0) || '%), accumulating ' || "
        f"{_dec('points')} || ' championship points.'",
    ),
)
_RANGE = (
    "CASE WHEN first_round = last_round THEN 'round_' || first_round "
    "ELSE 'rounds_' || first_round || '-' || last_round END"
)


def _share(rule: str, n: str, k: str, rate: str, needed: int, extra: str, direction: str, function: str,
           lead: str, verb: str, tail: str, dns: str, parameters: dict) -> str:
    return row(
        rule,
        "conversion_t",
        f"{n} >= {needed}{extra}",
        subject="driver_id",
        span=_RANGE,
        direction=direction,
        observed=rate,
        unit="percentage",
        size=n,
        function=function,
        sign="Percentage between 0.0% and 100.0%",
        driver="driver_id",
        constructor="constructor_id",
        rounds="rounds_included",
        excluded=f"greatest(0, n_rounds - {n} + {dns})",
        parameters=parameters,
        explanation=f"'Across ' || {n} || ' {lead} in ' || season_year || ', ' || driver_id || ' {verb} ' || {k} || "
        f"' {tail} (' || {_f(rate, 1)} || '% ' || '{'podium retention' if 'FRONT' in rule else 'conversion'} rate).'",
    )


def _tier(rule: str, name: str, test: str, direction: str, lead: str, verb: str, key: str, threshold: float) -> str:
    delta = half_even(f"{name}_gained / {name}_finishes", 4)
    return row(
        rule,
        "conversion_t",
        f"{name}_starts >= 5 AND {name}_finishes > 0 AND {delta} {test}",
        subject="driver_id",
        identity=f"'{rule}:' || season_year || ':' || {_RANGE} || ':' || driver_id || ':{name}'",
        direction=f"'{direction}'",
        observed=delta,
        unit="positions",
        size=f"{name}_starts",
        function="compute_grid_tier_stats",
        sign="Positive means positions gained; negative means positions lost",
        driver="driver_id",
        constructor="constructor_id",
        rounds="rounds_included",
        excluded=f"{name}_starts - {name}_finishes",
        parameters={key: threshold, "min_sample_size": 5},
        explanation=f"'When starting from the {lead} across ' || {name}_starts || ' races in ' || season_year || ', ' || "
        f"driver_id || ' {verb} of ' || printf('%+.2f', {delta}) || ' positions across ' || {name}_finishes || "
        f"' classified finishes (net ' || printf('%+d', {name}_gained) || ' positions).'",
    )


_EVEN = "CASE WHEN {0} >= 50 THEN 'higher' ELSE 'lower' END"
CONVERSION = (
    _share("POLE_TO_WIN_CONVERSION", "total_poles", "wins_from_pole", "pole_to_win_rate", 3, "",
           _EVEN.format("pole_to_win_rate"), "compute_pole_to_win_stats", "pole starts", "converted",
           "into Grand Prix wins", "0", {"min_sample_size": 3}),
    _share("FRONT_ROW_PODIUM_RETENTION", "front_row_starts", "front_row_podiums", "front_row_podium_rate", 3, "",
           _EVEN.format("front_row_podium_rate"), "compute_front_row_stats", "front-row starts", "retained",
           "as podium finishes", "dns_count", {"min_sample_size": 3}),
    _share("TOP10_CONVERSION_HIGH", "top10_starts", "top10_conversions", "top10_conversion_rate", 5,
           " AND top10_conversion_rate >= 90", "'higher'", "compute_top10_conversion_stats", "top-10 grid starts",
           "converted", "into classified top-10 finishes", "dns_count",
           {"conversion_threshold": 90, "min_sample_size": 5}),
    _tier("GRID_TIER_POSITION_LOSS", "front", "<= -1.5", "lost", "front tier (P1-P4)",
          "experienced an average position change", "loss_threshold", -1.5),
    _tier("GRID_TIER_POSITION_GAIN", "lower", ">= 2.0", "gained", "lower tier (P11-P20)",
          "achieved an average position gain", "gain_threshold", 2.0),
)

cte(
    "race_insights_t",
    union(
        *[_gap(*g) for g in _GAPS],
        *[_change(*c) for c in _CHANGES],
        *_teammate("qualified_deltas_t", mean=False),
    ),
)
cte("season_insights_t", union(*DRIVER_SEASON, *PAIR_SEASON, *TEAM_SEASON))
cte("conversion_insights_t", union(*CONVERSION))

SQL = {
    "race_insights": query("SELECT * FROM race_insights_t"),
    "qualifying_mean_insights": query(union(*[_gap(*g, source="mean_gap_t", mean=True) for g in _GAPS])),
    "teammate_mean_insights": query(union(*_teammate("mean_deltas_t", mean=True))),
    "multi_race_position_insights": query(union(*[_mean_change(*c) for c in _CHANGES[:3]])),
    "fastest_lap_insights": query(
        _timed("FASTEST_RECORDED_LAP", "race_laps_t", "fastest IS NOT NULL", "fastest",
               "minimum recorded lap time in milliseconds", "compute_lap_time_stats", direction="'faster'", size="1",
               driver="driver_id")
    ),
    "race_pace_insights": query(
        union(
            _pace("RACE_PACE_TEAMMATE_ADVANTAGE", "<", "faster"), _pace("RACE_PACE_TEAMMATE_DEFICIT", ">", "slower")
        )
    ),
    "fast_pit_stop_insights": query(
        _timed("FAST_PIT_STOP", "fast_stops_t", "TRUE", "duration_millis", "pit stop duration under 25000 ms",
               "compute_pit_stop_stats", direction="'faster'", size="1")
    ),
    "pit_stop_variability_insights": query(
        _timed("PIT_STOP_HIGH_VARIABILITY", "stop_spread_t", "n >= 2 AND spread > 1500", "spread",
               "sample standard deviation exceeds 1500 ms", "compute_pit_stop_stats", direction="'higher'", size="n")
    ),
    "driver_insights": query(union(*DRIVER_SEASON)),
    "pair_insights": query(union(*PAIR_SEASON)),
    "constructor_insights": query(union(*TEAM_SEASON)),
    "season_insights": query("SELECT * FROM season_insights_t"),
    "conversion_insights": query("SELECT * FROM conversion_insights_t"),
    "mixed_insights": query("SELECT * FROM race_insights_t UNION ALL SELECT * FROM season_insights_t"),
    "entity_insights": query(
        "SELECT * FROM race_insights_t WHERE subject_id = 'driver_000000000001' "
        "OR comparison_subject_id = 'driver_000000000001'"
    ),
    "team_entity_insights": query("SELECT * FROM race_insights_t WHERE constructor_id = 'team_000000000000'"),
    "one_driver_insights": query(f"SELECT * FROM ({union(*DRIVER_SEASON)}) WHERE subject_id = 'driver_000000000001'"),
    "one_pair_insights": query(
        f"SELECT * FROM ({union(*PAIR_SEASON)}) WHERE least(subject_id, comparison_subject_id) = 'driver_000000000002' "
        "AND greatest(subject_id, comparison_subject_id) = 'driver_000000000003'"
    ),
    "one_team_insights": query(f"SELECT * FROM ({union(*TEAM_SEASON)}) WHERE subject_id = 'team_000000000000'"),
    "insight_counts": query(
        "SELECT rule_id, count(*) AS insights FROM (SELECT rule_id FROM season_insights_t UNION ALL "
        "SELECT rule_id FROM conversion_insights_t) GROUP BY rule_id"
    ),
}
