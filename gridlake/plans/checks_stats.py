"""SQL for the statistics."""

from __future__ import annotations

from gridlake.plans.oracle import cte, half_even, query


def stats(value: str, prefix: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    q1, q3 = f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.75)"
    many = f"count({value}) >= 2"
    return f"""
      count({value}) AS {prefix}_n, round(avg({v}), 6) AS {prefix}_mean,
      round(quantile_cont({v}, 0.5), 6) AS {prefix}_median, round(stddev_samp({v}), 6) AS {prefix}_stddev,
      min({v}) AS {prefix}_minimum, max({v}) AS {prefix}_maximum,
      round(CASE WHEN {many} THEN {q1} END, 6) AS {prefix}_q1, round(CASE WHEN {many} THEN {q3} END, 6) AS {prefix}_q3,
      round(CASE WHEN {many} THEN {q3} - {q1} END, 6) AS {prefix}_iqr"""


def quality(value: str) -> str:
    return (
        f"count(*) AS total_observations, count({value}) AS valid_observations, "
        f"count(*) - count({value}) AS excluded_observations"
    )


def strength(n: str, required: int = 1) -> str:
    return (
        f"CASE WHEN {n} < {required} OR {n} <= 0 THEN 'INSUFFICIENT' WHEN {n} = 1 THEN 'LOW' "
        f"WHEN {n} <= 4 THEN 'MODERATE' ELSE 'HIGH' END"
    )


cte(
    "driver_values_t",
    """
    SELECT *, CASE WHEN grid_position > 0 THEN grid_position END AS raced_grid,
           CASE WHEN grid_position > 0 THEN grid_position - finish END AS change
    FROM driver_rounds_t""",
)
_STARTS = "count(*) FILTER (WHERE lower(status) <> 'did not start' AND lower(position_text) <> 'dns')"
_POINTS = f"""
    CAST(sum(race_points) AS DOUBLE) AS total_race_points, CAST(sum(sprint_points) AS DOUBLE) AS total_sprint_points,
    CAST(sum(total_points) AS DOUBLE) AS total_championship_points, {_STARTS} AS grand_prix_starts,
    count(*) AS rounds_entered,
    CASE WHEN {_STARTS} > 0 THEN {half_even(f'sum(race_points) / {_STARTS}', 4)} END AS points_per_gp_start,
    {half_even('sum(race_points) / count(*)', 4)} AS points_per_gp_entry,
    {half_even('sum(total_points) / count(*)', 4)} AS points_per_round_total"""
cte(
    "points_stats_t",
    f"SELECT season_year, driver_id, {_POINTS}, min(round) AS first_round, max(round) AS last_round, "
    "string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS rounds FROM driver_rounds_t "
    "GROUP BY season_year, driver_id",
)


def _exact_sd(v: str) -> str:
    """Spread from integer sums, for threshold tests."""
    return (
        f"CASE WHEN count({v}) >= 2 THEN sqrt(CAST(count({v}) * sum(CAST({v} AS HUGEINT) * {v}) "
        f"- sum({v}) * sum({v}) AS DOUBLE) / (count({v}) * (count({v}) - 1.0))) END"
    )


cte(
    "profile_t",
    f"""
    SELECT season_year, driver_id, count(*) AS entered, count(finish) AS finish_n, avg(finish) AS finish_mean,
           {_exact_sd('finish')} AS finish_sd, count(raced_grid) AS grid_n, avg(raced_grid) AS grid_mean,
           {_exact_sd('raced_grid')} AS grid_sd, count(change) AS change_n, avg(change) AS change_mean,
           min(round) AS first_round, max(round) AS last_round,
           string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS rounds
    FROM driver_values_t GROUP BY ALL""",
)


def _rolling(name: str, value: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    w = "OVER w"
    return f"""
      SELECT season_year, driver_id, '{name}' AS metric_name, round, count(*) {w} AS window_rounds,
             min(round) {w} AS first_round, count({value}) {w} AS valid_observations,
             {half_even(f'avg({v}) {w}', 4)} AS mean, {half_even(f'quantile_cont({v}, 0.5) {w}', 4)} AS median,
             CASE WHEN count({value}) {w} >= 2 THEN sqrt(CAST(count({value}) {w} * sum({value} * {value}) {w}
               - sum({value}) {w} * sum({value}) {w} AS DOUBLE) / (count({value}) {w} * (count({value}) {w} - 1.0)))
             END AS sd, min({v}) {w} AS minimum, max({v}) {w} AS maximum
      FROM driver_values_t WINDOW w AS (PARTITION BY season_year, driver_id ORDER BY round
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


cte(
    "rolling_t",
    " UNION ALL ".join(
        (
            _rolling("finish_position", "finish"),
            _rolling("points", "total_points"),
            _rolling("position_change", "change"),
        )
    ),
)
_RECORD = {
    "qualifying": (
        "is_comparable_qualifying AND qualifying_delta_millis IS NOT NULL",
        "ahead_in_qualifying",
    ),
    "race": ("is_comparable_finish", "ahead_in_race"),
}


def _record(name: str) -> str:
    counted, ahead = _RECORD[name]
    n = f"count(*) FILTER (WHERE {counted})"
    wins = [f"count(*) FILTER (WHERE {counted} AND {ahead} = driver_{s}_id)" for s in "ab"]
    return f"""
      {n} AS {name}_rounds, {wins[0]} AS {name}_wins_a, {wins[1]} AS {name}_wins_b,
      CASE WHEN {n} > 0 THEN {half_even(f'{wins[0]} / {n}', 4)} END AS {name}_rate_a,
      CASE WHEN {n} > 0 THEN {half_even(f'{wins[1]} / {n}', 4)} END AS {name}_rate_b,
      {strength(n)} AS {name}_strength,
      string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) FILTER (WHERE {counted}) AS {name}_rounds_included"""


_GAP = "CAST((points_a + sprint_points_a) - (points_b + sprint_points_b) AS BIGINT)"
cte(
    "pairing_t",
    f"""
    SELECT season_year, constructor_id, driver_a_id, driver_b_id, count(*) AS rounds_together,
           {_record('qualifying')}, {_record('race')},
           {stats(f"CASE WHEN {_RECORD['qualifying'][0]} THEN qualifying_delta_millis END", 'qualifying_delta')},
           {stats('CASE WHEN is_comparable_finish THEN finish_a - finish_b END', 'race_delta')},
           CAST(sum(points_a) AS DOUBLE) AS points_a, CAST(sum(points_b) AS DOUBLE) AS points_b,
           CAST(sum(sprint_points_a) AS DOUBLE) AS sprint_points_a,
           CAST(sum(sprint_points_b) AS DOUBLE) AS sprint_points_b,
           CAST(sum(points_a + sprint_points_a) AS DOUBLE) AS total_points_a,
           CAST(sum(points_b + sprint_points_b) AS DOUBLE) AS total_points_b,
           CAST(sum({_GAP}) AS DOUBLE) AS points_difference, {stats(_GAP, 'points_delta')},
           string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS points_rounds_included
    FROM teammate_events_t GROUP BY season_year, constructor_id, driver_a_id, driver_b_id""",
)
_EVIDENCE = "n_rounds AS total_races, {n} AS valid_observations, {x} AS excluded_observations, {s} AS evidence_strength"


def _conversion(metric: str, n: str, k: str, rate: str, needed: int, dns: str) -> str:
    return f"""
      SELECT season_year, driver_id, '{metric}' AS figure, {n} AS observations, {k} AS successes, {rate} AS rate,
             n_rounds AS total_races, greatest(0, n_rounds - {n} + {dns}) AS excluded_observations,
             {n} >= {needed} AS is_available, {strength(n, needed)} AS evidence_strength, rounds_included
      FROM conversion_t"""


_FULL_PREFIXES = (("finish", "finish"), ("grid", "raced_grid"), ("change", "change"))
SQL = {
    "lap_stats": query(
        f"SELECT season_year, round, driver_id, {stats('time_millis', 'lap')}, {quality('time_millis')}, "
        "min(time_millis) AS fastest_recorded_millis FROM lap_times_t GROUP BY ALL"
    ),
    "pit_stats": query(
        f"SELECT season_year, round, driver_id, {stats('duration_millis', 'stop')}, {quality('duration_millis')}, "
        "min(duration_millis) AS fastest_duration_millis FROM pit_stops_t GROUP BY ALL"
    ),
    "driver_season_lap_stats": query(
        f"SELECT season_year, driver_id, {stats('time_millis', 'lap')}, {quality('time_millis')}, "
        "min(time_millis) AS fastest_recorded_millis FROM lap_times_t GROUP BY ALL"
    ),
    "qualifying_delta_stats": query(
        f"SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id, "
        f"arg_min(driver_b_id, round) AS driver_b_id, {stats('delta_millis', 'delta')}, {quality('delta_millis')} "
        "FROM teammate_qualifying_t GROUP BY season_year, constructor_id"
    ),
    "h2h_stats": query(
        f"""SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id,
        arg_min(driver_b_id, round) AS driver_b_id, {stats('qualifying_delta_millis', 'qualifying')},
        {stats('grid_delta', 'grid')}, {stats('finish_delta', 'finish')}, {stats('points_delta', 'points')},
        {quality('coalesce(qualifying_delta_millis, grid_delta, finish_delta, points_delta)')}
        FROM teammate_deltas_t GROUP BY season_year, constructor_id"""
    ),
    "one_team_qualifying_stats": query(
        f"SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id, "
        f"arg_min(driver_b_id, round) AS driver_b_id, {stats('delta_millis', 'delta')}, {quality('delta_millis')} "
        "FROM teammate_qualifying_t WHERE constructor_id = 'team_000000000000' GROUP BY season_year, constructor_id"
    ),
    "one_team_h2h_stats": query(
        f"""SELECT season_year, constructor_id, arg_min(driver_a_id, round) AS driver_a_id,
        arg_min(driver_b_id, round) AS driver_b_id, {stats('qualifying_delta_millis', 'qualifying')},
        {stats('grid_delta', 'grid')}, {stats('finish_delta', 'finish')}, {stats('points_delta', 'points')},
        {quality('coalesce(qualifying_delta_millis, grid_delta, finish_delta, points_delta)')}
        FROM teammate_deltas_t WHERE constructor_id = 'team_000000000000' GROUP BY season_year, constructor_id"""
    ),
    "position_change_stats": query(
        f"""SELECT season_year, driver_id, {stats('grid_position - source_position', 'change')},
        {quality('grid_position - source_position')},
        count(*) FILTER (WHERE grid_position > source_position) AS positive_count,
        count(*) FILTER (WHERE grid_position < source_position) AS negative_count,
        count(*) FILTER (WHERE grid_position = source_position) AS zero_count,
        round(avg(CASE WHEN grid_position > source_position THEN 1.0 WHEN grid_position <= source_position THEN 0.0 END), 6)
          AS positive_rate
        FROM race_results_t GROUP BY season_year, driver_id"""
    ),
    "points_stats": query(
        f"""SELECT p.season_year, p.driver_id, p.* EXCLUDE (season_year, driver_id, first_round, last_round),
            s.* EXCLUDE (season_year, driver_id)
        FROM points_stats_t p JOIN (
          SELECT season_year, driver_id, {stats('race_points', 'race_points')},
                 {stats('total_points', 'total_points')}, {strength('count(*)')} AS evidence_strength
          FROM driver_rounds_t GROUP BY season_year, driver_id) s USING (season_year, driver_id)"""
    ),
    "driver_profile": query(
        f"""SELECT season_year, driver_id, max(round) AS up_to_round,
        {', '.join(stats(value, name) for name, value in _FULL_PREFIXES)},
        count(*) FILTER (WHERE change > 0) AS positive_count, count(*) FILTER (WHERE change < 0) AS negative_count,
        CAST(max(finish) - min(finish) AS DOUBLE) AS finish_range,
        CAST(max(raced_grid) - min(raced_grid) AS DOUBLE) AS grid_range,
        CAST(max(change) - min(change) AS DOUBLE) AS change_range,
        CAST(max(total_points) - min(total_points) AS DOUBLE) AS points_range,
        {strength('count(*)')} AS evidence_strength,
        string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS rounds
        FROM driver_values_t GROUP BY season_year, driver_id"""
    ),
    "rolling_form": query(
        f"""SELECT season_year, driver_id, metric_name, round, window_rounds, first_round, valid_observations,
        mean, median, {half_even('sd', 4)} AS stddev, minimum, maximum,
        {strength('valid_observations')} AS evidence_strength FROM rolling_t"""
    ),
    "race_deltas": query(
        """SELECT season_year, driver_id, from_round, to_round, metric_name, CAST(delta AS DOUBLE) AS delta FROM (
          SELECT season_year, driver_id, lag(round) OVER w AS from_round, round AS to_round, 'finish_position' AS metric_name,
                 finish - lag(finish) OVER w AS delta FROM driver_rounds_t
          WINDOW w AS (PARTITION BY season_year, driver_id ORDER BY round)
          UNION ALL
          SELECT season_year, driver_id, lag(round) OVER w, round, 'points', total_points - lag(total_points) OVER w
          FROM driver_rounds_t WINDOW w AS (PARTITION BY season_year, driver_id ORDER BY round))
        WHERE from_round IS NOT NULL"""
    ),
    "form_summary": query(
        """SELECT season_year, driver_id, max(round) AS up_to_round, count(*) * 3 AS windows, (count(*) - 1) * 2 AS deltas
        FROM driver_rounds_t GROUP BY season_year, driver_id"""
    ),
    "pairing_stats": query("SELECT * FROM pairing_t"),
    "conversion_stats": query(
        " UNION ALL ".join(
            (
                _conversion("pole_to_win", "total_poles", "wins_from_pole", "pole_to_win_rate", 3, "0"),
                _conversion(
                    "front_row", "front_row_starts", "front_row_podiums", "front_row_podium_rate", 3, "dns_count"
                ),
                _conversion(
                    "top10", "top10_starts", "top10_conversions", "top10_conversion_rate", 5, "dns_count"
                ),
            )
        )
    ),
    "grid_tier_stats": query(
        f"""SELECT t.*, n_rounds AS total_races, eligible_starts >= 5 AS is_available,
        {strength('eligible_starts', 5)} AS evidence_strength
        FROM tiers_t t JOIN conversion_t c USING (season_year, driver_id)"""
    ),
}
