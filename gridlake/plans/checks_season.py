"""SQL for the season views, conversion and attrition."""

from __future__ import annotations

from gridlake.plans.checks_event import PAIR_NAMES
from gridlake.plans.oracle import cte, half_even, query

cte(
    "driver_rounds_t",
    """
    SELECT r.season_year, r.round, r.driver_id, r.constructor_id, grid_position,
           CASE WHEN ok THEN r.source_position END AS finish, position_text, status, ok AS is_classified,
           r.points AS race_points, coalesce(s.points, 0) AS sprint_points,
           r.points + coalesce(s.points, 0) AS total_points, laps_completed, fastest_lap_rank
    FROM race_results_t r LEFT JOIN sprint_t s USING (season_year, round, driver_id)""",
)
cte(
    "team_results_t",
    """
    SELECT season_year, round, constructor_id, sum(race_points) AS race_points, sum(sprint_points) AS sprint_points,
           sum(total_points) AS total_points, min(r.source_position) AS best_finish,
           count(*) FILTER (WHERE r.source_position <= 3) AS podiums, count(r.source_position) AS cars_classified,
           count(*) AS cars_entered
    FROM driver_rounds_t JOIN (SELECT season_year, round, driver_id, source_position FROM race_results_t) r
      USING (season_year, round, driver_id)
    GROUP BY ALL""",
)
cte(
    "driver_totals_t",
    f"""
    SELECT season_year, driver_id, max(round) AS up_to_round, arg_max(constructor_id, round) AS constructor_id,
           count(*) AS races_entered,
           count(*) FILTER (WHERE grid_position IS NOT NULL OR lower(status) NOT IN ('did not start', 'dns'))
             AS races_started,
           count(*) FILTER (WHERE is_classified) AS races_classified,
           count(*) FILTER (WHERE NOT is_classified) AS dnf_count,
           count(*) FILTER (WHERE finish = 1) AS wins, count(*) FILTER (WHERE finish <= 3) AS podiums,
           count(*) FILTER (WHERE race_points > 0) AS points_finishes,
           CAST(sum(race_points) AS DOUBLE) AS total_race_points,
           CAST(sum(sprint_points) AS DOUBLE) AS total_sprint_points, CAST(sum(total_points) AS DOUBLE) AS total_points,
           {half_even('sum(grid_position) FILTER (WHERE grid_position > 0) / count(*) FILTER (WHERE grid_position > 0)', 2)}
             AS average_grid,
           {half_even('sum(finish) / count(finish)', 2)} AS average_finish,
           min(grid_position) FILTER (WHERE grid_position > 0) AS best_grid, min(finish) AS best_finish,
           CAST(sum(laps_completed) AS BIGINT) AS total_laps_completed
    FROM driver_rounds_t GROUP BY season_year, driver_id""",
)
cte(
    "team_totals_t",
    """
    SELECT season_year, constructor_id, max(round) AS up_to_round, count(*) AS races_entered,
           CAST(sum(cars_entered) AS BIGINT) AS total_car_starts,
           CAST(sum(cars_classified) AS BIGINT) AS total_car_finishes,
           CAST(sum(cars_entered) - sum(cars_classified) AS BIGINT) AS dnf_count,
           count(*) FILTER (WHERE best_finish = 1) AS wins, CAST(sum(podiums) AS BIGINT) AS podiums,
           CAST(sum(race_points) AS DOUBLE) AS total_race_points,
           CAST(sum(sprint_points) AS DOUBLE) AS total_sprint_points, CAST(sum(total_points) AS DOUBLE) AS total_points
    FROM team_results_t GROUP BY ALL""",
)
cte(
    "contribution_t",
    f"""
    SELECT d.season_year, d.constructor_id, d.driver_id, n.driver_name,
           CAST(sum(race_points) AS DOUBLE) AS race_points, CAST(sum(sprint_points) AS DOUBLE) AS sprint_points,
           CAST(sum(d.total_points) AS DOUBLE) AS total_points,
           CASE WHEN any_value(tt.total_points) > 0
                THEN {half_even('sum(d.total_points) * 100 / any_value(tt.total_points)', 2)} END AS points_share_pct,
           count(*) AS races_entered, min(r.source_position) AS best_finish
    FROM driver_rounds_t d
    JOIN (SELECT season_year, round, driver_id, source_position FROM race_results_t) r
      USING (season_year, round, driver_id)
    JOIN team_totals_t tt ON tt.season_year = d.season_year AND tt.constructor_id = d.constructor_id
    JOIN drivers_t n ON n.driver_id = d.driver_id
    GROUP BY d.season_year, d.constructor_id, d.driver_id, n.driver_name""",
)
cte(
    "weekend_t",
    """
    SELECT coalesce(r.season_year, q.season_year) AS season_year, coalesce(r.round, q.round) AS round,
           coalesce(r.driver_id, q.driver_id) AS driver_id, r.constructor_id, q.position AS qualified, grid_position AS grid,
           CASE WHEN r.ok THEN r.source_position END AS finish, r.driver_id IS NOT NULL AS has_result,
           r.driver_id IS NOT NULL AND lower(status) NOT IN ('did not start', 'withdrawn', 'dns')
             AND upper(position_text) NOT IN ('W', 'DNS') AS started
    FROM race_results_t r FULL JOIN qualifying_t q
      ON r.season_year = q.season_year AND r.round = q.round AND r.driver_id = q.driver_id""",
)


def _tier_counts(name: str, low: int, high: int) -> str:
    inside = f"started AND grid BETWEEN {low} AND {high}"
    return f"""
      count(*) FILTER (WHERE {inside}) AS {name}_starts,
      count(*) FILTER (WHERE {inside} AND finish IS NOT NULL) AS {name}_finishes,
      coalesce(CAST(sum(grid - finish) FILTER (WHERE {inside}) AS BIGINT), 0) AS {name}_gained"""


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {half_even(f'{part} / {whole} * 100.0', 2)} ELSE 0.0 END"


cte(
    "conversion_t",
    f"""
    SELECT *, {_pct('wins_from_pole', 'total_poles')} AS pole_to_win_rate,
           {_pct('front_row_podiums', 'front_row_starts')} AS front_row_podium_rate,
           {_pct('top10_conversions', 'top10_starts')} AS top10_conversion_rate
    FROM (
      SELECT season_year, driver_id, arg_max(constructor_id, round) AS constructor_id,
        count(*) FILTER (WHERE qualified = 1) AS total_poles,
        count(*) FILTER (WHERE qualified = 1 AND started AND finish = 1) AS wins_from_pole,
        count(*) FILTER (WHERE qualified IN (1, 2) AND started) AS front_row_starts,
        count(*) FILTER (WHERE qualified IN (1, 2) AND started AND finish <= 3) AS front_row_podiums,
        count(*) FILTER (WHERE started AND grid BETWEEN 1 AND 10) AS top10_starts,
        count(*) FILTER (WHERE started AND grid BETWEEN 1 AND 10 AND finish <= 10) AS top10_conversions,
        {_tier_counts('front', 1, 4)}, {_tier_counts('midfield', 5, 10)}, {_tier_counts('lower', 11, 20)},
        count(*) AS n_rounds, min(round) AS first_round, max(round) AS last_round,
        string_agg(CAST(round AS VARCHAR), ',' ORDER BY round) AS rounds_included,
        count(*) FILTER (WHERE started AND coalesce(grid, 0) <= 0) AS pit_lane_starts_count,
        count(*) FILTER (WHERE NOT started) AS dns_count
      FROM weekend_t GROUP BY season_year, driver_id HAVING count(*) FILTER (WHERE has_result) > 0)""",
)
cte(
    "tiers_t",
    " UNION ALL ".join(
        f"SELECT season_year, driver_id, '{name}' AS tier_name, {low} AS min_grid, {high} AS max_grid, "
        f"{name}_starts AS eligible_starts, {name}_finishes AS classified_finishes, "
        f"{name}_starts - {name}_finishes AS non_classified_results, {name}_gained AS total_positions_gained, "
        f"CASE WHEN {name}_finishes > 0 THEN {half_even(f'{name}_gained / {name}_finishes', 4)} END AS avg_position_delta "
        "FROM conversion_t"
        for name, low, high in (("front", 1, 4), ("midfield", 5, 10), ("lower", 11, 20))
    ),
)
cte(
    "states_t",
    """
    SELECT season_year, round, driver_id, constructor_id,
           CASE WHEN lower(status) IN ('did not start', 'dns', 'withdrawn') OR position_text IN ('W', 'DNS') THEN 'DNS'
                WHEN lower(status) = 'disqualified' OR position_text = 'D' THEN 'DSQ'
                WHEN lower(status) = 'retired' OR position_text = 'R' THEN 'DNF'
                WHEN position_text <> '' OR lower(status) IN ('finished', 'lapped') OR starts_with(status, '+')
                  THEN 'CLASSIFIED' ELSE 'UNKNOWN' END AS state
    FROM race_results_t""",
)
cte(
    "season_rounds_t",
    "SELECT season_year, max(round) AS up_to_round FROM race_results_t GROUP BY season_year",
)
cte(
    "periods_t",
    """
    SELECT season_year, up_to_round, period_name, start_round, end_round,
           (SELECT count(DISTINCT round) FROM race_results_t r WHERE r.season_year = p.season_year
              AND r.round BETWEEN start_round AND end_round) = end_round - start_round + 1 AS is_complete
    FROM (
      SELECT season_year, up_to_round, period_name, start_round, end_round FROM season_rounds_t,
        (VALUES ('Early', 1, 8), ('Middle', 9, 16), ('Late', 17, 24)) v(period_name, start_round, end_round)
      UNION ALL
      SELECT season_year, up_to_round, printf('R%02d', n), n, n
      FROM season_rounds_t, generate_series(1, 24) g(n) WHERE n <= up_to_round) p""",
)


def _attrition(level: str, entity: str, name: str, join: str, group: str) -> str:
    return f"""
      SELECT p.season_year, up_to_round, period_name, start_round, end_round, is_complete, '{level}' AS level,
        {entity} AS entity_id, {name} AS entity_name, count(*) AS entries,
        count(*) FILTER (WHERE state <> 'DNS') AS starts, count(*) FILTER (WHERE state = 'CLASSIFIED') AS classified_finishes,
        count(*) FILTER (WHERE state = 'DNF') AS dnf_results, count(*) FILTER (WHERE state = 'DNS') AS dns_results,
        count(*) FILTER (WHERE state = 'DSQ') AS dsq_results,
        count(*) FILTER (WHERE state = 'UNKNOWN') AS unknown_non_classified
      FROM periods_t p JOIN states_t s ON s.season_year = p.season_year AND s.round BETWEEN start_round AND end_round
      {join} WHERE is_complete GROUP BY {group}p.season_year, up_to_round, period_name, start_round, end_round, is_complete"""


cte(
    "attrition_counts_t",
    " UNION ALL ".join(
        (
            _attrition("total", "NULL", "NULL", "", ""),
            _attrition(
                "constructor",
                "s.constructor_id",
                "constructor_name",
                "JOIN constructors_t c ON c.constructor_id = s.constructor_id",
                "s.constructor_id, constructor_name, ",
            ),
            _attrition(
                "driver",
                "s.driver_id",
                "driver_name",
                "JOIN drivers_t d ON d.driver_id = s.driver_id",
                "s.driver_id, driver_name, ",
            ),
        )
    ),
)
_LOST = "(dnf_results + dsq_results + unknown_non_classified)"
cte(
    "attrition_t",
    f"""
    SELECT *, {_LOST} AS non_classified_results,
           CASE WHEN starts > 0 THEN {half_even('dnf_results / starts * 100', 4)} END AS dnf_rate,
           CASE WHEN starts > 0 THEN {half_even(f'{_LOST} / starts * 100', 4)} END AS non_classification_rate
    FROM attrition_counts_t
    UNION ALL
    SELECT season_year, up_to_round, period_name, start_round, end_round, is_complete, 'total', NULL, NULL,
           NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM periods_t WHERE NOT is_complete""",
)

_TOTALS = "season_year, driver_id, up_to_round"
SQL = {
    "driver_trajectory": query(
        """
        SELECT d.season_year, d.round, d.driver_id, race_name, circuit_name, race_date, d.constructor_id,
               constructor_name, grid_position, finish AS finish_position, position_text, status, is_classified,
               CAST(race_points AS DOUBLE) AS race_points, CAST(sprint_points AS DOUBLE) AS sprint_points,
               CAST(d.total_points AS DOUBLE) AS total_round_points,
               CAST(sum(race_points) OVER w AS DOUBLE) AS cumulative_race_points,
               CAST(sum(sprint_points) OVER w AS DOUBLE) AS cumulative_sprint_points,
               CAST(sum(d.total_points) OVER w AS DOUBLE) AS cumulative_total_points,
               s.position AS championship_standing_position, coalesce(p.stops, 0) AS pit_stop_count, fastest_lap_rank
        FROM driver_rounds_t d JOIN race_details_t USING (season_year, round)
        JOIN constructors_t c ON c.constructor_id = d.constructor_id
        LEFT JOIN driver_standings_t s ON s.season_year = d.season_year AND s.round = d.round AND s.driver_id = d.driver_id
        LEFT JOIN (SELECT season_year, round, driver_id, count(*) AS stops FROM pit_stops_t GROUP BY ALL) p
          ON p.season_year = d.season_year AND p.round = d.round AND p.driver_id = d.driver_id
        WINDOW w AS (PARTITION BY d.season_year, d.driver_id ORDER BY d.round)"""
    ),
    "driver_season": query(
        """
        SELECT t.*, code AS driver_code, given_name, family_name, constructor_name,
               (SELECT arg_max(position, round) FROM driver_standings_t s WHERE s.season_year = t.season_year
                  AND s.driver_id = t.driver_id AND s.round <= t.up_to_round) AS championship_standing
        FROM driver_totals_t t JOIN drivers_t USING (driver_id) JOIN constructors_t USING (constructor_id)"""
    ),
    "driver_season_to_round_12": query(
        """
        SELECT season_year, driver_id, count(*) AS races_entered, CAST(sum(total_points) AS DOUBLE) AS total_points,
               min(finish) AS best_finish, 12 AS up_to_round,
               (SELECT arg_max(position, round) FROM driver_standings_t s WHERE s.season_year = d.season_year
                  AND s.driver_id = d.driver_id AND s.round <= 12) AS championship_standing
        FROM driver_rounds_t d WHERE round <= 12 GROUP BY season_year, driver_id"""
    ),
    "constructor_trajectory": query(
        """
        SELECT t.season_year, t.round, race_name, circuit_name, race_date, t.constructor_id, constructor_name,
               CAST(race_points AS DOUBLE) AS race_points, CAST(sprint_points AS DOUBLE) AS sprint_points,
               CAST(t.total_points AS DOUBLE) AS total_round_points,
               CAST(sum(race_points) OVER w AS DOUBLE) AS cumulative_race_points,
               CAST(sum(sprint_points) OVER w AS DOUBLE) AS cumulative_sprint_points,
               CAST(sum(t.total_points) OVER w AS DOUBLE) AS cumulative_total_points,
               best_finish, podiums, cars_classified, cars_entered, s.position AS championship_standing_position
        FROM team_results_t t JOIN race_details_t USING (season_year, round)
        JOIN constructors_t c ON c.constructor_id = t.constructor_id
        LEFT JOIN constructor_standings_t s
          ON s.season_year = t.season_year AND s.round = t.round AND s.constructor_id = t.constructor_id
        WINDOW w AS (PARTITION BY t.season_year, t.constructor_id ORDER BY t.round)"""
    ),
    "constructor_season": query(
        """
        SELECT t.*, constructor_name,
               (SELECT arg_max(position, round) FROM constructor_standings_t s WHERE s.season_year = t.season_year
                  AND s.constructor_id = t.constructor_id AND s.round <= t.up_to_round) AS championship_standing,
               (SELECT string_agg(driver_id, ',' ORDER BY d.total_points DESC, driver_name) FROM contribution_t d
                 WHERE d.season_year = t.season_year AND d.constructor_id = t.constructor_id) AS drivers
        FROM team_totals_t t JOIN constructors_t USING (constructor_id)"""
    ),
    "driver_contribution": query("SELECT * FROM contribution_t"),
    "latest_driver_standing": query(
        "SELECT season_year, driver_id, arg_max(position, round) AS championship_standing "
        "FROM driver_standings_t GROUP BY ALL"
    ),
    "season_teammates": query(
        f"""
        SELECT e.season_year, (SELECT max(round) FROM races_t r WHERE r.season_year = e.season_year) AS up_to_round,
               constructor_id, constructor_name, driver_a_id, da.driver_name AS driver_a_name, driver_b_id,
               db.driver_name AS driver_b_name, count(*) AS rounds_together,
               count(*) FILTER (WHERE ahead_in_qualifying = driver_a_id) AS qualifying_head_to_head_a,
               count(*) FILTER (WHERE ahead_in_qualifying = driver_b_id) AS qualifying_head_to_head_b,
               count(*) FILTER (WHERE is_comparable_qualifying) AS qualifying_comparable_rounds,
               count(*) FILTER (WHERE ahead_in_race = driver_a_id) AS race_head_to_head_a,
               count(*) FILTER (WHERE ahead_in_race = driver_b_id) AS race_head_to_head_b,
               count(*) FILTER (WHERE is_comparable_finish) AS race_comparable_rounds,
               CAST(sum(points_a) AS DOUBLE) AS points_a, CAST(sum(points_b) AS DOUBLE) AS points_b,
               CAST(sum(sprint_points_a) AS DOUBLE) AS sprint_points_a,
               CAST(sum(sprint_points_b) AS DOUBLE) AS sprint_points_b,
               CAST(sum(points_a + sprint_points_a) AS DOUBLE) AS total_points_a,
               CAST(sum(points_b + sprint_points_b) AS DOUBLE) AS total_points_b
        FROM teammate_events_t e {PAIR_NAMES} GROUP BY ALL"""
    ),
    "driver_conversion": query(
        """
        SELECT c.season_year, c.driver_id, driver_name, c.constructor_id, constructor_name, total_poles, wins_from_pole,
               pole_to_win_rate, front_row_starts, front_row_podiums, front_row_podium_rate, top10_starts,
               top10_conversions, top10_conversion_rate, rounds_included, pit_lane_starts_count, dns_count
        FROM conversion_t c JOIN drivers_t USING (driver_id)
        LEFT JOIN constructors_t k ON k.constructor_id = c.constructor_id"""
    ),
    "grid_tiers": query("SELECT * FROM tiers_t"),
    "completed_rounds": query("SELECT DISTINCT season_year, round FROM race_results_t"),
    "attrition_phase": query("SELECT * FROM attrition_t WHERE period_name NOT LIKE 'R%'"),
    "attrition_round": query("SELECT * FROM attrition_t WHERE period_name LIKE 'R%'"),
    "attrition_in_winning_spans": query(
        """
        SELECT w.season_year, w.driver_id, start_round, end_round, count(s.state) AS entries,
               count(*) FILTER (WHERE state <> 'DNS') AS starts,
               count(*) FILTER (WHERE state = 'CLASSIFIED') AS classified_finishes,
               count(*) FILTER (WHERE state = 'DNF') AS dnf_results, count(*) FILTER (WHERE state = 'DNS') AS dns_results,
               count(*) FILTER (WHERE state = 'DSQ') AS dsq_results,
               count(*) FILTER (WHERE state = 'UNKNOWN') AS unknown_non_classified
        FROM (SELECT season_year, driver_id, min(round) AS start_round, max(round) AS end_round
              FROM race_results_t WHERE source_position = 1 GROUP BY ALL) w
        LEFT JOIN states_t s ON s.season_year = w.season_year AND s.round BETWEEN start_round AND end_round
        GROUP BY ALL"""
    ),
    "attrition_report": query(
        """
        SELECT p.season_year, p.up_to_round, p.period_name, p.is_complete,
               max(entries) FILTER (WHERE level = 'total') AS entries,
               max(dnf_rate) FILTER (WHERE level = 'total') AS dnf_rate,
               count(*) FILTER (WHERE level = 'constructor') AS constructors,
               count(*) FILTER (WHERE level = 'driver') AS drivers
        FROM attrition_t p GROUP BY ALL"""
    ),
}
