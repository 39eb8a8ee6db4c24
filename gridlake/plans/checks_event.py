"""SQL for the table scans and the per-race views."""

from __future__ import annotations

from gridlake.plans.oracle import DRIVER, TEAM, cte, lap_text, query, seconds_text

cte(
    "teammate_qualifying_t",
    """
    SELECT a.season_year, a.round, a.constructor_id, a.driver_id AS driver_a_id, b.driver_id AS driver_b_id,
           a.best AS best_time_a_millis, b.best AS best_time_b_millis, a.best - b.best AS delta_millis
    FROM best_times_t a JOIN best_times_t b
      ON a.season_year = b.season_year AND a.round = b.round AND a.constructor_id = b.constructor_id
     AND a.driver_id < b.driver_id""",
)
cte(
    "teammate_deltas_t",
    """
    SELECT a.season_year, a.round, a.constructor_id, a.driver_id AS driver_a_id, b.driver_id AS driver_b_id,
           qa.best - qb.best AS qualifying_delta_millis, a.grid_position - b.grid_position AS grid_delta,
           a.source_position - b.source_position AS finish_delta, a.points - b.points AS points_delta
    FROM race_results_t a JOIN race_results_t b
      ON a.season_year = b.season_year AND a.round = b.round AND a.constructor_id = b.constructor_id
     AND a.driver_id < b.driver_id
    LEFT JOIN best_times_t qa ON qa.season_year = a.season_year AND qa.round = a.round AND qa.driver_id = a.driver_id
    LEFT JOIN best_times_t qb ON qb.season_year = a.season_year AND qb.round = a.round AND qb.driver_id = b.driver_id""",
)
cte(
    "driver_events_t",
    """
    SELECT r.season_year, r.round, r.constructor_id, r.driver_id, r.grid_position AS grid,
           CASE WHEN r.ok THEN r.source_position END AS finish, r.status, r.points,
           coalesce(s.points, 0) AS sprint_points, q.qpos, q.best
    FROM race_results_t r
    LEFT JOIN best_times_t q USING (season_year, round, driver_id)
    LEFT JOIN sprint_t s USING (season_year, round, driver_id)""",
)
cte(
    "teammate_events_t",
    """
    SELECT a.season_year, a.round, a.constructor_id, a.driver_id AS driver_a_id, b.driver_id AS driver_b_id,
           a.qpos AS qualifying_a_pos, b.qpos AS qualifying_b_pos, a.best - b.best AS qualifying_delta_millis,
           a.grid AS grid_a, b.grid AS grid_b, a.finish AS finish_a, b.finish AS finish_b,
           a.status AS status_a, b.status AS status_b, a.points AS points_a, b.points AS points_b,
           a.sprint_points AS sprint_points_a, b.sprint_points AS sprint_points_b,
           a.qpos IS NOT NULL AND b.qpos IS NOT NULL AS is_comparable_qualifying,
           a.finish IS NOT NULL AND b.finish IS NOT NULL AS is_comparable_finish,
           CASE WHEN a.qpos < b.qpos THEN a.driver_id WHEN b.qpos < a.qpos THEN b.driver_id END AS ahead_in_qualifying,
           CASE WHEN a.finish < b.finish THEN a.driver_id WHEN b.finish < a.finish THEN b.driver_id END AS ahead_in_race
    FROM driver_events_t a JOIN driver_events_t b
      ON a.season_year = b.season_year AND a.round = b.round AND a.constructor_id = b.constructor_id
     AND a.driver_id < b.driver_id""",
)
PAIR_NAMES = """
    JOIN constructors_t c USING (constructor_id)
    JOIN drivers_t da ON da.driver_id = driver_a_id JOIN drivers_t db ON db.driver_id = driver_b_id"""
PAIR_COLUMNS = """season_year, round, constructor_id, constructor_name, driver_a_id, da.driver_name AS driver_a_name,
    driver_b_id, db.driver_name AS driver_b_name"""



def _part(name: str, table: str, order: str, *fields: str, where: str = "") -> str:
    """A table's rows of each race as one text, in order."""
    shown = " || ':' || ".join(f"coalesce(CAST({f} AS VARCHAR), '-')" for f in fields)
    return (
        f"(SELECT season_year, round, count(*) AS {name}_n, string_agg({shown}, ',' ORDER BY {order}) AS {name} "
        f"FROM {table} {where} GROUP BY season_year, round)"
    )


_LAP_SUMS = """(SELECT season_year, round, driver_id, count(*) AS n, min(time_millis) AS fastest,
    sum(time_millis) // count(time_millis) AS average FROM lap_times_t GROUP BY ALL)"""
_PIT_SUMS = """(SELECT season_year, round, driver_id, max(stop_number) AS stops, sum(duration_millis) AS total,
    min(duration_millis) AS fastest FROM pit_stops_t GROUP BY ALL)"""
_TEAM_PIT_SUMS = """(SELECT season_year, round, constructor_id, count(*) AS stops,
    sum(duration_millis) // count(duration_millis) AS average
    FROM pit_stops_t JOIN race_results_t USING (season_year, round, driver_id) GROUP BY ALL)"""
_DOCUMENT_PARTS = {
    "results": _part("results", "race_results_t", "source_position NULLS LAST, driver_id",
                     "driver_id", "source_position", "status", "time_text"),
    "grid_vs_finish": _part("grid_vs_finish", "race_results_t", "source_position NULLS LAST, driver_id",
                            "driver_id", "grid_position", "(grid_position - source_position)"),
    "qualifying": _part("qualifying", "qualifying_t", "position", "driver_id", "position", "q1", "q2", "q3"),
    "teammate_qualifying": _part(
        "teammate_qualifying", "teammate_qualifying_t", "constructor_id",
        "constructor_id", "da.driver_name", "db.driver_name", "delta_millis",
        where="JOIN drivers_t da ON da.driver_id = driver_a_id JOIN drivers_t db ON db.driver_id = driver_b_id"),
    "pit_stops": _part("pit_stops", _PIT_SUMS, "stops DESC, driver_id", "driver_id", "stops", "total", "fastest"),
    "constructor_pit_stops": _part("constructor_pit_stops", _TEAM_PIT_SUMS, "constructor_id",
                                   "constructor_id", "stops", "CAST(average AS BIGINT)"),
    "lap_times": _part("lap_times", _LAP_SUMS, "fastest NULLS LAST, driver_id",
                       "driver_id", "n", "fastest", "CAST(average AS BIGINT)"),
    "driver_standings": _part("driver_standings", "driver_standings_t", "position", "driver_id", "position", "CAST(wins AS BIGINT)"),
    "constructor_standings": _part("constructor_standings", "constructor_standings_t", "position",
                                   "constructor_id", "position", "CAST(wins AS BIGINT)"),
}

SQL = {
    "scan_seasons": query("SELECT DISTINCT season_year, CAST(NULL AS VARCHAR) AS url FROM entry"),
    "scan_circuits": query(
        "SELECT circuit_id, circuit_name, locality, country, CAST(latitude AS DOUBLE) AS latitude, "
        "CAST(longitude AS DOUBLE) AS longitude FROM circuits_t"
    ),
    "scan_constructors": query("SELECT constructor_id, constructor_name AS name, nationality FROM constructors_t"),
    "scan_drivers": query(
        "SELECT driver_id, permanent_number, code, given_name, family_name, "
        "CAST(date_of_birth AS VARCHAR) AS date_of_birth, nationality FROM drivers_t"
    ),
    "scan_races": query(
        "SELECT season_year, round, race_name, circuit_id, CAST(race_date AS VARCHAR) AS race_date, "
        "'14:00:00' AS race_time FROM races_t"
    ),
    "scan_race_results": query(
        "SELECT * EXCLUDE (ok, points), CAST(points AS DOUBLE) AS points FROM race_results_t"
    ),
    "scan_qualifying_results": query(
        "SELECT season_year, round, driver_id, constructor_id, car_number, position, q1 AS q1_time_millis, "
        "q2 AS q2_time_millis, q3 AS q3_time_millis, "
        + ", ".join(f"CASE WHEN {q} IS NOT NULL THEN {lap_text(q)} END AS {q}_time" for q in ("q1", "q2", "q3"))
        + " FROM qualifying_t"
    ),
    # A sprint has a fixed number of laps and no times.
    "scan_sprint_results": query(
        f"""SELECT season_year, round, {DRIVER} AS driver_id, {TEAM} AS constructor_id, suppkey % 100 AS car_number,
            grid_position, sprint_rank AS source_position, CAST(sprint_rank AS VARCHAR) AS position_text,
            CAST(sprint_points AS DOUBLE) AS points, CAST(20 AS BIGINT) AS laps_completed, 'Finished' AS status,
            CAST(NULL AS BIGINT) AS time_millis, CAST(NULL AS VARCHAR) AS time_text,
            CAST(NULL AS BIGINT) AS fastest_lap_rank, CAST(NULL AS BIGINT) AS fastest_lap_number,
            CAST(NULL AS VARCHAR) AS fastest_lap_time, CAST(NULL AS BIGINT) AS fastest_lap_time_millis
            FROM entry_scored WHERE sprint_points IS NOT NULL"""
    ),
    "scan_lap_times": query("SELECT * FROM lap_times_t"),
    "scan_pit_stops": query(
        f"SELECT *, printf('15:%02d:00', lap % 60) AS time_of_day, {seconds_text('duration_millis')} AS duration_text "
        "FROM pit_stops_t"
    ),
    "list_races": query(
        "SELECT season_year, round, race_name, circuit_id, circuit_name, locality, country, "
        "CAST(race_date AS VARCHAR) AS race_date FROM races_t JOIN circuits_t USING (circuit_id)"
    ),
    "existing_races": query(
        "SELECT season_year, round FROM races_t r WHERE EXISTS (SELECT 1 FROM races_t q "
        "WHERE q.season_year = r.season_year AND q.round = r.round - 1)"
    ),
    # Blanks and case of the source text do not matter.
    "attrition_class": query(
        """SELECT season_year, round, driver_id,
        CASE WHEN lower(trim(status)) IN ('did not start', 'withdrawn', 'dns') OR upper(trim(position_text)) IN ('W', 'DNS')
               THEN 'DNS'
             WHEN lower(trim(status)) = 'disqualified' OR upper(trim(position_text)) = 'D' THEN 'DSQ'
             WHEN lower(trim(status)) = 'retired' OR upper(trim(position_text)) = 'R' THEN 'DNF'
             WHEN trim(position_text) <> '' OR lower(trim(status)) IN ('finished', 'lapped') OR starts_with(trim(status), '+')
               THEN 'CLASSIFIED'
             ELSE 'UNKNOWN_NON_CLASSIFIED' END AS state FROM race_results_t"""
    ),
    "race_overview": query(
        """
        SELECT d.season_year, d.round, race_name, circuit_name, race_date,
               max(given_name) FILTER (WHERE source_position = 1) AS winner_given_name,
               max(family_name) FILTER (WHERE source_position = 1) AS winner_family_name,
               max(constructor_name) FILTER (WHERE source_position = 1) AS winner_constructor,
               max(time_millis) FILTER (WHERE source_position = 1) AS winner_time_millis,
               max(time_text) FILTER (WHERE source_position = 1) AS winner_time_text,
               count(source_position) AS classified_count, count(r.driver_id) AS total_result_count
        FROM race_details_t d LEFT JOIN race_results_t r USING (season_year, round)
        LEFT JOIN drivers_t USING (driver_id) LEFT JOIN constructors_t USING (constructor_id)
        GROUP BY ALL"""
    ),
    "race_results": query(
        """
        SELECT r.* EXCLUDE (ok, points), CAST(points AS DOUBLE) AS points, given_name, family_name, constructor_name
        FROM race_results_t r JOIN drivers_t USING (driver_id) JOIN constructors_t USING (constructor_id)"""
    ),
    "grid_vs_finish": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, constructor_name, grid_position,
               source_position AS finish_position, grid_position - source_position AS position_change, status,
               CAST(points AS DOUBLE) AS points
        FROM race_results_t JOIN drivers_t USING (driver_id) JOIN constructors_t USING (constructor_id)"""
    ),
    "race_classification": query(
        """
        SELECT season_year, round, count(*) AS results,
               string_agg(driver_id || ':' || coalesce(CAST(grid_position - source_position AS VARCHAR), '-'), ','
                          ORDER BY source_position NULLS LAST, driver_id) AS running_order
        FROM race_results_t GROUP BY ALL"""
    ),
    "race_documents": query(
        "SELECT season_year, round, race_name, coalesce(results_n, 0) AS total_result_count, "
        + ", ".join(f"coalesce({p}_n, 0) AS {p}_n, coalesce({p}, '') AS {p}" for p in _DOCUMENT_PARTS)
        + " FROM races_t "
        + " ".join(f"LEFT JOIN {sql} USING (season_year, round)" for sql in _DOCUMENT_PARTS.values())
    ),
    "results_as_of_scoring": query(
        """
        SELECT r.season_year, r.round, r.driver_id, r.source_position, s.round AS standing_round,
               s.position AS standing_position, CAST(s.points AS DOUBLE) AS standing_points
        FROM race_results_t r LEFT JOIN driver_standings_t s ON s.season_year = r.season_year AND s.driver_id = r.driver_id
         AND s.round = (SELECT max(p.round) FROM race_results_t p WHERE p.season_year = r.season_year
                        AND p.driver_id = r.driver_id AND p.round <= r.round AND p.points > 0)"""
    ),
    "qualifying_order": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, constructor_name, position,
               q1 AS q1_time_millis, q2 AS q2_time_millis, q3 AS q3_time_millis
        FROM qualifying_t JOIN drivers_t USING (driver_id) JOIN constructors_t USING (constructor_id)"""
    ),
    "driver_standings": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, position, CAST(points AS DOUBLE) AS points,
               CAST(wins AS BIGINT) AS wins
        FROM driver_standings_t JOIN drivers_t USING (driver_id)"""
    ),
    "constructor_standings": query(
        """
        SELECT season_year, round, constructor_id, constructor_name, position, CAST(points AS DOUBLE) AS points,
               CAST(wins AS BIGINT) AS wins
        FROM constructor_standings_t JOIN constructors_t USING (constructor_id)"""
    ),
    "driver_lap_times": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, count(*) AS lap_count,
               min(time_millis) AS fastest_lap_millis,
               CAST(sum(time_millis) // count(time_millis) AS BIGINT) AS avg_lap_millis
        FROM lap_times_t JOIN drivers_t USING (driver_id) GROUP BY ALL"""
    ),
    "driver_pit_stops": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, max(stop_number) AS stop_count,
               CAST(sum(duration_millis) AS BIGINT) AS total_duration_millis,
               CAST(sum(duration_millis) // count(duration_millis) AS BIGINT) AS avg_duration_millis,
               min(duration_millis) AS fastest_stop_millis
        FROM pit_stops_t JOIN drivers_t USING (driver_id) GROUP BY ALL"""
    ),
    "constructor_pit_stops": query(
        """
        SELECT season_year, round, constructor_id, constructor_name,
               count(*) AS total_stops,
               CAST(sum(duration_millis) // count(duration_millis) AS BIGINT) AS avg_duration_millis,
               min(duration_millis) AS fastest_stop_millis
        FROM pit_stops_t JOIN race_results_t USING (season_year, round, driver_id)
        JOIN constructors_t USING (constructor_id) GROUP BY ALL"""
    ),
    "driver_race_summary": query(
        """
        SELECT season_year, round, driver_id, given_name, family_name, constructor_name, grid_position,
               source_position AS finish_position, grid_position - source_position AS position_change,
               CAST(points AS DOUBLE) AS points, laps_completed, status,
               (SELECT count(*) FROM pit_stops_t p WHERE p.season_year = r.season_year AND p.round = r.round
                  AND p.driver_id = r.driver_id) AS pit_stop_count,
               time_millis AS race_time_millis
        FROM race_results_t r JOIN drivers_t USING (driver_id) JOIN constructors_t USING (constructor_id)"""
    ),
    "teammate_qualifying": query(
        f"SELECT {PAIR_COLUMNS}, best_time_a_millis, best_time_b_millis, delta_millis "
        f"FROM teammate_qualifying_t {PAIR_NAMES}"
    ),
    "teammate_comparison": query(
        f"SELECT {PAIR_COLUMNS}, qualifying_delta_millis, grid_delta, finish_delta, "
        f"CAST(points_delta AS DOUBLE) AS points_delta FROM teammate_deltas_t {PAIR_NAMES}"
    ),
    "event_teammates": query(
        f"""SELECT {PAIR_COLUMNS}, 'Grand Prix ' || CAST(round AS VARCHAR) AS race_name,
            t.* EXCLUDE (season_year, round, constructor_id, driver_a_id, driver_b_id, points_a, points_b,
                         sprint_points_a, sprint_points_b),
            CAST(points_a AS DOUBLE) AS points_a, CAST(points_b AS DOUBLE) AS points_b,
            CAST(sprint_points_a AS DOUBLE) AS sprint_points_a, CAST(sprint_points_b AS DOUBLE) AS sprint_points_b
            FROM teammate_events_t t {PAIR_NAMES}"""
    ),
}
