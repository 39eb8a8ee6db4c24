"""SQL for page parsing: what went into the pages has to come out again."""

from __future__ import annotations

from gridlake.plans.checks_event import SQL as EVENT
from gridlake.plans.oracle import query

_SAME = ("seasons", "circuits", "constructors", "drivers", "races", "qualifying_results", "sprint_results",
         "lap_times", "pit_stops")
SQL = {f"parse_{entity}": EVENT[f"scan_{entity}"] for entity in _SAME}
SQL |= {
    "parse_race_results": query(
        "SELECT * EXCLUDE (ok, points), CAST(points AS DOUBLE) AS points FROM race_results_t WHERE position_text <> ''"
    ),
    "parse_driver_standings": query(
        "SELECT season_year, round, driver_id, position, CAST(points AS DOUBLE) AS points, "
        "CAST(wins AS BIGINT) AS wins FROM driver_standings_t"
    ),
    "parse_constructor_standings": query(
        "SELECT season_year, round, constructor_id, position, CAST(points AS DOUBLE) AS points, "
        "CAST(wins AS BIGINT) AS wins FROM constructor_standings_t"
    ),
    "parse_rejects": query(
        "SELECT season_year, round, driver_id, 'positionText is missing or empty' AS reject_reason "
        "FROM race_results_t WHERE position_text = ''"
    ),
    "parse_wrong_table": query(
        "SELECT 'page has no RaceTable' AS reject_reason, count(*) AS rejected "
        "FROM (SELECT DISTINCT season_year, round FROM driver_standings_t)"
    ),
    "parse_documents": "SELECT 'page is not a JSON object' AS reject_reason, count(*) AS rejected FROM documents",
    "raw_records": query("SELECT circuit_id, country FROM circuits_t"),
    "page_series": query(
        """
        SELECT season_year || '/' || round || '/results' AS endpoint, count(*) AS pages, any_value(total) AS total,
               min(start) AS first_offset, max(start) + 4 AS covered,
               CAST(count(*) FILTER (WHERE start > reached) AS BIGINT) AS gaps,
               -- Complete if every record lies on some page.
               len(list_filter(range(any_value(total)), lambda x: len(list_filter(list(start), lambda s: x >= s AND x < s + 4)) = 0)) = 0
                 AS is_complete
        FROM (SELECT *, coalesce(max(start + 4) OVER (PARTITION BY season_year, round ORDER BY start
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
              FROM (SELECT season_year, round, total, n * 4 - CASE WHEN season_year % 5 = 2 AND n = 1 THEN 2
                           WHEN season_year % 5 = 3 AND n = 2 THEN 2 ELSE 0 END AS start
                    FROM (SELECT season_year, round, total, unnest(range(CAST(ceil(total / 4.0) AS BIGINT))) AS n
                          FROM (SELECT season_year, round, count(*) AS total FROM race_results_t GROUP BY ALL))
                    WHERE NOT (season_year % 5 IN (1, 3) AND n = 1)
                      AND NOT (season_year % 5 = 4 AND n = CAST(ceil(total / 4.0) AS BIGINT) - 1)))
        GROUP BY season_year, round"""
    ),
    "page_metadata": query(
        "SELECT season_year || '/' || round || '/driverstandings' AS endpoint, 100 AS \"limit\", 0 AS \"offset\", "
        "count(*) AS total, 'StandingsTable' AS tables, CAST(NULL AS VARCHAR) AS reject_reason "
        "FROM driver_standings_t GROUP BY season_year, round"
    ),
    "gap_times": query(
        """
        SELECT season_year, round, driver_id, CASE WHEN status = '+1 Lap' THEN status ELSE time_text END AS gap_text,
               CASE WHEN status = '+1 Lap' THEN NULL WHEN starts_with(time_text, '+') THEN time_millis - winning
                    ELSE time_millis END AS gap_millis, CAST(NULL AS VARCHAR) AS problem
        FROM (SELECT *, min(time_millis) OVER (PARTITION BY season_year, round) AS winning FROM race_results_t)"""
    ),
}
