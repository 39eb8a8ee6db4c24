"""Independent SQL over the star-schema tables, for checking the Spark plans.

Each table or view the checks share is one common table expression; ``query``
puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def query(body: str) -> str:
    """The statement with every common table expression it refers to, directly or not."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(sql)
    ordered = [f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed]
    return f"WITH {', '.join(ordered)} {body}" if ordered else body


def slug(prefix: str, key: str, width: int = 12) -> str:
    return f"'{prefix}' || lpad(CAST({key} AS VARCHAR), {width}, '0')"


def half_even(value: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


DRIVER = slug("driver_", "suppkey")
TEAM = slug("team_", "suppkey // 2")


def lap_text(ms: str) -> str:
    return f"printf('%d:%02d.%03d', {ms} // 60000, {ms} // 1000 % 60, {ms} % 1000)"


def race_text(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def seconds_text(ms: str) -> str:
    return f"printf('%d.%03d', {ms} // 1000, {ms} % 1000)"


def classified(position_text: str, status: str) -> str:
    return (
        f"(regexp_full_match(coalesce({position_text}, ''), '[0-9]+') AND lower(coalesce({status}, '')) "
        "NOT IN ('retired', 'did not start', 'disqualified', 'withdrawn'))"
    )


cte(
    "rec",
    """
    SELECT (l_suppkey // 20) * 10000 + year(o_orderdate) AS season_year,
           month(o_orderdate) * 2 - CASE WHEN day(o_orderdate) > 15 THEN 0 ELSE 1 END AS round,
           l_suppkey AS suppkey, l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
           CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price,
           CAST(floor(l_quantity * 100 + 0.5) AS BIGINT) AS quantity,
           CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS discount,
           CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
cte(
    "entry",
    """
    SELECT season_year, round, suppkey, count(*) AS laps,
           CAST(sum(price) AS BIGINT) AS price, CAST(sum(quantity) AS BIGINT) AS quantity,
           CAST(sum(discount) AS BIGINT) AS discount, CAST(sum(tax) AS BIGINT) AS tax,
           min(CASE WHEN tax <> 8 THEN 60000 + price // 100 % 40000 END) AS fastest,
           (suppkey * 7 + season_year * 13 + round * 5) % 20 AS mark
    FROM rec GROUP BY ALL""",
)
cte(
    "entry_ranked",
    """
    SELECT *,
           row_number() OVER (PARTITION BY season_year, round ORDER BY quantity + (19 - suppkey % 20) * 1000 DESC, suppkey) AS grid_rank,
           row_number() OVER (PARTITION BY season_year, round ORDER BY price + (19 - suppkey % 20) * 2000000 DESC, suppkey) AS finish_rank,
           row_number() OVER (PARTITION BY season_year, round ORDER BY tax DESC, suppkey) AS sprint_rank,
           row_number() OVER (PARTITION BY season_year, round ORDER BY fastest NULLS LAST, suppkey) AS fl_rank
    FROM entry""",
)
cte(
    "entry_placed",
    f"""
    SELECT *, {classified('position_text', 'status')} AS ok FROM (
      SELECT *,
           CASE mark WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE grid_rank END AS grid_position,
           CASE WHEN mark <> 6 THEN finish_rank END AS source_position,
           CASE WHEN mark = 0 THEN 'W' WHEN mark = 1 THEN 'D' WHEN mark IN (2, 5) THEN 'R' WHEN mark = 6 THEN ''
                ELSE CAST(finish_rank AS VARCHAR) END AS position_text,
           CASE WHEN mark = 0 THEN 'Did not start' WHEN mark = 1 THEN 'Disqualified'
                WHEN mark IN (2, 5) THEN 'Retired' WHEN mark = 6 THEN 'Engine'
                WHEN mark IN (7, 8) THEN '+1 Lap' ELSE 'Finished' END AS status
      FROM entry_ranked)""",
)
cte(
    "entry_scored",
    """
    SELECT *,
           CASE WHEN ok AND source_position <= 10
                THEN [25, 18, 15, 12, 10, 8, 6, 4, 2, 1][source_position] ELSE 0 END AS points,
           CASE WHEN round IN (5, 6, 11, 18, 19, 23) THEN greatest(0, 9 - sprint_rank) END AS sprint_points,
           CASE WHEN ok THEN 5400000 + source_position * 1500 + price // 100 % 1000 END AS time_millis
    FROM entry_placed""",
)
cte(
    "entry_timed",
    """
    SELECT *,
           min(time_millis) OVER (PARTITION BY season_year, round) AS winning_millis,
           sum(points + coalesce(sprint_points, 0)) OVER (PARTITION BY season_year, suppkey ORDER BY round) AS season_points,
           sum(CASE WHEN ok AND source_position = 1 THEN 1 ELSE 0 END)
             OVER (PARTITION BY season_year, suppkey ORDER BY round) AS season_wins
    FROM entry_scored""",
)
cte(
    "race_results_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id, {TEAM} AS constructor_id, suppkey % 100 AS car_number,
           grid_position, source_position, position_text, points, laps AS laps_completed, status, time_millis,
           CASE WHEN time_millis = winning_millis THEN {race_text('time_millis')}
                WHEN time_millis > winning_millis THEN '+' || {seconds_text('(time_millis - winning_millis)')} END AS time_text,
           CASE WHEN fastest IS NOT NULL THEN fl_rank END AS fastest_lap_rank,
           CASE WHEN fastest IS NOT NULL THEN price % laps + 1 END AS fastest_lap_number,
           CASE WHEN fastest IS NOT NULL THEN {lap_text('fastest')} END AS fastest_lap_time,
           fastest AS fastest_lap_time_millis, ok
    FROM entry_timed""",
)
cte(
    "qualifying_ranked",
    """
    SELECT *, row_number() OVER (PARTITION BY season_year, round ORDER BY discount + (19 - suppkey % 20) * 5 DESC, suppkey) AS position
    FROM entry WHERE mark <> 9""",
)
cte(
    "qualifying_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id, {TEAM} AS constructor_id, suppkey % 100 AS car_number, position,
           80000 + price // 100 % 20000 AS q1,
           CASE WHEN position <= 15 THEN 79500 + price // 100 % 20000 + quantity // 100 % 300 END AS q2,
           CASE WHEN position <= 10 THEN 79300 + price // 100 % 20000 + quantity // 100 % 900 END AS q3
    FROM qualifying_ranked""",
)
cte(
    "sprint_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id, {TEAM} AS constructor_id, sprint_rank AS source_position,
           sprint_points AS points
    FROM entry_scored WHERE sprint_points IS NOT NULL""",
)
cte(
    "driver_standings_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id, season_points AS points, season_wins AS wins,
           row_number() OVER (PARTITION BY season_year, round
                              ORDER BY season_points DESC, season_wins DESC, suppkey) AS position
    FROM entry_timed""",
)
cte(
    "team_rounds",
    """
    SELECT season_year, round, suppkey // 2 AS team, sum(points + coalesce(sprint_points, 0)) AS pts,
           max(CASE WHEN ok AND source_position = 1 THEN 1 ELSE 0 END) AS won
    FROM entry_scored GROUP BY ALL""",
)
cte(
    "team_running",
    """
    SELECT season_year, round, team, sum(pts) OVER w AS points, sum(won) OVER w AS wins
    FROM team_rounds WINDOW w AS (PARTITION BY season_year, team ORDER BY round)""",
)
cte(
    "constructor_standings_t",
    f"""
    SELECT season_year, round, {slug('team_', 'team')} AS constructor_id, points, wins,
           row_number() OVER (PARTITION BY season_year, round ORDER BY points DESC, wins DESC, team) AS position
    FROM team_running""",
)
cte(
    "laps_numbered",
    """
    SELECT *, row_number() OVER (PARTITION BY season_year, round, suppkey
               ORDER BY (orderkey + linenumber * 31 + partkey * 961 + price) % 1024,
                        orderkey, linenumber, partkey, price, quantity, discount, tax) AS lap_number,
           CASE WHEN tax <> 8 THEN 60000 + price // 100 % 40000 END AS time_millis
    FROM rec""",
)
cte(
    "lap_times_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id, lap_number, suppkey % 20 + 1 AS position,
           CASE WHEN time_millis IS NULL THEN '' ELSE {lap_text('time_millis')} END AS time, time_millis
    FROM laps_numbered""",
)
cte(
    "pit_stops_t",
    f"""
    SELECT season_year, round, {DRIVER} AS driver_id,
           row_number() OVER (PARTITION BY season_year, round, suppkey ORDER BY lap_number) AS stop_number,
           lap_number AS lap, 20000 + time_millis % 15000 AS duration_millis
    FROM laps_numbered WHERE discount >= 9""",
)
cte(
    "drivers_t",
    f"""
    SELECT {slug('driver_', 's_suppkey')} AS driver_id, s_suppkey % 100 AS permanent_number,
           'D' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS code,
           split_part(s_name, '#', 1) AS given_name, split_part(s_name, '#', 2) AS family_name,
           split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS driver_name,
           DATE '1970-01-01' + CAST(s_suppkey * 37 % 9000 AS INTEGER) AS date_of_birth, n_name AS nationality
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
cte(
    "constructors_t",
    f"""
    SELECT {slug('team_', 's_suppkey // 2')} AS constructor_id,
           'Team ' || CAST(s_suppkey // 2 AS VARCHAR) AS constructor_name, min(n_name) AS nationality
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
cte(
    "circuits_t",
    f"""
    SELECT {slug('circuit_', 'n_nationkey', 2)} AS circuit_id, n_name || ' Ring' AS circuit_name,
           n_name AS locality, r_name AS country,
           n_nationkey * 3 - 36 AS latitude, n_nationkey * 7 - 84 AS longitude
    FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "races_t",
    f"""
    SELECT DISTINCT season_year, round, 'Grand Prix ' || CAST(round AS VARCHAR) AS race_name,
           {slug('circuit_', 'round', 2)} AS circuit_id,
           make_date(CAST(season_year % 10000 AS BIGINT), CAST((round + 1) // 2 AS BIGINT),
                     CASE WHEN round % 2 = 1 THEN 1 ELSE 16 END) AS race_date
    FROM entry""",
)
cte(
    "race_details_t",
    """
    SELECT season_year, round, race_name, circuit_name, CAST(race_date AS VARCHAR) AS race_date
    FROM races_t JOIN circuits_t USING (circuit_id)""",
)
cte(
    "best_times_t",
    """
    SELECT season_year, round, driver_id, constructor_id, position AS qpos, coalesce(q3, q2, q1) AS best
    FROM qualifying_t""",
)
