"""SQL for evidence, narratives, upserts and data quality."""

from __future__ import annotations

from gridlake.operators.rules import REGISTRY
from gridlake.plans.oracle import cte, half_even, query

cte(
    "numbered_t",
    """
    SELECT *, row_number() OVER (PARTITION BY season_year ORDER BY category, rule_id, subject_id, insight_id) AS n
    FROM season_insights_t""",
)
cte(
    "told_t",
    """
    SELECT season_year, string_agg(sentence, ' ' ORDER BY n) AS narrative FROM (
      SELECT season_year, n, CASE WHEN season_year % 4 = 0 THEN explanation
             WHEN direction = 'faster' AND (season_year + n) % 3 = 0
               THEN subject_id || ' was slower than ' || comparison_subject_id
             WHEN metric IN ('qualifying_win_rate', 'race_win_rate') AND (season_year + n) % 3 = 1
               THEN subject_id || ' won 0 of ' || sample_size
             WHEN metric IN ('qualifying_win_rate', 'race_win_rate') THEN subject_id || ' had a record of 0-' || sample_size
             WHEN direction = 'gained' THEN subject_id || ' lost positions'
             WHEN direction = 'lost' THEN subject_id || ' gained positions'
             WHEN season_year % 4 = 3 AND n % 2 = 0 THEN subject_id || ' finished all of them'
             ELSE 'noted' END AS sentence
      FROM numbered_t WHERE n <= 10) GROUP BY season_year""",
)
cte(
    "form_t",
    """
    SELECT season_year, 1 AS narrative_no, narrative, CASE WHEN season_year % 11 = 1 THEN 'not valid JSON'
           WHEN season_year % 17 = 3 THEN 'empty response'
           WHEN season_year % 13 = 2 THEN 'limitations is not a list' END AS problem
    FROM told_t
    UNION ALL SELECT season_year, 2, 'A season of many stories.', NULL FROM told_t""",
)
_B = "'\\b\\Q' || lower({0}) || '\\E\\b'"


def _says(words: str, tail: str = "''") -> str:
    return f"regexp_matches(lower(narrative), {_B.format('subject_id')} || '.*?\\b({words})\\b' || {tail})"


_N_ROUNDS = "(length(rounds_included) - length(replace(rounds_included, ',', '')) + 1)"
_WINS = "CAST(round_even(magnitude * sample_size, 0) AS BIGINT)"


def _pairs(pattern: str, wrong: str) -> str:
    first = f"regexp_extract_all(lower(narrative), '{pattern}', 1)"
    second = f"regexp_extract_all(lower(narrative), '{pattern}', 2)"
    return (
        f"len(list_filter(list_zip({first}, {second}), lambda z: (CAST(z[1] AS BIGINT), CAST(z[2] AS BIGINT)) IS NOT NULL "
        f"AND {wrong})) > 0"
    )


_W, _L = "CAST(z[1] AS BIGINT)", "CAST(z[2] AS BIGINT)"
_RECORD = "metric IN ('qualifying_win_rate', 'race_win_rate')"
cte(
    "contradictions_t",
    f"""
    SELECT season_year, narrative_no, n, insight_id, CASE
      WHEN direction = 'faster' AND {_says('slower|deficit|behind', "'.*?' || " + _B.format('comparison_subject_id'))}
        THEN 'says slower, evidence says faster'
      WHEN direction = 'gained' AND {_says('lost positions|dropped positions|lost ground')}
        THEN 'says positions lost, evidence says gained'
      WHEN direction = 'lost' AND {_says('gained positions|moved up|improved position')}
        THEN 'says positions gained, evidence says lost'
      WHEN excluded_observations > 0 AND (
          {_says('finished all|completed all|finished every|no dnfs?|never retired|100% finish')}
          OR regexp_matches(lower(narrative), '\\b(finished all|completed all)\\s+' || {_N_ROUNDS} || '\\b'))
        THEN 'says all races finished, evidence excludes some'
      WHEN {_RECORD} AND {_pairs(r'\b(\d+)\s+(?:of|out of)\s+(\d+)\b', f'{_L} = sample_size AND {_W} <> {_WINS}')}
        THEN 'states a wrong win ratio'
      WHEN {_RECORD} AND {_pairs(r'\b(\d+)\s*-\s*(\d+)\b', f'{_W} + {_L} = sample_size AND {_W} <> {_WINS}')}
        THEN 'states a wrong score'
      WHEN rule_id = 'LONGITUDINAL_RECENT_FORM' AND len(list_filter(
          regexp_extract_all(lower(narrative), '\\bacross\\s+(\\d+)\\s+valid finishes\\b', 1),
          lambda f: CAST(f AS BIGINT) <> sample_size)) > 0
        THEN 'states a wrong number of finishes' END AS reason
    FROM (SELECT season_year, narrative_no, narrative FROM form_t WHERE problem IS NULL)
    JOIN (SELECT * FROM numbered_t WHERE n <= 10) USING (season_year)""",
)
cte(
    "first_wrong_t",
    """
    SELECT season_year, narrative_no, arg_min(reason, n) AS reason, arg_min(insight_id, n) AS insight_id
    FROM contradictions_t WHERE reason IS NOT NULL GROUP BY season_year, narrative_no""",
)
cte("results_16_t", "SELECT * FROM race_results_t WHERE round <= 16")


def _stats(entity: str, source: str, updated: str) -> str:
    inserted = "count(*) FILTER (WHERE round > 16)"
    changed = f"count(*) FILTER (WHERE round <= 16 AND {updated})"
    return f"""
      SELECT '{entity}' AS entity_type, count(*) AS records_processed, {inserted} AS records_inserted,
             {changed} AS records_updated, count(*) - {inserted} - {changed} AS records_skipped FROM {source}"""


cte(
    "upsert_stats_t",
    " UNION ALL ".join(
        (
            _stats("race_results", "race_results_t", "status = '+1 Lap'"),
            _stats("qualifying_results", "qualifying_t", "FALSE"),
            _stats("sprint_results", "sprint_t", "FALSE"),
            _stats("pit_stops", "pit_stops_t", "FALSE"),
            _stats("lap_times", "lap_times_t", "FALSE"),
            _stats("driver_standings", "driver_standings_t", "position = 1"),
            _stats("constructor_standings", "constructor_standings_t", "position = 1"),
        )
    ),
)
_TABLES = {
    "seasons": "(SELECT DISTINCT season_year FROM entry)",
    "circuits": "circuits_t",
    "constructors": "constructors_t",
    "drivers": "drivers_t",
    "races": "races_t",
    "race_results": "race_results_t",
    "qualifying_results": "qualifying_t",
    "sprint_results": "sprint_t",
    "pit_stops": "pit_stops_t",
    "lap_times": "lap_times_t",
    "driver_standings": "driver_standings_t",
    "constructor_standings": "constructor_standings_t",
}
_KEYS = {
    "races": "season_year, round",
    "race_results": "season_year, round, driver_id",
    "qualifying_results": "season_year, round, driver_id",
    "sprint_results": "season_year, round, driver_id",
    "driver_standings": "season_year, round, driver_id",
    "constructor_standings": "season_year, round, constructor_id",
    "pit_stops": "season_year, round, driver_id, stop_number",
    "lap_times": "season_year, round, driver_id, lap_number",
}
_REFERENCES = [
    ("races", "seasons", "season_year"),
    ("races", "circuits", "circuit_id"),
    *[
        (child, parent, key)
        for child in ("race_results", "qualifying_results", "sprint_results")
        for parent, key in (("races", "season_year, round"), ("drivers", "driver_id"), ("constructors", "constructor_id"))
    ],
    *[
        (child, parent, key)
        for child in ("pit_stops", "lap_times")
        for parent, key in (("races", "season_year, round"), ("drivers", "driver_id"))
    ],
    ("driver_standings", "seasons", "season_year"),
    ("driver_standings", "drivers", "driver_id"),
    ("constructor_standings", "seasons", "season_year"),
    ("constructor_standings", "constructors", "constructor_id"),
]
# The same faults as in the Spark queries, written as conditions.
_TWICE = "driver_id LIKE '%7' AND round = 4"
_FAULTY = _TABLES | {
    "drivers": "(SELECT * FROM drivers_t WHERE driver_id NOT IN ('driver_000000000003', 'driver_000000000008'))",
    "races": "(SELECT * FROM races_t WHERE round % 5 <> 2)",
    **{
        n: f"(SELECT * FROM {_TABLES[n]} UNION ALL SELECT * FROM {_TABLES[n]} WHERE {_TWICE})"
        for n in ("race_results", "driver_standings")
    },
}
_DRIVER_KEY = "season_year, driver_id"
_DRIVER_REFERENCE = f"""
    SELECT {_DRIVER_KEY}, count(*) AS races_entered, count(*) FILTER (WHERE ok) AS races_classified,
           count(*) FILTER (WHERE NOT ok) AS non_classified, CAST(sum(r.points) AS DOUBLE) AS race_points,
           count(*) FILTER (WHERE r.source_position = 1) AS wins,
           {half_even('avg(r.source_position) FILTER (WHERE ok)', 2)} AS average_finish,
           {half_even('avg(grid_position) FILTER (WHERE grid_position > 0)', 2)} AS average_grid,
           coalesce((SELECT CAST(sum(points) AS DOUBLE) FROM sprint_t s WHERE s.season_year = r.season_year
                       AND s.driver_id = r.driver_id), 0) AS sprint_points
    FROM race_results_t r GROUP BY season_year, driver_id"""
cte("driver_reference_t", _DRIVER_REFERENCE)


def _compare(metric: str, ours: str) -> str:
    return f"""
      SELECT season_year, driver_id, '{metric}' AS metric, CAST(a.{metric} AS DOUBLE) AS left_value,
             CAST(b.{ours} AS DOUBLE) AS right_value,
             CASE WHEN a.{metric} IS NULL AND b.{ours} IS NULL OR abs(a.{metric} - b.{ours}) <= 0.01
                  THEN 'MATCH' ELSE 'DISCREPANCY' END AS verdict
      FROM driver_reference_t a FULL JOIN driver_totals_t b USING (season_year, driver_id)"""


_FIRED = (
    "SELECT rule_id, count(*) AS insights FROM (SELECT rule_id FROM season_insights_t UNION ALL "
    "SELECT rule_id FROM conversion_insights_t) GROUP BY rule_id"
)
_RULES = ", ".join(f"('{r.rule_id}', '{r.category}', '{r.metric}', {r.min_sample_size})" for r in REGISTRY.values())
SQL = {
    "evidence_records": query(
        """SELECT season_year, insight_id, 'longitudinal' AS scope, direction, sample_size,
        sample_size AS valid_observations, excluded_observations, rounds_included, minimum_sample_size, explanation
        FROM season_insights_t"""
    ),
    "evidence_package": query(
        """SELECT season_year, count(*) AS insights, 3 AS limitations,
        string_agg(insight_id, ',' ORDER BY n) AS insight_ids FROM numbered_t WHERE n <= 10 GROUP BY season_year"""
    ),
    "race_evidence_package": query(
        """SELECT season_year, round_num AS round, least(count(*), 10) AS insights, 3 AS limitations,
        arg_min(insight_id, category || ':' || rule_id || ':' || subject_id || ':' || insight_id) AS first_insight,
        'race' AS scope FROM race_insights_t GROUP BY season_year, round_num"""
    ),
    "narrative_checks": query(
        """SELECT season_year, narrative_no, CASE WHEN coalesce(problem, w.reason) IS NULL THEN 'ok' ELSE 'unavailable' END AS status,
        coalesce(problem, w.reason) AS reason, w.insight_id AS contradicted_insight,
        CASE WHEN problem IS NULL OR problem LIKE 'limitations%' THEN narrative END AS narrative,
        CASE WHEN problem IS NULL OR problem LIKE 'limitations%' THEN 'season' END AS evidence_references
        FROM form_t LEFT JOIN first_wrong_t w USING (season_year, narrative_no)"""
    ),
    "rule_registry": query(
        f"SELECT rule_id, category, metric, min_sample_size, coalesce(insights, 0) AS insights "
        f"FROM (VALUES {_RULES}) r(rule_id, category, metric, min_sample_size) LEFT JOIN ({_FIRED}) USING (rule_id)"
    ),
    "upsert_actions": query(
        """SELECT season_year, round, driver_id, status, CASE WHEN round > 16 THEN 'inserted'
        WHEN status = '+1 Lap' THEN 'updated' ELSE 'skipped' END AS action FROM race_results_t"""
    ),
    "upsert_lap_times": query(
        """SELECT season_year, round, driver_id, lap_number,
        CASE WHEN time = '' AND round <= 16 THEN 'IN PIT' ELSE time END AS time,
        CASE WHEN round > 16 THEN 'inserted' ELSE 'skipped' END AS action FROM lap_times_t"""
    ),
    "upsert_stats": query("SELECT * FROM upsert_stats_t"),
    "upsert_repeated": query(
        """SELECT 'race_results' AS entity_type, 2 * count(*) AS records_processed, CAST(0 AS BIGINT) AS records_inserted,
        2 * count(*) FILTER (WHERE status = '+1 Lap') AS records_updated,
        2 * count(*) FILTER (WHERE status IS DISTINCT FROM '+1 Lap') AS records_skipped FROM race_results_t
        UNION ALL
        SELECT 'lap_times', 2 * count(*), 0, count(*) FILTER (WHERE time = ''),
        2 * count(*) - count(*) FILTER (WHERE time = '') FROM lap_times_t"""
    ),
    "upsert_totals": query(
        "SELECT string_agg(entity_type, ',' ORDER BY entity_type) AS entity_type, "
        "CAST(sum(records_processed) AS BIGINT) AS records_processed, "
        "CAST(sum(records_inserted) AS BIGINT) AS records_inserted, "
        "CAST(sum(records_updated) AS BIGINT) AS records_updated, "
        "CAST(sum(records_skipped) AS BIGINT) AS records_skipped FROM upsert_stats_t"
    ),
    "missing_parents": query(
        "SELECT 'race_results' AS entity_type, 'races' AS missing_entity, season_year || '/' || round AS missing_id, "
        "count(*) AS rows FROM race_results_t WHERE round > 16 GROUP BY season_year, round"
    ),
    "ingestion_log": query(
        """SELECT 'SUCCESS' AS status, 18 AS runs,
        3 * (seasons + circuits + constructors + drivers) + early_races + early_results + 2 * (races + results)
          AS records_processed,
        seasons + circuits + constructors + drivers + races + results AS records_inserted,
        lapped AS records_updated,
        2 * (seasons + circuits + constructors + drivers) + early_races + early_results + races + results - lapped
          AS records_skipped
        FROM (SELECT (SELECT count(DISTINCT season_year) FROM entry) AS seasons, (SELECT count(*) FROM circuits_t) AS circuits,
          (SELECT count(*) FROM constructors_t) AS constructors, (SELECT count(*) FROM drivers_t) AS drivers,
          (SELECT count(*) FROM races_t) AS races, (SELECT count(*) FROM race_results_t) AS results,
          (SELECT count(*) FROM races_t WHERE round <= 16) AS early_races,
          (SELECT count(*) FROM race_results_t WHERE round <= 16) AS early_results,
          (SELECT count(*) FROM race_results_t WHERE round <= 16 AND status = '+1 Lap') AS lapped)
        UNION ALL SELECT 'FAILED', 1, 0, 0, 0, 0"""
    ),
    "idempotency": "SELECT CAST(0 AS BIGINT) AS inserted, TRUE AS counts_equal, TRUE AS is_idempotent",
    "baseline_preserved": query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS rows_before, count(*) AS rows_after, TRUE AS is_preserved "
            f"FROM {_TABLES[n]} WHERE round <= 16"
            for n in ("races", "race_results")
        )
    ),
    "table_counts": query(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {s}" for n, s in _TABLES.items())
    ),
    "duplicate_keys": query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, concat_ws('/', {k}) AS key, count(*) AS rows FROM {_TABLES[n]} "
            f"GROUP BY {k} HAVING count(*) > 1"
            for n, k in _KEYS.items()
        )
    ),
    "orphan_counts": query(
        " UNION ALL ".join(
            f"SELECT '{c}' AS entity_type, '{p}' AS missing_entity, count(*) AS orphans FROM {_TABLES[c]} "
            f"WHERE ({k}) NOT IN (SELECT ({k}) FROM {_TABLES[p]})"
            for c, p, k in _REFERENCES
        )
    ),
    "faulty_duplicate_keys": query(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, concat_ws('/', {k}) AS key, count(*) AS rows FROM {_FAULTY[n]} "
            f"GROUP BY {k} HAVING count(*) > 1"
            for n, k in _KEYS.items()
        )
    ),
    "faulty_orphan_counts": query(
        " UNION ALL ".join(
            f"SELECT '{c}' AS entity_type, '{p}' AS missing_entity, count(*) AS orphans FROM {_FAULTY[c]} "
            f"WHERE ({k}) NOT IN (SELECT ({k}) FROM {_FAULTY[p]})"
            for c, p, k in _REFERENCES
        )
    ),
    "faulty_orphan_keys": query(
        " UNION ALL ".join(
            f"SELECT 'pit_stops' AS entity_type, '{p}' AS missing_entity, concat_ws('/', {k}) AS missing_id, count(*) AS rows "
            f"FROM {_FAULTY['pit_stops']} WHERE ({k}) NOT IN (SELECT ({k}) FROM {_FAULTY[p]}) GROUP BY {k}"
            for p, k in (("races", "season_year, round"), ("drivers", "driver_id"))
        )
    ),
    "faulty_round_gaps": query(
        f"""SELECT s.season_year, n AS missing_round
        FROM (SELECT season_year, max(round) AS last FROM {_FAULTY['races']} r GROUP BY season_year) s
        JOIN generate_series(1, 24) g(n) ON n <= s.last
        ANTI JOIN {_FAULTY['races']} r ON r.season_year = s.season_year AND r.round = n"""
    ),
    "round_completeness": query(
        """SELECT season_year, round, race_name,
        (SELECT count(*) FROM race_results_t f WHERE f.season_year = r.season_year AND f.round = r.round) AS race_results,
        (SELECT count(*) FROM qualifying_t f WHERE f.season_year = r.season_year AND f.round = r.round) AS qualifying_results,
        (SELECT count(*) FROM sprint_t f WHERE f.season_year = r.season_year AND f.round = r.round) AS sprint_results,
        (SELECT count(*) FROM driver_standings_t f WHERE f.season_year = r.season_year AND f.round = r.round) AS driver_standings,
        (SELECT count(*) FROM constructor_standings_t f WHERE f.season_year = r.season_year AND f.round = r.round)
          AS constructor_standings
        FROM races_t r"""
    ),
    "round_gaps": query(
        """SELECT s.season_year, n AS missing_round FROM season_rounds_t s JOIN generate_series(1, 24) g(n)
        ON n <= up_to_round ANTI JOIN races_t r ON r.season_year = s.season_year AND r.round = n"""
    ),
    "sprint_rounds": query("SELECT DISTINCT season_year, round FROM sprint_t"),
    "participation": query(
        """SELECT driver_id, code,
        (SELECT count(*) FROM race_results_t f WHERE f.driver_id = d.driver_id) AS race_starts,
        (SELECT count(*) FROM qualifying_t f WHERE f.driver_id = d.driver_id) AS qualifying_entries,
        (SELECT count(*) FROM sprint_t f WHERE f.driver_id = d.driver_id) AS sprint_entries,
        (SELECT count(*) FROM driver_standings_t f WHERE f.driver_id = d.driver_id) AS standings_entries,
        (SELECT max(position) FROM driver_standings_t f WHERE f.driver_id = d.driver_id) AS worst_standing,
        NOT EXISTS (SELECT 1 FROM race_results_t f WHERE f.driver_id = d.driver_id) AS is_reference_only
        FROM drivers_t d"""
    ),
    "driver_reference": query("SELECT * FROM driver_reference_t"),
    "constructor_reference": query(
        """SELECT season_year, constructor_id, races_entered, total_car_starts, total_race_points AS race_points,
        (SELECT count(*) FROM race_results_t r WHERE r.season_year = t.season_year
           AND r.constructor_id = t.constructor_id AND r.source_position = 1) AS wins,
        total_sprint_points AS sprint_points FROM team_totals_t t"""
    ),
    "pair_reference": query(
        """SELECT season_year, constructor_id, driver_a_id AS driver_id_a, driver_b_id AS driver_id_b,
        count(*) FILTER (WHERE qualifying_a_pos < qualifying_b_pos) AS qualifying_a,
        count(*) FILTER (WHERE qualifying_a_pos > qualifying_b_pos) AS qualifying_b,
        count(*) FILTER (WHERE is_comparable_qualifying) AS qualifying_rounds,
        count(*) FILTER (WHERE finish_a < finish_b) AS race_a, count(*) FILTER (WHERE finish_a > finish_b) AS race_b,
        count(*) FILTER (WHERE is_comparable_finish) AS race_rounds
        FROM teammate_events_t GROUP BY ALL"""
    ),
    "last_rounds": query(
        f"""SELECT {_DRIVER_KEY}, {half_even('avg(finish)', 2)} AS average_finish,
        CAST(sum(race_points) AS DOUBLE) AS race_points, CAST(sum(sprint_points) AS DOUBLE) AS sprint_points,
        CAST(sum(total_points) AS DOUBLE) AS total_points, count(*) AS rounds
        FROM (SELECT *, row_number() OVER (PARTITION BY season_year, driver_id ORDER BY round DESC) AS n
              FROM driver_rounds_t) WHERE n <= 3 GROUP BY season_year, driver_id"""
    ),
    "points_rates": query(
        f"""SELECT p.season_year, d.driver_id, coalesce(grand_prix_starts, 0) AS grand_prix_starts,
        coalesce(rounds_entered, 0) AS rounds_entered, coalesce(total_race_points, 0) AS total_race_points,
        coalesce(total_sprint_points, 0) AS total_sprint_points,
        coalesce(total_championship_points, 0) AS total_points, points_per_gp_start, points_per_round_total,
        {half_even('total_championship_points / (SELECT count(*) FROM races_t r WHERE r.season_year = p.season_year)', 2)}
          AS points_per_calendar_round
        FROM drivers_t d LEFT JOIN points_stats_t p ON p.driver_id = d.driver_id"""
    ),
    "points_per_start_reference": query(
        f"""SELECT {_DRIVER_KEY}, count(*) FILTER (WHERE lower(status) <> 'did not start') AS starts,
        CAST(sum(points) AS DOUBLE) AS race_points,
        {half_even("sum(points) / nullif(count(*) FILTER (WHERE lower(status) <> 'did not start'), 0)", 4)} AS points_per_start
        FROM race_results_t GROUP BY season_year, driver_id"""
    ),
    "status_lookup": query(
        """SELECT season_year, round, driver_id, position_text, status,
        CASE WHEN status ILIKE '%disqualif%' OR lower(position_text) = 'dsq' THEN 'DSQ' ELSE 'DNS' END AS kind
        FROM race_results_t WHERE status ILIKE '%disqualif%' OR lower(position_text) = 'dsq'
          OR status ILIKE '%did not start%'"""
    ),
    "reconcile": query(
        " UNION ALL ".join(
            _compare(m, o)
            for m, o in (
                ("races_entered", "races_entered"),
                ("races_classified", "races_classified"),
                ("wins", "wins"),
                ("race_points", "total_race_points"),
                ("sprint_points", "total_sprint_points"),
                ("average_finish", "average_finish"),
            )
        )
    ),
    "pair_events": query(
        """SELECT season_year, round, constructor_id, driver_a_id, driver_b_id,
        CASE WHEN is_comparable_qualifying THEN coalesce(ahead_in_qualifying, 'TIE') ELSE 'EXCLUDED' END AS qualifying_winner,
        CASE WHEN NOT is_comparable_qualifying THEN 'missing qualifying: a=' || coalesce(CAST(qualifying_a_pos AS VARCHAR), 'none')
          || ', b=' || coalesce(CAST(qualifying_b_pos AS VARCHAR), 'none') END AS qualifying_exclusion,
        CASE WHEN is_comparable_finish THEN coalesce(ahead_in_race, 'TIE') ELSE 'EXCLUDED' END AS race_winner,
        nullif(concat_ws('; ',
          CASE WHEN finish_a IS NULL THEN driver_a_id || ' unclassified (status=' || status_a || ')' END,
          CASE WHEN finish_b IS NULL THEN driver_b_id || ' unclassified (status=' || status_b || ')' END), '') AS race_exclusion
        FROM teammate_events_t"""
    ),
}
