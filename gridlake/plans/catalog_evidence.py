"""Registered queries: evidence, narratives, upserts and data quality.

Narratives to check are written from the insights themselves: most repeat
them, some contradict one, some are broken in form.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators import evidence, insights, quality, rules, season, upsert
from gridlake.plans.catalog_event import over_star
from gridlake.plans.ingest import DependencyError, RaceStore
from gridlake.session import working_folder
from gridlake.tables import INGEST_ORDER, NATURAL_KEYS, RaceTables

_PACKAGE = ["season_year"]


def _packaged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("season_year", F.col("traceability.season_year"))


def _season_package(t: RaceTables) -> DataFrame:
    """The season insights, stored because packages and checks read them repeatedly."""
    return _packaged(t.keep("season_insights", lambda: insights.season_insights(t)))


def _evidence_records(t: RaceTables) -> DataFrame:
    rows = evidence.evidence_records(_season_package(t))
    field = lambda path: F.get_json_object("record", path)
    return rows.select(
        "season_year",
        field("$.insight_id").alias("insight_id"),
        field("$.scope").alias("scope"),
        field("$.direction").alias("direction"),
        field("$.sample_size").cast("bigint").alias("sample_size"),
        field("$.valid_observations").cast("bigint").alias("valid_observations"),
        field("$.excluded_observations").cast("bigint").alias("excluded_observations"),
        F.regexp_replace(field("$.rounds_included"), r"[\[\]]", "").alias("rounds_included"),
        field("$.traceability.minimum_sample_size").cast("bigint").alias("minimum_sample_size"),
        field("$.explanation").alias("explanation"),
    )


def _evidence_packages(t: RaceTables) -> DataFrame:
    rows = evidence.evidence_packages(_season_package(t), _PACKAGE)
    ids = F.from_json(F.get_json_object("payload", "$.insights"), "array<struct<insight_id:string>>")
    return rows.select(
        "season_year",
        "insights",
        F.size("limitations").alias("limitations"),
        F.array_join(ids.getField("insight_id"), ",").alias("insight_ids"),
    )


def _race_packages(t: RaceTables) -> DataFrame:
    rows = insights.race_insights(t).withColumns(
        {"season_year": F.col("traceability.season_year"), "round": F.col("traceability.round_num")}
    )
    return evidence.evidence_packages(rows, ["season_year", "round"]).select(
        "season_year",
        "round",
        "insights",
        F.size("limitations").alias("limitations"),
        F.get_json_object("payload", "$.insights[0].insight_id").alias("first_insight"),
        F.get_json_object("payload", "$.insights[0].scope").alias("scope"),
    )


def write_narratives(rows: DataFrame) -> DataFrame:
    """Two raw answers per season: one from the season's first insights, one that claims nothing.

    The first repeats the insights of one season in four; the others twist what
    they can: who was faster, who won how often, whether places were won or
    lost, and who finished every race.
    """
    season_year, number = F.col("season_year"), F.col("insight_no")
    subject, size = F.col("subject_id"), F.col("sample_size").cast("string")
    turn = (season_year + number) % 3
    rated = F.col("metric").isin("qualifying_win_rate", "race_win_rate")
    false_claim = (
        F.when(
            (F.col("direction") == "faster") & (turn == 0),
            F.concat(subject, F.lit(" was slower than "), F.col("comparison_subject_id")),
        )
        .when(rated & (turn == 1), F.concat(subject, F.lit(" won 0 of "), size))
        .when(rated, F.concat(subject, F.lit(" had a record of 0-"), size))
        .when(F.col("direction") == "gained", F.concat(subject, F.lit(" lost positions")))
        .when(F.col("direction") == "lost", F.concat(subject, F.lit(" gained positions")))
        .when((season_year % 4 == 3) & (number % 2 == 0), F.concat(subject, F.lit(" finished all of them")))
        .otherwise("noted")
    )
    sentence = F.when(season_year % 4 == 0, F.col("explanation")).otherwise(false_claim)
    told = (
        evidence.numbered(rows, _PACKAGE)
        .groupBy(*_PACKAGE)
        .agg(F.array_sort(F.collect_list(F.struct("insight_no", sentence.alias("s")))).getField("s").alias("s"))
    )

    def body(text: Column, limitations: Column) -> Column:
        return F.to_json(
            F.struct(text.alias("narrative"), limitations.alias("limitations"), F.array(F.lit("season")).alias("evidence_references"))
        )

    observed = F.array(F.lit("observed rounds only"))
    json = body(F.array_join("s", " "), F.when(season_year % 13 != 2, observed))
    raw = (
        F.when(season_year % 11 == 1, F.concat(F.lit("Answer: "), json))
        .when(season_year % 17 == 3, F.lit("  "))
        .when(season_year % 5 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .otherwise(json)
    )
    answers = F.array(
        F.struct(F.lit(1).alias("narrative_no"), raw.alias("raw")),
        F.struct(F.lit(2).alias("narrative_no"), body(F.lit("A season of many stories."), observed).alias("raw")),
    )
    return told.select("season_year", F.inline(answers))


def _narrative_checks(t: RaceTables) -> DataFrame:
    rows = _season_package(t)
    return evidence.check_narratives(write_narratives(rows), rows, _PACKAGE, narrative_id="narrative_no").select(
        "season_year",
        "narrative_no",
        "status",
        "reason",
        "contradicted_insight",
        "narrative",
        F.array_join("evidence_references", ",").alias("evidence_references"),
    )


def _rule_registry(t: RaceTables) -> DataFrame:
    """The rules, with how many season and conversion insights each yields."""
    fired = insights.counts_by_rule(
        _season_package(t).select("rule_id").unionByName(insights.conversion_insights(t).select("rule_id"))
    )
    registry = rules.registry_frame(t.races.sparkSession).select("rule_id", "category", "metric", "min_sample_size")
    return F.broadcast(registry).join(fired, "rule_id", "left").withColumn(
        "insights", F.coalesce("insights", F.lit(0))
    )


# Upserts: an earlier delivery of each race table meets the current one. -------


def _told_earlier(table: str) -> dict[str, Column]:
    """The columns that a late correction changed, as they were before it."""
    if table == "race_results":
        return {"status": F.when(F.col("status") == "+1 Lap", "Lapped").otherwise(F.col("status"))}
    if table == "lap_times":
        return {"time": F.when(F.col("time") == "", "IN PIT").otherwise(F.col("time"))}
    if table in ("driver_standings", "constructor_standings"):
        return {"points": F.col("points") + F.when(F.col("position") == 1, 1).otherwise(0)}
    return {}


def _earlier(t: RaceTables, table: str) -> DataFrame:
    """What was stored after round 16, before a late correction of lapped cars."""
    return t[table].where(F.col("round") <= 16).withColumns(_told_earlier(table))


def _plan(t: RaceTables, table: str) -> DataFrame:
    return upsert.plan_upsert(table, _earlier(t, table), t[table])


def _upsert_actions(t: RaceTables) -> DataFrame:
    return _plan(t, "race_results").select("season_year", "round", "driver_id", "status", "action")


def _upsert_laps(t: RaceTables) -> DataFrame:
    return _plan(t, "lap_times").select("season_year", "round", "driver_id", "lap_number", "time", "action")


_UPSERTED = (
    "race_results",
    "qualifying_results",
    "sprint_results",
    "pit_stops",
    "lap_times",
    "driver_standings",
    "constructor_standings",
)


def _upsert_stats(t: RaceTables) -> DataFrame:
    parts = [upsert.ingestion_stats(_plan(t, table), table) for table in _UPSERTED]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _upsert_again(t: RaceTables) -> DataFrame:
    """Current results and laps meet a batch with the earlier version of each row and then the current one."""

    def stats(table: str) -> DataFrame:
        # Both versions come from one reading; side by side, they also take less room in an exchange.
        # The earlier one holds rows of a known round only.
        twice = t[table].withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).where("n = 2 OR round <= 40")
        batch = twice.withColumns({c: F.when(F.col("n") == 1, e).otherwise(F.col(c)) for c, e in _told_earlier(table).items()})
        return upsert.ingestion_stats(upsert.plan_upsert(table, t[table], batch, order="n"), table)

    return stats("race_results").unionByName(stats("lap_times"))


def _upsert_totals(t: RaceTables) -> DataFrame:
    return upsert.total_stats(_upsert_stats(t))


def _missing_parents(t: RaceTables) -> DataFrame:
    """Results checked against the calendar as it was after round 16."""
    known = RaceTables(lambda name: t.races.where(F.col("round") <= 16) if name == "races" else t[name])
    return upsert.missing_parents("race_results", t.race_results, known)


# Real runs into a store: what was known after round 16, everything, the same again, and one that fails.
_RUN_TABLES = ("seasons", "circuits", "constructors", "drivers", "races", "race_results")
_RUN_ROW = (
    "kind string, run_id bigint, table_name string, status string, records_processed bigint, records_inserted bigint, "
    "records_updated bigint, records_skipped bigint, rows bigint, rows_to_16 bigint"
)


def _runs(t: RaceTables, names: Sequence[str] = _RUN_TABLES, kept: str = "ingest_runs") -> DataFrame:
    """Log rows of the runs, and the stored rows of each table after each run."""

    def build() -> DataFrame:
        spark = t.races.sparkSession
        store = RaceStore(spark, f"{working_folder(spark)}/ingest_{uuid.uuid4().hex}")
        early = {n: _earlier(t, n) if "round" in NATURAL_KEYS[n] else t[n] for n in names}
        whole = {n: t[n] for n in names}
        unknown = {"race_results": t.race_results.where("round = 1").withColumn("season_year", -F.col("season_year"))}
        rows = []
        for number, batch in enumerate((early, whole, whole, unknown), 1):
            try:
                store.ingest(batch)
            except DependencyError:
                pass  # the log says so
            for name in names:
                to_16 = F.count(F.when(F.col("round") <= 16, 1)) if "round" in NATURAL_KEYS[name] else F.lit(None)
                found = store.read(name).agg(F.count(F.lit(1)), to_16).first()
                rows.append(("count", number, name, None, None, None, None, None, *found))
        log = store.log().select(
            F.lit("log").alias("kind"), "run_id", F.col("entity_type").alias("table_name"), "status", "records_processed",
            "records_inserted", "records_updated", "records_skipped", F.lit(None).cast("bigint").alias("rows"),
            F.lit(None).cast("bigint").alias("rows_to_16"),
        )
        return log.unionByName(spark.createDataFrame(rows, _RUN_ROW))

    return t.keep(kept, build)


def _counts_after(runs: DataFrame, number: int, rows: str = "rows") -> DataFrame:
    counted = runs.where((F.col("kind") == "count") & (F.col("run_id") == number))
    return counted.select("table_name", F.col(rows).alias("rows")).where("rows is not null")


def _ingestion_log(t: RaceTables) -> DataFrame:
    return quality.log_summary(_runs(t).where("kind = 'log'"))


def _idempotent(t: RaceTables) -> DataFrame:
    """All twelve tables are delivered again; laps and stops are most of the rows."""
    runs = _runs(t, INGEST_ORDER, "idempotency_runs")
    third = runs.where("kind = 'log' and run_id = 3")
    return quality.is_idempotent(_counts_after(runs, 2), _counts_after(runs, 3), third)


def _preserved(t: RaceTables) -> DataFrame:
    runs = _runs(t)
    return quality.preserved(_counts_after(runs, 1, "rows_to_16"), _counts_after(runs, 4, "rows_to_16"))


def _faulty(t: RaceTables) -> RaceTables:
    """The tables with faults: two drivers and every fifth round are gone, some rows came twice."""
    gone = F.col("driver_id").isin("driver_000000000003", "driver_000000000008")
    twice = F.col("driver_id").endswith("7") & (F.col("round") == 4)

    def load(name: str) -> DataFrame:
        if name == "drivers":
            return t.drivers.where(~gone)
        if name == "races":
            return t.races.where(F.col("round") % 5 != 2)
        if name in ("race_results", "driver_standings"):
            return t[name].unionByName(t[name].where(twice))
        return t[name]

    return RaceTables(load)


def _reconcile(t: RaceTables) -> DataFrame:
    keys = ["season_year", "driver_id"]
    metrics = ["races_entered", "races_classified", "wins", "race_points", "sprint_points", "average_finish"]
    ours = season.driver_season_totals(season.driver_rounds(t)).select(
        *keys,
        "races_entered",
        "races_classified",
        "wins",
        F.col("total_race_points").alias("race_points"),
        F.col("total_sprint_points").alias("sprint_points"),
        "average_finish",
    )
    return quality.reconcile(quality.driver_reference(t), ours, keys, metrics)


_VIEWS = {
    "evidence_records": _evidence_records,
    "evidence_package": _evidence_packages,
    "race_evidence_package": _race_packages,
    "narrative_checks": _narrative_checks,
    "rule_registry": _rule_registry,
    "upsert_actions": _upsert_actions,
    "upsert_lap_times": _upsert_laps,
    "upsert_stats": _upsert_stats,
    "upsert_repeated": _upsert_again,
    "upsert_totals": _upsert_totals,
    "missing_parents": _missing_parents,
    "ingestion_log": _ingestion_log,
    "idempotency": _idempotent,
    "baseline_preserved": _preserved,
    "table_counts": quality.table_counts,
    "duplicate_keys": quality.duplicate_keys,
    "orphan_counts": quality.orphan_counts,
    "faulty_duplicate_keys": lambda t: quality.duplicate_keys(_faulty(t)),
    "faulty_orphan_counts": lambda t: quality.orphan_counts(_faulty(t)),
    "faulty_orphan_keys": lambda t: quality.orphan_keys(_faulty(t)).where("entity_type = 'pit_stops'"),
    "faulty_round_gaps": lambda t: quality.round_gaps(_faulty(t)),
    "round_completeness": quality.round_completeness,
    "round_gaps": quality.round_gaps,
    "sprint_rounds": quality.sprint_rounds,
    "participation": quality.participation,
    "driver_reference": quality.driver_reference,
    "constructor_reference": quality.constructor_reference,
    "pair_reference": quality.pair_reference,
    "last_rounds": quality.last_rounds,
    "points_rates": quality.points_rates,
    "points_per_start_reference": quality.points_per_start_reference,
    "status_lookup": quality.status_lookup,
    "reconcile": _reconcile,
    "pair_events": quality.pair_events,
}

QUERIES = {name: over_star(view) for name, view in _VIEWS.items()}
