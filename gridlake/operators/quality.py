"""Data-quality and reconciliation queries over the race tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_even
from gridlake.functions.scalars import is_classified
from gridlake.operators.common import RACE, scoped, sum_if, zero_points
from gridlake.operators.event import teammate_events
from gridlake.operators.season import DRIVER_SEASON, TEAM_SEASON, driver_rounds
from gridlake.operators.statistics import driver_points_stats
from gridlake.tables import FOREIGN_KEYS, NATURAL_KEYS, RaceTables

FACTS = {
    "race_results": "race_results",
    "qualifying_results": "qualifying_results",
    "sprint_results": "sprint_results",
    "driver_standings": "driver_standings",
    "constructor_standings": "constructor_standings",
}
CHECKED_KEYS = (
    "races",
    "race_results",
    "qualifying_results",
    "sprint_results",
    "driver_standings",
    "constructor_standings",
    "pit_stops",
    "lap_times",
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(t: RaceTables, up_to_round: int | None = None) -> DataFrame:
    """Rows per table; with a cutoff, only tables that have rounds, up to it."""
    names = [n for n in NATURAL_KEYS if up_to_round is None or "round" in NATURAL_KEYS[n]]
    return _union(
        [
            scoped(t[n], up_to_round=up_to_round)
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(n).alias("table_name"), "rows")
            for n in names
        ]
    )


def duplicate_keys(t: RaceTables) -> DataFrame:
    """Natural keys that occur more than once."""
    found = []
    for name in CHECKED_KEYS:
        keys = NATURAL_KEYS[name]
        repeated = t[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
        found.append(repeated.select(F.lit(name).alias("table_name"), F.concat_ws("/", *keys).alias("key"), "rows"))
    return _union(found)


def orphan_keys(t: RaceTables) -> DataFrame:
    """References to parents that do not exist."""
    return _references(t).where("orphans > 0").select(
        "entity_type", "missing_entity", F.col("parent_key").alias("missing_id"), F.col("orphans").alias("rows")
    )


def _references(t: RaceTables) -> DataFrame:
    """Every parent key that is stored or referred to, with the rows of each reference it lacks a parent for.

    Each fact is read once: an Expand turns a row into its references, which are
    counted in the task that reads them.  All references and all parents then meet in
    one aggregation by key, so there is no join and each table is scanned once.
    """
    parts = []
    for name, parents in FOREIGN_KEYS.items():
        refs = F.array(*[
            F.struct(F.lit(parent).alias("missing_entity"), F.concat_ws("/", *columns).alias("parent_key"))
            for parent, columns in parents
        ])
        used = t[name].select(F.inline(refs)).groupBy("missing_entity", "parent_key").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(used.select(F.lit(name).alias("entity_type"), "missing_entity", "parent_key", "rows"))
    for parent, columns in {p: c for parents in FOREIGN_KEYS.values() for p, c in parents}.items():
        keys = t[parent].select(F.concat_ws("/", *columns).alias("parent_key"))
        none = F.lit(None).cast("string").alias("entity_type")
        parts.append(keys.select(none, F.lit(parent).alias("missing_entity"), "parent_key", F.lit(0).cast("bigint").alias("rows")))
    # One row per key: how many rows of each referring table name it, and whether it is stored.
    by_table = [F.sum(F.when(F.col("entity_type") == name, F.col("rows"))).alias(name) for name in FOREIGN_KEYS]
    stored = F.max(F.col("entity_type").isNull()).alias("stored")
    keys = _union(parts).groupBy("missing_entity", "parent_key").agg(stored, *by_table)
    each = F.array(*[F.struct(F.lit(n).alias("entity_type"), F.col(n).alias("rows")) for n in FOREIGN_KEYS])
    return keys.select("missing_entity", "parent_key", "stored", F.inline(each)).where("rows IS NOT NULL").select(
        "entity_type", "missing_entity", "parent_key", F.when(F.col("stored"), 0).otherwise(F.col("rows")).alias("orphans")
    )


def orphan_counts(t: RaceTables) -> DataFrame:
    """Orphans per reference, with a row of 0 for every clean one."""
    checks = [(child, parent) for child, parents in FOREIGN_KEYS.items() for parent, _ in parents]
    every = t.races.sparkSession.createDataFrame(checks, "entity_type string, missing_entity string")
    found = _references(t).groupBy("entity_type", "missing_entity").agg(F.sum("orphans").alias("rows"))
    return every.join(found, ["entity_type", "missing_entity"], "left").select(
        "entity_type", "missing_entity", F.coalesce("rows", F.lit(0)).alias("orphans")
    )


def round_completeness(t: RaceTables) -> DataFrame:
    """Rows of every fact per race; facts are counted before they are joined."""
    rows = t.races.select(*RACE, "race_name")
    for name in FACTS:
        counts = t[name].groupBy(*RACE).agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(counts, RACE, "left")
    return rows.select(*RACE, "race_name", *[F.coalesce(n, F.lit(0)).alias(n) for n in FACTS])


def round_gaps(t: RaceTables) -> DataFrame:
    """Rounds missing between 1 and the last round of a season."""
    seasons = t.races.groupBy("season_year").agg(F.max("round").alias("last"), F.collect_set("round").alias("seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("last")), F.col("seen"))
    return seasons.select("season_year", F.explode(missing).alias("missing_round"))


def sprint_rounds(t: RaceTables) -> DataFrame:
    return t.races.select(*RACE).join(t.sprint_results.select(*RACE), RACE, "left_semi")


def participation(t: RaceTables) -> DataFrame:
    """Entries of every known driver over all seasons; some may have none."""
    rows = t.drivers.select("driver_id", "code")
    for name, column in (
        ("race_results", "race_starts"),
        ("qualifying_results", "qualifying_entries"),
        ("sprint_results", "sprint_entries"),
        ("driver_standings", "standings_entries"),
    ):
        extra = [F.max("position").alias("worst_standing")] if name == "driver_standings" else []
        counts = t[name].groupBy("driver_id").agg(F.count(F.lit(1)).alias(column), *extra)
        rows = rows.join(counts, "driver_id", "left")
    counted = ("race_starts", "qualifying_entries", "sprint_entries", "standings_entries")
    return rows.select(
        "driver_id",
        "code",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counted],
        "worst_standing",
        F.col("race_starts").isNull().alias("is_reference_only"),
    )


def driver_reference(t: RaceTables) -> DataFrame:
    """Season figures of drivers worked out on their own, to check the aggregates."""
    ok = is_classified(F.col("position_text"), F.col("status"))
    base = t.race_results.groupBy(*DRIVER_SEASON).agg(
        F.count(F.lit(1)).alias("races_entered"),
        sum_if(ok).alias("races_classified"),
        sum_if(~ok).alias("non_classified"),
        F.sum("points").alias("race_points"),
        sum_if(F.col("source_position") == 1).alias("wins"),
        round_half_even(F.avg(F.when(ok, F.col("source_position"))), 2).alias("average_finish"),
        round_half_even(F.avg(F.when(F.col("grid_position") > 0, F.col("grid_position"))), 2).alias("average_grid"),
    )
    sprint = t.sprint_results.groupBy(*DRIVER_SEASON).agg(F.sum("points").alias("sprint_points"))
    return base.join(sprint, DRIVER_SEASON, "left").withColumn(
        "sprint_points", F.coalesce("sprint_points", zero_points())
    )


def constructor_reference(t: RaceTables) -> DataFrame:
    """Season figures of teams worked out on their own."""
    base = t.race_results.groupBy(*TEAM_SEASON).agg(
        F.countDistinct("round").alias("races_entered"),
        F.count(F.lit(1)).alias("total_car_starts"),
        F.sum("points").alias("race_points"),
        sum_if(F.col("source_position") == 1).alias("wins"),
    )
    sprint = t.sprint_results.groupBy(*TEAM_SEASON).agg(F.sum("points").alias("sprint_points"))
    return base.join(sprint, TEAM_SEASON, "left").withColumn(
        "sprint_points", F.coalesce("sprint_points", zero_points())
    )


def pair_reference(t: RaceTables) -> DataFrame:
    """Head-to-head counts by a self-join on race and team, for all pairs of a team."""
    ok = is_classified(F.col("position_text"), F.col("status"))
    cars = t.race_results.select(
        *RACE, "constructor_id", "driver_id", F.when(ok, F.col("source_position")).alias("finish")
    ).join(
        t.qualifying_results.select(*RACE, "driver_id", F.col("position").alias("qualified")),
        [*RACE, "driver_id"],
        "left",
    )
    keys = [*RACE, "constructor_id"]
    a = cars.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("driver_id", "finish", "qualified")])
    b = cars.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("driver_id", "finish", "qualified")])
    both = a.join(b, keys).where(F.col("driver_id_a") < F.col("driver_id_b"))

    def ahead(measure: str, first: str, second: str) -> Column:
        return sum_if(F.col(f"{measure}_{first}") < F.col(f"{measure}_{second}"))

    return both.groupBy("season_year", "constructor_id", "driver_id_a", "driver_id_b").agg(
        ahead("qualified", "a", "b").alias("qualifying_a"),
        ahead("qualified", "b", "a").alias("qualifying_b"),
        sum_if(F.col("qualified_a").isNotNull() & F.col("qualified_b").isNotNull()).alias("qualifying_rounds"),
        ahead("finish", "a", "b").alias("race_a"),
        ahead("finish", "b", "a").alias("race_b"),
        sum_if(F.col("finish_a").isNotNull() & F.col("finish_b").isNotNull()).alias("race_rounds"),
    )


def last_rounds(t: RaceTables, count: int = 3) -> DataFrame:
    """Finish and points over each driver's last rounds of a season."""
    latest = Window.partitionBy(*DRIVER_SEASON).orderBy(F.desc("round"))
    rows = driver_rounds(t).withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= count)
    return rows.groupBy(*DRIVER_SEASON).agg(
        round_half_even(F.avg("finish_position"), 2).alias("average_finish"),
        F.sum("race_points").alias("race_points"),
        F.sum("sprint_points").alias("sprint_points"),
        F.sum("total_round_points").alias("total_points"),
        F.count(F.lit(1)).alias("rounds"),
    )


def points_rates(t: RaceTables) -> DataFrame:
    """Points rates of every driver, also per round of the calendar; idle drivers read 0."""
    calendar = t.races.groupBy("season_year").agg(F.count(F.lit(1)).alias("season_rounds"))
    stats = driver_points_stats(driver_rounds(t)).join(calendar, "season_year")
    total = F.col("total_championship_points")
    rated = stats.select(
        *DRIVER_SEASON,
        "grand_prix_starts",
        "rounds_entered",
        "total_race_points",
        "total_sprint_points",
        total.alias("total_points"),
        "points_per_gp_start",
        "points_per_round_total",
        round_half_even(total.cast("double") / F.col("season_rounds"), 2).alias("points_per_calendar_round"),
    )
    counted = ("grand_prix_starts", "rounds_entered", "total_race_points", "total_sprint_points", "total_points")
    return (
        t.drivers.select("driver_id")
        .join(rated, "driver_id", "left")
        .select(
            "season_year",
            "driver_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counted],
            "points_per_gp_start",
            "points_per_round_total",
            "points_per_calendar_round",
        )
    )


def points_per_start_reference(t: RaceTables) -> DataFrame:
    """Points per start straight from the results; NULL without a start."""
    starts = sum_if(F.lower("status") != "did not start")
    return t.race_results.groupBy(*DRIVER_SEASON).agg(
        starts.alias("starts"),
        F.sum("points").alias("race_points"),
        round_half_even(F.try_divide(F.sum("points").cast("double"), starts), 4).alias("points_per_start"),
    )


def status_lookup(t: RaceTables) -> DataFrame:
    """Disqualifications and non-starts found by their status text."""
    status = F.col("status")
    kind = F.when(status.ilike("%disqualif%") | (F.lower("position_text") == "dsq"), "DSQ").when(
        status.ilike("%did not start%"), "DNS"
    )
    return t.race_results.select(*RACE, "driver_id", "position_text", "status", kind.alias("kind")).where(
        F.col("kind").isNotNull()
    )


def reconcile(
    left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 0.01
) -> DataFrame:
    """Compare two result sets figure by figure: MATCH or DISCREPANCY."""

    def long(frame: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]
        )
        return frame.select(*keys, F.inline(pairs))

    both = long(left, "left_value").join(long(right, "right_value"), [*keys, "metric"], "full_outer")
    a, b = F.col("left_value"), F.col("right_value")
    same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return both.withColumn("verdict", F.when(same, "MATCH").otherwise("DISCREPANCY"))


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether the row counts of an earlier state still hold."""
    old = before.withColumnRenamed("rows", "rows_before")
    return old.join(after, "table_name", "left").select(
        "table_name",
        "rows_before",
        F.coalesce("rows", F.lit(0)).alias("rows_after"),
        (F.col("rows_before") == F.coalesce("rows", F.lit(0))).alias("is_preserved"),
    )


def is_idempotent(first_counts: DataFrame, second_counts: DataFrame, second_stats: DataFrame) -> DataFrame:
    """Whether a second run inserted nothing and left every count as it was."""
    inserted = second_stats.agg(
        F.sum("records_inserted").alias("inserted"), F.lit(None).cast("boolean").alias("counts_equal")
    )
    kept = preserved(first_counts, second_counts).agg(
        F.lit(None).cast("bigint").alias("inserted"), F.every("is_preserved").alias("counts_equal")
    )
    both = inserted.unionByName(kept).agg(
        F.max("inserted").alias("inserted"), F.every("counts_equal").alias("counts_equal")
    )
    return both.withColumn("is_idempotent", (F.col("inserted") == 0) & F.col("counts_equal"))


def pair_events(t: RaceTables) -> DataFrame:
    """Each pair's races with who led, or why the race was left out of the record."""
    events = teammate_events(t)

    def winner(ahead: str, comparable: str) -> Column:
        return F.when(F.col(comparable), F.coalesce(ahead, F.lit("TIE"))).otherwise("EXCLUDED")

    def reason(side: str) -> Column:
        unclassified = F.concat(
            F.col(f"driver_{side}_id"), F.lit(" unclassified (status="), F.col(f"status_{side}"), F.lit(")")
        )
        return F.when(F.col(f"finish_{side}").isNull(), unclassified)

    absent = F.concat(
        F.lit("missing qualifying: a="),
        F.coalesce(F.col("qualifying_a_pos").cast("string"), F.lit("none")),
        F.lit(", b="),
        F.coalesce(F.col("qualifying_b_pos").cast("string"), F.lit("none")),
    )
    return events.select(
        *RACE,
        "constructor_id",
        "driver_a_id",
        "driver_b_id",
        winner("ahead_in_qualifying", "is_comparable_qualifying").alias("qualifying_winner"),
        F.when(~F.col("is_comparable_qualifying"), absent).alias("qualifying_exclusion"),
        winner("ahead_in_race", "is_comparable_finish").alias("race_winner"),
        F.nullif(F.concat_ws("; ", reason("a"), reason("b")), F.lit("")).alias("race_exclusion"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Runs and record counts of the audit log by status."""
    counts = [c for c in log.columns if c.startswith("records_")]
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in counts])
