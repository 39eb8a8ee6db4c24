"""Race tables from a star-schema warehouse (line items, orders, suppliers, nations).

A supplier is a driver, two neighbouring suppliers are a team, twenty are the
field of one racing series.  A half-month of order dates is a round, so a
season of one series has up to 24 rounds.  A line item is a lap.  However much
data there is, a race has at most 20 cars and a season at most 24 rounds; more
data means more series, and more laps for a busy driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions import timing
from gridlake.functions.scalars import is_classified
from gridlake.operators.numbering import number_rows, number_within, repeat_rows
from gridlake.plans.store import bucket_count, stored, stored_bytes
from gridlake.tables import RaceTables

# Fixed values -------------------------------------------------------------
FIELD_SIZE = 20
RACE_POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
SPRINT_ROUNDS = (5, 6, 11, 18, 19, 23)
Q2_PLACES, Q3_PLACES = 15, 10
LAP_SLOTS = 1024
# A driver of more line items than this has its laps numbered slot by slot.
BUSY_ITEMS = 100_000
# Every place nearer to the front of the series is worth this much, in cents.
SKILL_STEPS = {"price": 2_000_000, "quantity": 1_000, "discount": 5}
# --------------------------------------------------------------------------

_ENTRY = ["season_year", "round", "suppkey"]
_LAP = ["orderkey", "linenumber", "partkey", "price", "quantity", "discount", "tax"]


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def _cents(name: str) -> Column:
    return F.floor(F.col(name) * 100 + 0.5)


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value.cast("bigint"), F.lit(by).cast("bigint"))


def _slug(prefix: str, key: Column, width: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def driver_slug(key: Column) -> Column:
    return _slug("driver_", key)


def team_slug(key: Column) -> Column:
    return _slug("team_", _div(key, 2))


def _items(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        _cents("l_extendedprice").alias("price"),
        _cents("l_quantity").alias("quantity"),
        _cents("l_discount").alias("discount"),
        _cents("l_tax").alias("tax"),
    )


def _tasks(spark: SparkSession, root: str) -> int:
    """Tasks of bounded size for the line items with their orders."""
    return bucket_count(spark, sum(stored_bytes(spark, f"{root}/{t}.parquet") for t in ("lineitem", "orders")))


def records(spark: SparkSession, root: str, items: DataFrame | None = None) -> DataFrame:
    """One row per line item, placed in its season, round and car.

    The number of tasks follows the size of the files, so none grows with the data; an
    order is looked up in a hash table of its task, so the line items are not sorted.
    """
    tasks = _tasks(spark, root)
    items = _items(spark, root) if items is None else items
    orders = _read(spark, root, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderdate")
    date = F.col("o_orderdate")
    placed = items.repartition(tasks, "orderkey").join(
        orders.repartition(tasks, "orderkey").hint("shuffle_hash"), "orderkey"
    )
    return placed.select(
        (_div(F.col("suppkey"), FIELD_SIZE) * 10000 + F.year(date)).alias("season_year"),
        (F.month(date) * 2 - F.when(F.dayofmonth(date) > 15, 0).otherwise(1)).alias("round"),
        "suppkey",
        *_LAP,
    )


def _lap_millis() -> Column:
    return F.when(F.col("tax") != 8, F.lit(60000) + _div(F.col("price"), 100) % 40000)


def _busy(spark: SparkSession, root: str) -> DataFrame:
    """Drivers of very many line items; there is at most one for every ``BUSY_ITEMS`` rows."""

    def count() -> DataFrame:
        counted = _items(spark, root).groupBy("suppkey").agg(F.count(F.lit(1)).alias("items"))
        return counted.where(F.col("items") > BUSY_ITEMS).select(F.col("suppkey").alias("busy"))

    return stored(spark, root, "busy", count)


def build_entries(spark: SparkSession, root: str, partitions: int) -> DataFrame:
    """One wide row per car and race: grid, finish, qualifying, sprint and standing.

    All windows lie inside a season, so one exchange by season serves every one of them,
    and the bucketed write as well.  It comes before the aggregation, which a car has only
    a few line items for; with a busy driver it comes after one that combines map-side.
    """
    rows, by_season = records(spark, root), lambda frame: frame.repartition(partitions, "season_year")
    busy = not _busy(spark, root).isEmpty()
    entry = (
        (rows if busy else by_season(rows))
        .groupBy(*_ENTRY)
        .agg(
            F.count(F.lit(1)).alias("laps"),
            *[F.sum(c).alias(c) for c in ("price", "quantity", "discount", "tax")],
            F.min(_lap_millis()).alias("fastest"),
        )
    )
    entry = by_season(entry) if busy else entry
    race = Window.partitionBy("season_year", "round")
    season = Window.partitionBy("season_year", "suppkey").orderBy("round")

    def place(*order: Column) -> Column:
        return F.row_number().over(race.orderBy(*order, F.col("suppkey").asc()))

    def strength(measure: str) -> Column:
        skill = F.lit(FIELD_SIZE - 1) - F.col("suppkey") % FIELD_SIZE
        return (F.col(measure) + skill * SKILL_STEPS[measure]).desc()

    mark = (F.col("suppkey") * 7 + F.col("season_year") * 13 + F.col("round") * 5) % 20
    ranked = entry.withColumn("mark", mark).select(
        "*",
        place(strength("quantity")).alias("grid_rank"),
        place(strength("price")).alias("finish_rank"),
        place((F.col("mark") == 9).asc(), strength("discount")).alias("qualifying_rank"),
        place(F.col("tax").desc()).alias("sprint_rank"),
        place(F.col("fastest").asc_nulls_last()).alias("fastest_rank"),
    )
    m = F.col("mark")
    finish = F.when(m != 6, F.col("finish_rank"))
    status = (
        F.when(m == 0, "Did not start")
        .when(m == 1, "Disqualified")
        .when(m.isin(2, 5), "Retired")
        .when(m == 6, "Engine")
        .when(m.isin(7, 8), "+1 Lap")
        .otherwise("Finished")
    )
    position_text = (
        F.when(m == 0, "W").when(m == 1, "D").when(m.isin(2, 5), "R").when(m == 6, "").otherwise(finish.cast("string"))
    )
    placed = ranked.select(
        *_ENTRY,
        F.col("mark"),
        F.col("laps"),
        F.when(m == 3, 0).when(m != 4, F.col("grid_rank")).alias("grid_position"),
        finish.alias("source_position"),
        position_text.alias("position_text"),
        status.alias("status"),
        "qualifying_rank",
        "sprint_rank",
        F.col("fastest").cast("int").alias("fastest_lap_time_millis"),
        F.when(F.col("fastest").isNotNull(), F.col("fastest_rank")).alias("fastest_lap_rank"),
        F.when(F.col("fastest").isNotNull(), _div(F.col("price"), 1) % F.col("laps") + 1)
        .cast("int")
        .alias("fastest_lap_number"),
        _div(F.col("price"), 100).alias("price_units"),
        _div(F.col("quantity"), 100).alias("quantity_units"),
    ).withColumn("classified", is_classified(F.col("position_text"), F.col("status")))
    points = F.get(F.array(*[F.lit(p) for p in RACE_POINTS]), F.col("source_position") - 1)
    sprint_points = F.greatest(F.lit(0), F.lit(9) - F.col("sprint_rank"))
    scored = placed.select(
        "*",
        F.when(F.col("classified"), F.coalesce(points, F.lit(0))).otherwise(0).cast("decimal(5,2)").alias("points"),
        F.when(F.col("round").isin(*SPRINT_ROUNDS), sprint_points).cast("decimal(5,2)").alias("sprint_points"),
        F.when(
            F.col("classified"), F.lit(5400000) + F.col("source_position") * 1500 + F.col("price_units") % 1000
        ).alias("time_millis"),
    )
    total = F.col("points") + F.coalesce(F.col("sprint_points"), F.lit(0))
    win = F.when(F.col("classified") & (F.col("source_position") == 1), 1).otherwise(0)
    timed = scored.select(
        "*",
        F.min("time_millis").over(race).alias("winning_millis"),
        F.sum(total).over(season).cast("decimal(7,2)").alias("season_points"),
        F.sum(win).over(season).cast("int").alias("season_wins"),
    )
    return timed.select(
        "*", place(F.col("season_points").desc(), F.col("season_wins").desc()).alias("standing_position")
    )


def build_laps(spark: SparkSession, root: str) -> DataFrame:
    """Laps numbered within their car and race; pit laps carry a stop number.

    Identical line items are one row with their number of ``copies`` and the
    numbers of the last copy.  The laps of most drivers are brought together by car and race
    once, and counted and numbered there.  Those of a busy driver meet their copies
    before anything is sorted, and the slot that the lap order starts with spreads them
    over many tasks.
    """
    slot = (
        F.col("orderkey") + F.col("linenumber") * 31 + F.col("partkey") * 961 + F.col("price")
    ) % LAP_SLOTS
    pit = F.col("discount") >= 9
    counters = {"last_lap": F.lit(True), "last_stop": pit}

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_ENTRY, *_LAP).agg(F.count(F.lit(1)).alias("copies")).withColumn("slot", slot)

    def usual(items: DataFrame) -> DataFrame:
        rows = records(spark, root, items).repartition(_tasks(spark, root), *_ENTRY)
        numbered = number_rows(distinct(rows), _ENTRY, ["slot", *_LAP], "copies", counters)
        # A line item that lacks a key counts in the numbers of the others, but is no lap itself.
        return numbered.dropna(subset=[*_ENTRY, "slot"])

    items, busy = _items(spark, root), _busy(spark, root)
    if busy.isEmpty():
        laps = usual(items)
    else:
        is_busy = F.col("suppkey").eqNullSafe(F.col("busy"))
        of_busy = records(spark, root, items.join(F.broadcast(busy), is_busy, "left_semi"))
        laps = usual(items.join(F.broadcast(busy), is_busy, "left_anti")).unionByName(
            number_within(distinct(of_busy), _ENTRY, "slot", _LAP, "copies", counters)
        )
    return laps.select(
        *_ENTRY,
        "copies",
        "last_lap",
        F.when(pit, F.col("last_stop")).alias("last_stop"),
        _lap_millis().cast("int").alias("time_millis"),
    )


def _every_lap(laps: DataFrame) -> DataFrame:
    before = F.col("copies") - 1 - F.col("copy")
    return repeat_rows(laps, "copies", "copy").select(
        *_ENTRY,
        (F.col("last_lap") - before).alias("lap_number"),
        (F.col("last_stop") - before).alias("stop_number"),
        "time_millis",
    )


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return stored(
        spark,
        root,
        "entries",
        lambda buckets: build_entries(spark, root, buckets),
        bucket_by="season_year",
        sort_by=["season_year", "round"],
        sized_by=f"{root}/lineitem.parquet",
    )


def _laps(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, root, "laps", lambda: build_laps(spark, root))


def _car() -> list[Column]:
    key = F.col("suppkey")
    return [
        F.col("season_year"),
        F.col("round"),
        driver_slug(key).alias("driver_id"),
        team_slug(key).alias("constructor_id"),
        (key % 100).cast("int").alias("car_number"),
    ]


def _race_results(entries: DataFrame) -> DataFrame:
    gap = F.col("time_millis") - F.col("winning_millis")
    time_text = F.when(gap == 0, timing.race_text(F.col("time_millis"))).when(
        gap > 0, F.concat(F.lit("+"), timing.seconds_text(gap))
    )
    return entries.select(
        *_car(),
        "grid_position",
        "source_position",
        "position_text",
        "points",
        F.col("laps").cast("int").alias("laps_completed"),
        "status",
        "time_millis",
        time_text.alias("time_text"),
        "fastest_lap_rank",
        "fastest_lap_number",
        timing.lap_text(F.col("fastest_lap_time_millis")).alias("fastest_lap_time"),
        "fastest_lap_time_millis",
    )


def _qualifying(entries: DataFrame) -> DataFrame:
    place = F.col("qualifying_rank")
    q1 = (F.lit(80000) + F.col("price_units") % 20000).cast("int")
    q2 = F.when(place <= Q2_PLACES, q1 - 500 + (F.col("quantity_units") % 300).cast("int"))
    q3 = F.when(place <= Q3_PLACES, q1 - 700 + (F.col("quantity_units") % 900).cast("int"))
    times = [
        c
        for name, millis in (("q1", q1), ("q2", q2), ("q3", q3))
        for c in (timing.lap_text(millis).alias(f"{name}_time"), millis.alias(f"{name}_time_millis"))
    ]
    return entries.where(F.col("mark") != 9).select(*_car(), place.alias("position"), *times)


def _sprint(entries: DataFrame) -> DataFrame:
    none = F.lit(None)
    return entries.where(F.col("round").isin(*SPRINT_ROUNDS)).select(
        *_car(),
        F.col("grid_position"),
        F.col("sprint_rank").alias("source_position"),
        F.col("sprint_rank").cast("string").alias("position_text"),
        F.col("sprint_points").alias("points"),
        F.lit(FIELD_SIZE).alias("laps_completed"),
        F.lit("Finished").alias("status"),
        none.cast("bigint").alias("time_millis"),
        none.cast("string").alias("time_text"),
        none.cast("int").alias("fastest_lap_rank"),
        none.cast("int").alias("fastest_lap_number"),
        none.cast("string").alias("fastest_lap_time"),
        none.cast("int").alias("fastest_lap_time_millis"),
    )


def _driver_standings(entries: DataFrame) -> DataFrame:
    return entries.select(
        "season_year",
        "round",
        driver_slug(F.col("suppkey")).alias("driver_id"),
        F.col("standing_position").alias("position"),
        F.col("season_points").alias("points"),
        F.col("season_wins").alias("wins"),
    )


def _constructor_standings(entries: DataFrame) -> DataFrame:
    per_round = entries.groupBy("season_year", "round", _div(F.col("suppkey"), 2).alias("team")).agg(
        F.sum(F.col("points") + F.coalesce(F.col("sprint_points"), F.lit(0))).alias("round_points"),
        F.max(F.when(F.col("classified") & (F.col("source_position") == 1), 1).otherwise(0)).alias("won"),
    )
    season = Window.partitionBy("season_year", "team").orderBy("round")
    running = per_round.select(
        "season_year",
        "round",
        "team",
        F.sum("round_points").over(season).cast("decimal(7,2)").alias("points"),
        F.sum("won").over(season).cast("int").alias("wins"),
    )
    race = Window.partitionBy("season_year", "round").orderBy(F.desc("points"), F.desc("wins"), "team")
    return running.select(
        "season_year",
        "round",
        _slug("team_", F.col("team")).alias("constructor_id"),
        F.row_number().over(race).alias("position"),
        "points",
        "wins",
    )


def _lap_times(laps: DataFrame) -> DataFrame:
    return _every_lap(laps).select(
        "season_year",
        "round",
        driver_slug(F.col("suppkey")).alias("driver_id"),
        "lap_number",
        (F.col("suppkey") % FIELD_SIZE + 1).cast("int").alias("position"),
        F.coalesce(timing.lap_text(F.col("time_millis")), F.lit("")).alias("time"),
        "time_millis",
    )


def _pit_stops(laps: DataFrame) -> DataFrame:
    duration = (F.lit(20000) + F.col("time_millis") % 15000).cast("bigint")
    minute = F.col("lap_number") % 60
    return _every_lap(laps.where(F.col("last_stop").isNotNull())).select(
        "season_year",
        "round",
        driver_slug(F.col("suppkey")).alias("driver_id"),
        "stop_number",
        F.col("lap_number").alias("lap"),
        F.format_string("15:%02d:00", minute).alias("time_of_day"),
        timing.seconds_text(duration).alias("duration_text"),
        duration.alias("duration_millis"),
    )


def _races(entries: DataFrame) -> DataFrame:
    rnd = F.col("round")
    return entries.select("season_year", "round").distinct().select(
        "season_year",
        "round",
        F.concat(F.lit("Grand Prix "), rnd).alias("race_name"),
        _slug("circuit_", rnd, 2).alias("circuit_id"),
        F.make_date(
            (F.col("season_year") % 10000).cast("int"),
            _div(rnd + 1, 2).cast("int"),
            F.when(rnd % 2 == 1, 1).otherwise(16),
        ).alias("race_date"),
        F.lit("14:00:00").alias("race_time"),
        F.lit(None).cast("string").alias("url"),
    )


def _drivers(spark: SparkSession, root: str) -> DataFrame:
    nation = _read(spark, root, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    name = F.split("s_name", "#")
    key = F.col("s_suppkey")
    return _read(spark, root, "supplier").join(nation, "s_nationkey", "left").select(
        driver_slug(key).alias("driver_id"),
        (key % 100).cast("int").alias("permanent_number"),
        F.concat(F.lit("D"), F.lpad((key % 100).cast("string"), 2, "0")).alias("code"),
        name[0].alias("given_name"),
        name[1].alias("family_name"),
        F.date_add(F.lit("1970-01-01").cast("date"), (key * 37 % 9000).cast("int")).alias("date_of_birth"),
        F.col("n_name").alias("nationality"),
        F.lit(None).cast("string").alias("url"),
    )


def _constructors(spark: SparkSession, root: str) -> DataFrame:
    nation = _read(spark, root, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    team = _div(F.col("s_suppkey"), 2)
    return (
        _read(spark, root, "supplier")
        .join(nation, "s_nationkey", "left")
        .groupBy(team.alias("team"))
        .agg(F.min("n_name").alias("nationality"))
        .select(
            _slug("team_", F.col("team")).alias("constructor_id"),
            F.concat(F.lit("Team "), F.col("team")).alias("name"),
            "nationality",
            F.lit(None).cast("string").alias("url"),
        )
    )


def _circuits(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("n_nationkey")
    region = _read(spark, root, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        _read(spark, root, "nation")
        .join(region, "n_regionkey", "left")
        .select(
            _slug("circuit_", key, 2).alias("circuit_id"),
            F.concat(F.col("n_name"), F.lit(" Ring")).alias("circuit_name"),
            F.col("n_name").alias("locality"),
            F.col("r_name").alias("country"),
            (key * 3 - 36).cast("decimal(10,6)").alias("latitude"),
            (key * 7 - 84).cast("decimal(10,6)").alias("longitude"),
            F.lit(None).cast("string").alias("url"),
        )
    )


_FROM_ENTRIES = {
    "race_results": _race_results,
    "qualifying_results": _qualifying,
    "sprint_results": _sprint,
    "driver_standings": _driver_standings,
    "constructor_standings": _constructor_standings,
    "races": _races,
    "seasons": lambda entries: entries.select("season_year").distinct().withColumn(
        "url", F.lit(None).cast("string")
    ),
}
_FROM_LAPS = {"lap_times": _lap_times, "pit_stops": _pit_stops}
_FROM_SOURCE = {"drivers": _drivers, "constructors": _constructors, "circuits": _circuits}


def race_tables(spark: SparkSession, root: str) -> RaceTables:
    """The race tables over the star-schema Parquet files under ``root``."""

    def load(name: str) -> DataFrame:
        if name in _FROM_ENTRIES:
            return _FROM_ENTRIES[name](_entries(spark, root))
        if name in _FROM_LAPS:
            return _FROM_LAPS[name](_laps(spark, root))
        return _FROM_SOURCE[name](spark, root)

    return RaceTables(load, lambda name, build: stored(spark, root, name, build))
