"""Landed JSON pages to typed rows.

A page is one JSON document, wrapped in an ``MRData`` envelope or bare, with
paging fields and one domain table; all scalars are text.  A parser returns
every record with a ``reject_reason``: ``accepted`` keeps the good rows,
``rejected`` the others, and ``strict`` fails the job on the first bad one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.scalars import blank_to_null, strip
from gridlake.functions.timing import time_problem, time_to_millis
from gridlake.operators.temporal import RANGES, max_before

# Page layout --------------------------------------------------
RESERVED_KEYS = ("xmlns", "series", "url", "limit", "offset", "total")
_DRIVER = (
    "struct<driverId:string,permanentNumber:string,code:string,givenName:string,familyName:string,"
    "dateOfBirth:string,nationality:string,url:string>"
)
_CONSTRUCTOR = "struct<constructorId:string,name:string,nationality:string,url:string>"
_CIRCUIT = (
    "struct<circuitId:string,circuitName:string,url:string,"
    "Location:struct<lat:string,long:string,locality:string,country:string>>"
)
_RESULT = (
    f"struct<number:string,position:string,positionText:string,points:string,Driver:{_DRIVER},"
    f"Constructor:{_CONSTRUCTOR},grid:string,laps:string,status:string,Time:struct<millis:string,time:string>,"
    "FastestLap:struct<rank:string,lap:string,Time:struct<time:string>>>"
)
_QUALIFYING = (
    f"struct<number:string,position:string,Driver:{_DRIVER},Constructor:{_CONSTRUCTOR},"
    "Q1:string,Q2:string,Q3:string>"
)
_STOP = "struct<driverId:string,stop:string,lap:string,time:string,duration:string>"
_LAP = "struct<number:string,Timings:array<struct<driverId:string,position:string,time:string>>>"
_RACE = (
    f"struct<season:string,round:string,url:string,raceName:string,date:string,time:string,Circuit:{_CIRCUIT},"
    f"Results:array<{_RESULT}>,QualifyingResults:array<{_QUALIFYING}>,SprintResults:array<{_RESULT}>,"
    f"PitStops:array<{_STOP}>,Laps:array<{_LAP}>>"
)
_STANDINGS = (
    "struct<season:string,round:string,"
    f"DriverStandings:array<struct<position:string,points:string,wins:string,Driver:{_DRIVER}>>,"
    f"ConstructorStandings:array<struct<position:string,points:string,wins:string,Constructor:{_CONSTRUCTOR}>>>"
)
_TABLES = {
    "SeasonTable": "struct<Seasons:array<struct<season:string,url:string>>>",
    "CircuitTable": f"struct<Circuits:array<{_CIRCUIT}>>",
    "ConstructorTable": f"struct<Constructors:array<{_CONSTRUCTOR}>>",
    "DriverTable": f"struct<Drivers:array<{_DRIVER}>>",
    "RaceTable": f"struct<season:string,round:string,Races:array<{_RACE}>>",
    "StandingsTable": f"struct<StandingsLists:array<{_STANDINGS}>>",
}
# Which table and list each listing endpoint carries.
RECORD_LISTS = {
    "seasons": ("SeasonTable", "Seasons"),
    "circuits": ("CircuitTable", "Circuits"),
    "constructors": ("ConstructorTable", "Constructors"),
    "drivers": ("DriverTable", "Drivers"),
    "races": ("RaceTable", "Races"),
    "race_results": ("RaceTable", "Races"),
    "qualifying_results": ("RaceTable", "Races"),
    "sprint_results": ("RaceTable", "Races"),
    "pit_stops": ("RaceTable", "Races"),
    "lap_times": ("RaceTable", "Races"),
    "driver_standings": ("StandingsTable", "StandingsLists"),
    "constructor_standings": ("StandingsTable", "StandingsLists"),
}
# ----------------------------------------------------------------------------

_CONTENT = ",".join(f"{k}:{v}" for k, v in {**{k: "string" for k in RESERVED_KEYS}, **_TABLES}.items())
_DOCUMENT = f"struct<MRData:struct<{_CONTENT}>,{_CONTENT},_corrupt:string>"

# Place of a parsed row in its delivery.
ORDER = "batch_order"

Field = tuple[str, Column, Column | None]


def read_pages(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Pages as a ``payload`` column, one document per line or per file."""
    text = spark.read.text(path, wholetext=not one_per_line)
    return text.select(F.col("value").alias("payload"), F.input_file_name().alias("endpoint"))


def decode(pages: DataFrame) -> DataFrame:
    """The page body as a typed ``page`` column, and why a page cannot be read."""
    document = F.from_json("payload", _DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt"})
    body = F.coalesce(
        F.col("_d.MRData"), F.struct(*[F.col(f"_d.{k}").alias(k) for k in (*RESERVED_KEYS, *_TABLES)])
    )
    unreadable = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull()
    return pages.withColumn("_d", document).select(
        *pages.columns, body.alias("page"), F.when(unreadable, "page is not a JSON object").alias("page_problem")
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Paging numbers and the domain tables of each page; the envelope is required here."""
    body = F.from_json(F.get_json_object("payload", "$.MRData"), "map<string,string>")
    numbers = [F.coalesce(F.col("_m")[k], F.lit("0")).try_cast("int").alias(k) for k in ("limit", "offset", "total")]
    problem = F.when(F.col("_m").isNull(), "missing MRData envelope").when(
        F.col("limit").isNull() | F.col("offset").isNull() | F.col("total").isNull(), "invalid paging numbers"
    )
    return (
        pages.withColumn("_m", body)
        .select(
            *pages.columns,
            "_m",
            *numbers,
            F.array_except(F.map_keys("_m"), F.array(*map(F.lit, RESERVED_KEYS))).alias("tables"),
        )
        .withColumn("reject_reason", problem)
        .drop("_m")
    )


def raw_records(pages: DataFrame, resource_key: str, table_key: str | None = None) -> DataFrame:
    """Records of a list anywhere in a page's table, as JSON text.

    Without ``table_key``, or where the page lacks it, the page's only
    non-paging key is taken as its table, or else the page itself.
    """
    content = F.map_filter("_m", lambda k, _: ~k.isin(*RESERVED_KEYS))
    table = F.when(F.size("_c") == 1, F.map_values("_c")[0]).otherwise(F.to_json("_c"))
    if table_key:
        table = F.coalesce(F.col("_c")[table_key], table)
    items = F.from_json(table, "map<string,string>")[resource_key]
    return (
        pages.withColumn("_m", F.from_json(F.get_json_object("payload", "$.MRData"), "map<string,string>"))
        .withColumn("_c", content)
        .select(*pages.columns, F.explode(F.from_json(items, "array<string>")).alias("record"))
    )


def entity_records(pages: DataFrame, entity: str) -> DataFrame:
    """Raw records of an entity's listing pages, whose table and list are known."""
    table, items = RECORD_LISTS[entity]
    return raw_records(pages, items, table)


def page_series_audit(pages: DataFrame, endpoint: str = "endpoint", ranges: int = RANGES) -> DataFrame:
    """Whether the landed pages of each endpoint cover all its records.

    In the order of their offsets, each page has to begin no later than the
    pages before it end, the first one at 0, and the last end has to reach the
    total.  Pages may overlap; an overlap does not make up for a gap.  A page
    whose paging cannot be read covers nothing.  An endpoint of very many pages
    is split by ``ranges`` of its offsets.
    """
    read = page_metadata(pages).where("reject_reason IS NULL").select(endpoint, "limit", "offset", "total")
    end = F.col("offset").cast("long") + F.col("limit")
    placed = max_before(read.distinct(), [endpoint], ["offset", "limit"], end, "reached", ranges)
    placed = placed.withColumn("reached", F.coalesce("reached", F.lit(0)))
    series = placed.groupBy(endpoint).agg(
        F.count(F.lit(1)).alias("pages"),
        F.max("total").alias("total"),
        F.min("offset").alias("first_offset"),
        F.max(end).alias("covered"),
        F.count(F.when(F.col("offset") > F.col("reached"), 1)).alias("gaps"),
    )
    return series.withColumn("is_complete", (F.col("gaps") == 0) & (F.col("covered") >= F.col("total")))


# Field parsers: (name, value, problem) --------------------------------------


def _missing(raw: Column, label: str) -> Column:
    return F.when(blank_to_null(raw).isNull(), f"{label} is missing or empty")


def required_text(name: str, raw: Column, label: str) -> Field:
    return name, blank_to_null(raw), _missing(raw, label)


def optional_text(name: str, raw: Column) -> Field:
    return name, blank_to_null(raw), None


def _typed(name: str, raw: Column, label: str, pattern: str, kind: str, required: bool) -> Field:
    text = blank_to_null(raw)
    value = F.when(text.rlike(pattern), text.try_cast(kind))
    problem = F.when(text.isNotNull() & value.isNull(), f"{label} is not a valid {kind}")
    if required:
        problem = F.coalesce(_missing(raw, label), problem)
    return name, value, problem


def integer(name: str, raw: Column, label: str, required: bool = True, minimum: int | None = None) -> Field:
    kind = "bigint" if name in ("season_year", "time_millis", "lap_number", "stop_number", "lap") else "int"
    name, value, problem = _typed(name, raw, label, r"\A[+-]?[0-9]+\z", kind, required)
    if minimum is not None:
        problem = F.coalesce(problem, F.when(value < minimum, f"{label} is below {minimum}"))
    return name, value, problem


def decimal(name: str, raw: Column, label: str, kind: str, required: bool = True) -> Field:
    return _typed(name, raw, label, r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z", kind, required)


def date(name: str, raw: Column, label: str, required: bool = True) -> Field:
    return _typed(name, raw, label, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "date", required)


def clock(name: str, raw: Column, label: str) -> Field:
    """``HH:MM[:SS][Z]`` as ``HH:MM:SS`` text."""
    text = F.regexp_replace(strip(raw), "Z+$", "")
    parts = F.split(text, ":")
    number = [F.coalesce(F.get(parts, F.lit(i)), F.lit("0")).try_cast("int") for i in range(3)]
    valid = (
        F.size(parts).between(2, 3)
        & number[0].between(0, 23)
        & number[1].between(0, 59)
        & number[2].between(0, 59)
    )
    known = blank_to_null(raw).isNotNull()
    value = F.when(known & valid, F.format_string("%02d:%02d:%02d", *number))
    return name, value, F.when(known & value.isNull(), f"{label} is not a valid time")


def duration(name: str, raw: Column, label: str, kind: str = "int") -> Field:
    text = blank_to_null(raw)
    return name, time_to_millis(text).cast(kind), F.when(time_problem(text).isNotNull(), f"{label} is not a valid time")


def _rows(frame: DataFrame, fields: list[Field], *outer: Column) -> DataFrame:
    problems = [*outer, *[p for _, _, p in fields if p is not None]]
    kept = [c for c in ("endpoint",) if c in frame.columns]
    endpoint = F.col("endpoint") if kept else F.lit(None).cast("string")
    return frame.select(
        *kept,
        *[value.alias(name) for name, value, _ in fields],
        F.struct(endpoint.alias("endpoint"), F.col("at")).alias(ORDER),
        F.coalesce(*problems).alias("reject_reason"),
    )


def accepted(parsed: DataFrame, ordered: bool = False) -> DataFrame:
    """The good rows; with ``ordered``, with their place in the delivery (page, offset, place in the page)."""
    rows = parsed.where("reject_reason IS NULL").drop("reject_reason", "endpoint")
    return rows if ordered else rows.drop(ORDER)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL")


def strict(parsed: DataFrame) -> DataFrame:
    """The rows, failing the job as soon as one of them was rejected."""
    checked = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.col("reject_reason"))).otherwise(F.lit(True))
    return parsed.where(checked).drop("reject_reason", "endpoint", ORDER)


def _explode(pages: DataFrame, table: str, items: str) -> tuple[DataFrame, Column]:
    """One row per list item of the table; an unusable page yields one row with its problem."""
    problem = F.coalesce("page_problem", F.when(F.col(f"page.{table}").isNull(), f"page has no {table}"))
    listed = F.col(f"page.{table}.{items}")
    none = F.array().cast(decode(pages).select(listed).schema[0].dataType)
    one_null = F.array(F.lit(None)).cast(decode(pages).select(listed).schema[0].dataType)
    frame = decode(pages).withColumn("page_problem", problem)
    chosen = F.when(F.col("page_problem").isNotNull(), one_null).otherwise(F.coalesce(listed, none))
    kept = [c for c in ("endpoint",) if c in pages.columns]
    offset = F.coalesce(F.col("page.offset").try_cast("int"), F.lit(0)).alias("offset")
    opened = frame.select(*kept, "page_problem", offset, F.posexplode(chosen).alias("pos", "r"))
    return opened.withColumn("at", F.array("offset", "pos")).drop("offset", "pos"), F.col("page_problem")


def _nested(pages: DataFrame, table: str, items: str, key: str) -> tuple[DataFrame, Column]:
    """One row per record of a nested list; a missing list is a problem, an empty one is not."""
    frame, page_problem = _explode(pages, table, items)
    listed = F.col(f"r.{key}")
    kind = frame.select(listed).schema[0].dataType
    missing = F.coalesce(page_problem, F.when(listed.isNull(), f"race has no {key}"))
    kept = [c for c in ("endpoint",) if c in pages.columns]
    opened = frame.select(
        *kept,
        "at",
        missing.alias("page_problem"),
        F.col("r.season").alias("season"),
        F.col("r.round").alias("round"),
        F.posexplode(F.when(listed.isNull(), F.array(F.lit(None)).cast(kind)).otherwise(listed)).alias("pos", "x"),
    )
    return opened.withColumn("at", F.concat("at", F.array("pos"))).drop("pos"), F.col("page_problem")


def _event_key() -> list[Field]:
    return [integer("season_year", F.col("season"), "season"), integer("round", F.col("round"), "round")]


def parse_seasons(pages: DataFrame) -> DataFrame:
    frame, problem = _explode(pages, "SeasonTable", "Seasons")
    return _rows(frame, [integer("season_year", F.col("r.season"), "season"), optional_text("url", F.col("r.url"))], problem)


def parse_circuits(pages: DataFrame) -> DataFrame:
    frame, problem = _explode(pages, "CircuitTable", "Circuits")
    return _rows(
        frame,
        [
            required_text("circuit_id", F.col("r.circuitId"), "circuitId"),
            required_text("circuit_name", F.col("r.circuitName"), "circuitName"),
            optional_text("locality", F.col("r.Location.locality")),
            optional_text("country", F.col("r.Location.country")),
            decimal("latitude", F.col("r.Location.lat"), "latitude", "decimal(10,6)", required=False),
            decimal("longitude", F.col("r.Location.long"), "longitude", "decimal(10,6)", required=False),
            optional_text("url", F.col("r.url")),
        ],
        problem,
    )


def parse_constructors(pages: DataFrame) -> DataFrame:
    frame, problem = _explode(pages, "ConstructorTable", "Constructors")
    return _rows(
        frame,
        [
            required_text("constructor_id", F.col("r.constructorId"), "constructorId"),
            required_text("name", F.col("r.name"), "name"),
            optional_text("nationality", F.col("r.nationality")),
            optional_text("url", F.col("r.url")),
        ],
        problem,
    )


def parse_drivers(pages: DataFrame) -> DataFrame:
    frame, problem = _explode(pages, "DriverTable", "Drivers")
    return _rows(
        frame,
        [
            required_text("driver_id", F.col("r.driverId"), "driverId"),
            integer("permanent_number", F.col("r.permanentNumber"), "permanentNumber", required=False),
            optional_text("code", F.col("r.code")),
            required_text("given_name", F.col("r.givenName"), "givenName"),
            required_text("family_name", F.col("r.familyName"), "familyName"),
            date("date_of_birth", F.col("r.dateOfBirth"), "dateOfBirth", required=False),
            optional_text("nationality", F.col("r.nationality")),
            optional_text("url", F.col("r.url")),
        ],
        problem,
    )


def parse_races(pages: DataFrame) -> DataFrame:
    frame, problem = _explode(pages, "RaceTable", "Races")
    return _rows(
        frame,
        [
            integer("season_year", F.col("r.season"), "season"),
            integer("round", F.col("r.round"), "round"),
            required_text("race_name", F.col("r.raceName"), "raceName"),
            required_text("circuit_id", F.col("r.Circuit.circuitId"), "circuitId"),
            date("race_date", F.col("r.date"), "date"),
            clock("race_time", F.col("r.time"), "time"),
            optional_text("url", F.col("r.url")),
        ],
        problem,
    )


def _parse_results(pages: DataFrame, key: str) -> DataFrame:
    frame, problem = _nested(pages, "RaceTable", "Races", key)
    zero = F.lit("0")
    lap_time = F.col("x.FastestLap.Time.time")
    return _rows(
        frame,
        [
            *_event_key(),
            required_text("driver_id", F.col("x.Driver.driverId"), "driverId"),
            required_text("constructor_id", F.col("x.Constructor.constructorId"), "constructorId"),
            integer("car_number", F.col("x.number"), "number", required=False),
            integer("grid_position", F.col("x.grid"), "grid", required=False),
            integer("source_position", F.col("x.position"), "position", required=False),
            required_text("position_text", F.col("x.positionText"), "positionText"),
            decimal("points", F.coalesce("x.points", zero), "points", "decimal(5,2)"),
            integer("laps_completed", F.coalesce("x.laps", zero), "laps"),
            required_text("status", F.col("x.status"), "status"),
            integer("time_millis", F.col("x.Time.millis"), "millis", required=False),
            optional_text("time_text", F.col("x.Time.time")),
            integer("fastest_lap_rank", F.col("x.FastestLap.rank"), "rank", required=False),
            integer("fastest_lap_number", F.col("x.FastestLap.lap"), "lap", required=False),
            optional_text("fastest_lap_time", lap_time),
            duration("fastest_lap_time_millis", lap_time, "fastest lap"),
        ],
        problem,
    )


def parse_race_results(pages: DataFrame) -> DataFrame:
    return _parse_results(pages, "Results")


def parse_sprint_results(pages: DataFrame) -> DataFrame:
    return _parse_results(pages, "SprintResults")


def parse_qualifying_results(pages: DataFrame) -> DataFrame:
    frame, problem = _nested(pages, "RaceTable", "Races", "QualifyingResults")
    times = [
        field
        for n in (1, 2, 3)
        for field in (
            optional_text(f"q{n}_time", F.col(f"x.Q{n}")),
            duration(f"q{n}_time_millis", F.col(f"x.Q{n}"), f"Q{n}"),
        )
    ]
    return _rows(
        frame,
        [
            *_event_key(),
            required_text("driver_id", F.col("x.Driver.driverId"), "driverId"),
            required_text("constructor_id", F.col("x.Constructor.constructorId"), "constructorId"),
            integer("car_number", F.col("x.number"), "number", required=False),
            integer("position", F.col("x.position"), "position"),
            *times,
        ],
        problem,
    )


def parse_pit_stops(pages: DataFrame) -> DataFrame:
    frame, problem = _nested(pages, "RaceTable", "Races", "PitStops")
    return _rows(
        frame,
        [
            *_event_key(),
            required_text("driver_id", F.col("x.driverId"), "driverId"),
            integer("stop_number", F.col("x.stop"), "stop", minimum=1),
            integer("lap", F.col("x.lap"), "lap", minimum=0),
            optional_text("time_of_day", F.col("x.time")),
            optional_text("duration_text", F.col("x.duration")),
            duration("duration_millis", F.col("x.duration"), "duration", "bigint"),
        ],
        problem,
    )


def parse_lap_times(pages: DataFrame) -> DataFrame:
    laps, problem = _nested(pages, "RaceTable", "Races", "Laps")
    kind = laps.select("x.Timings").schema[0].dataType
    bad = problem.isNotNull() | F.col("x.number").isNull()
    timings = F.when(bad, F.array(F.lit(None)).cast(kind)).otherwise(F.coalesce("x.Timings", F.array().cast(kind)))
    kept = [c for c in ("endpoint",) if c in pages.columns]
    frame = laps.select(
        *kept, "at", "page_problem", "season", "round", F.col("x.number").alias("number"),
        F.posexplode(timings).alias("pos", "y"),
    ).withColumn("at", F.concat("at", F.array("pos")))
    return _rows(
        frame,
        [
            *_event_key(),
            required_text("driver_id", F.col("y.driverId"), "driverId"),
            integer("lap_number", F.col("number"), "number", minimum=1),
            integer("position", F.col("y.position"), "position"),
            ("time", F.coalesce(blank_to_null(F.col("y.time")), F.lit("")), None),
            duration("time_millis", F.col("y.time"), "time"),
        ],
        F.col("page_problem"),
    )


def _parse_standings(pages: DataFrame, key: str, entity: str, identifier: str, column: str) -> DataFrame:
    frame, problem = _nested(pages, "StandingsTable", "StandingsLists", key)
    zero = F.lit("0")
    return _rows(
        frame,
        [
            *_event_key(),
            required_text(column, F.col(f"x.{entity}.{identifier}"), identifier),
            integer("position", F.col("x.position"), "position"),
            decimal("points", F.coalesce("x.points", zero), "points", "decimal(7,2)"),
            integer("wins", F.coalesce("x.wins", zero), "wins"),
        ],
        problem,
    )


def parse_driver_standings(pages: DataFrame) -> DataFrame:
    return _parse_standings(pages, "DriverStandings", "Driver", "driverId", "driver_id")


def parse_constructor_standings(pages: DataFrame) -> DataFrame:
    return _parse_standings(pages, "ConstructorStandings", "Constructor", "constructorId", "constructor_id")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "seasons": parse_seasons,
    "circuits": parse_circuits,
    "constructors": parse_constructors,
    "drivers": parse_drivers,
    "races": parse_races,
    "race_results": parse_race_results,
    "qualifying_results": parse_qualifying_results,
    "sprint_results": parse_sprint_results,
    "pit_stops": parse_pit_stops,
    "lap_times": parse_lap_times,
    "driver_standings": parse_driver_standings,
    "constructor_standings": parse_constructor_standings,
}


def landed(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """The pages of a folder; an entity that was not delivered has none."""
    try:
        return read_pages(spark, path, one_per_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "payload string, endpoint string")


def parse_landing(
    spark: SparkSession, root: str, include_laps: bool = True, season: int | None = None, one_per_line: bool = True
) -> dict[str, DataFrame]:
    """All entities landed under ``root/<entity>``, parsed but not yet filtered.

    With ``season``, a season the landed list lacks is added as a bare row.
    """
    parsed = {
        entity: parser(landed(spark, f"{root}/{entity}", one_per_line))
        for entity, parser in PARSERS.items()
        if include_laps or entity != "lap_times"
    }
    if season is not None:
        parsed["seasons"] = with_season(parsed["seasons"], season)
    return parsed


def with_season(seasons: DataFrame, season: int) -> DataFrame:
    """The parsed seasons, plus a bare row for one the list lacks."""
    bare = seasons.sparkSession.range(1).select(F.lit(season).cast("bigint").alias("season_year"))
    present = seasons.where(F.col("reject_reason").isNull()).select("season_year")
    return seasons.unionByName(bare.join(present, "season_year", "left_anti"), allowMissingColumns=True)
