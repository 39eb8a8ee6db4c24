"""The thirteen race tables: schemas, natural keys, and lazy access."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    """``name type`` pairs; a trailing ``!`` marks a column that may not be null."""
    fields = []
    for item in spec.split(";"):
        name, kind = item.split()
        fields.append(T.StructField(name, T._parse_datatype_string(kind.rstrip("!")), not kind.endswith("!")))
    return T.StructType(fields)


_RESULT_COLUMNS = (
    "season_year bigint!;round int!;driver_id string!;constructor_id string!;car_number int;"
    "grid_position int;source_position int;position_text string!;points decimal(5,2)!;"
    "laps_completed int!;status string!;time_millis bigint;time_text string;fastest_lap_rank int;"
    "fastest_lap_number int;fastest_lap_time string;fastest_lap_time_millis int"
)

_SPECS = {
    "seasons": "season_year bigint!;url string",
    "circuits": "circuit_id string!;circuit_name string!;locality string;country string;"
    "latitude decimal(10,6);longitude decimal(10,6);url string",
    "constructors": "constructor_id string!;name string!;nationality string;url string",
    "drivers": "driver_id string!;permanent_number int;code string;given_name string!;"
    "family_name string!;date_of_birth date;nationality string;url string",
    "races": "season_year bigint!;round int!;race_name string!;circuit_id string!;race_date date!;"
    "race_time string;url string",
    "race_results": _RESULT_COLUMNS,
    "qualifying_results": "season_year bigint!;round int!;driver_id string!;constructor_id string!;"
    "car_number int;position int!;q1_time string;q1_time_millis int;q2_time string;"
    "q2_time_millis int;q3_time string;q3_time_millis int",
    "sprint_results": _RESULT_COLUMNS,
    "pit_stops": "season_year bigint!;round int!;driver_id string!;stop_number bigint!;lap bigint!;"
    "time_of_day string;duration_text string;duration_millis bigint",
    "lap_times": "season_year bigint!;round int!;driver_id string!;lap_number bigint!;position int!;"
    "time string!;time_millis int",
    "driver_standings": "season_year bigint!;round int!;driver_id string!;position int!;"
    "points decimal(7,2)!;wins int!",
    "constructor_standings": "season_year bigint!;round int!;constructor_id string!;position int!;"
    "points decimal(7,2)!;wins int!",
    "etl_log": "source string!;entity_type string!;endpoint string;source_url string;"
    "season_year bigint;round int;status string!;records_processed bigint!;records_inserted bigint!;"
    "records_updated bigint!;records_skipped bigint!;error_message string;"
    "started_at timestamp_ntz!;completed_at timestamp_ntz;records_rejected bigint!;run_id bigint!",
    "rejects": "entity_type string!;endpoint string;reason string!;record string;run_id bigint!",
}

SCHEMAS: dict[str, T.StructType] = {}

NATURAL_KEYS = {
    "seasons": ["season_year"],
    "circuits": ["circuit_id"],
    "constructors": ["constructor_id"],
    "drivers": ["driver_id"],
    "races": ["season_year", "round"],
    "race_results": ["season_year", "round", "driver_id"],
    "qualifying_results": ["season_year", "round", "driver_id"],
    "sprint_results": ["season_year", "round", "driver_id"],
    "pit_stops": ["season_year", "round", "driver_id", "stop_number"],
    "lap_times": ["season_year", "round", "driver_id", "lap_number"],
    "driver_standings": ["season_year", "round", "driver_id"],
    "constructor_standings": ["season_year", "round", "constructor_id"],
}

_RACE = ("races", ["season_year", "round"])
_DRIVER = ("drivers", ["driver_id"])
_CONSTRUCTOR = ("constructors", ["constructor_id"])
_SEASON = ("seasons", ["season_year"])

# table -> parents it must find: (parent table, join columns)
FOREIGN_KEYS = {
    "races": [_SEASON, ("circuits", ["circuit_id"])],
    "race_results": [_RACE, _DRIVER, _CONSTRUCTOR],
    "qualifying_results": [_RACE, _DRIVER, _CONSTRUCTOR],
    "sprint_results": [_RACE, _DRIVER, _CONSTRUCTOR],
    "pit_stops": [_RACE, _DRIVER],
    "lap_times": [_RACE, _DRIVER],
    "driver_standings": [_SEASON, _DRIVER],
    "constructor_standings": [_SEASON, _CONSTRUCTOR],
}

# Dimensions first, then facts, then standings.
INGEST_ORDER = list(NATURAL_KEYS)


def schema(table: str) -> T.StructType:
    if table not in SCHEMAS:
        SCHEMAS[table] = _schema(_SPECS[table])
    return SCHEMAS[table]


class RaceTables:
    """Lazy, named access to the race tables.

    ``loader`` is called once per table, so a query only touches what it reads.
    ``keeper`` stores a derived frame that a job reads more than once.
    """

    def __init__(
        self,
        loader: Callable[[str], DataFrame],
        keeper: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
    ):
        self._loader = loader
        self._keeper = keeper
        self._loaded: dict[str, DataFrame] = {}
        self._few: dict[str, bool] = {}

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame]) -> RaceTables:
        return cls(frames.__getitem__)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = self._loader(name)
        return self._loaded[name]

    def has_few(self, name: str, limit: int) -> bool:
        """Whether the table has at most so many rows; counted once."""
        if name not in self._few:
            self._few[name] = self[name].count() <= limit
        return self._few[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The frame, stored once where these tables have a place for it."""
        return self._keeper(name, build) if self._keeper else build()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _SPECS:
            raise AttributeError(name)
        return self[name]


def read_tables(spark: SparkSession, root: str) -> RaceTables:
    """Race tables stored as Parquet folders under ``root``."""
    return RaceTables(lambda name: spark.read.schema(schema(name)).parquet(f"{root}/{name}"))


def read_database(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> RaceTables:
    """Race tables in an existing database, through Spark's JDBC source."""
    return RaceTables(lambda name: spark.read.jdbc(url, name, properties=dict(properties or {})))
