import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gridlake.session import local_session

    session = local_session(4, "gridlake-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # The test tables are tiny; compiling each plan would take most of the time.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def event(spark, tmp_path_factory):
    """Six cars in one race: a retirement, a pit-lane start, untimed stops and laps."""
    from decimal import Decimal

    from gridlake.tables import read_tables, schema

    root = str(tmp_path_factory.mktemp("event"))

    def frame(name, rows):
        columns = schema(name).fieldNames()
        return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema(name))

    race = {"season_year": 2030, "round": 1}
    # driver, team, grid, position, text, points, laps, status, millis
    results = [
        ("ada", "north", 1, 1, "1", "30.0", 40, "Finished", 4000100),
        ("bea", "north", 6, 2, "2", "20.0", 40, "Finished", 4011350),
        ("dov", "south", 4, 3, "3", "16.0", 40, "Finished", 4019900),
        ("cem", "south", 2, 4, "4", "13.0", 40, "Finished", 4032275),
        ("fay", "east", 17, None, "R", "0.0", 11, "Gearbox", None),
        ("eli", "east", None, 10, "10", "2.0", 40, "Finished", 4060800),
    ]
    # driver, team, position, best times of the three sessions
    qualifying = [
        ("ada", "north", 1, 71500, 70900, 70400),
        ("cem", "south", 2, 71800, 70700, 70850),
        ("dov", "south", 4, 71400, 71050, 70990),
        ("bea", "north", 6, 71700, 71300, 70980),
        ("fay", "east", 17, 72600, None, None),
    ]
    # driver, stop, lap, millis
    stops = [
        ("ada", 1, 15, 23400),
        ("ada", 2, 31, 23100),
        ("bea", 1, 10, 24800),
        ("bea", 2, 30, 24000),
        ("cem", 1, 9, 26000),
        ("dov", 1, 12, None),
    ]
    # driver, lap, millis
    laps = [
        ("ada", 1, 99500),
        ("ada", 20, 97000),
        ("cem", 1, 100200),
        ("cem", 2, None),
    ]
    drivers = [("ada", "30"), ("bea", "20"), ("dov", "16"), ("cem", "13")]
    teams = [("north", "50"), ("south", "29")]
    result_keys = (
        "driver_id constructor_id grid_position source_position position_text points laps_completed status time_millis"
    ).split()
    rows = {
        "seasons": [{"season_year": 2030}],
        "circuits": [{"circuit_id": "ring", "circuit_name": "The Ring"}],
        "races": [
            {**race, "race_name": "First Grand Prix", "circuit_id": "ring", "race_date": datetime.date(2030, 5, 4)}
        ],
        "drivers": [{"driver_id": r[0], "given_name": r[0].upper(), "family_name": "X"} for r in results],
        "constructors": [{"constructor_id": c, "name": c.title()} for c in sorted({r[1] for r in results})],
        "race_results": [
            {**race, **dict(zip(result_keys, r)), "points": Decimal(r[5])} for r in results
        ],
        "qualifying_results": [
            {
                **race,
                **dict(zip(("driver_id", "constructor_id", "position", "q1_time_millis", "q2_time_millis", "q3_time_millis"), q)),
            }
            for q in qualifying
        ],
        "sprint_results": [],
        "pit_stops": [{**race, **dict(zip(("driver_id", "stop_number", "lap", "duration_millis"), s))} for s in stops],
        "lap_times": [
            {**race, "driver_id": d, "lap_number": n, "position": 1, "time": "" if ms else "IN PIT", "time_millis": ms}
            for d, n, ms in laps
        ],
        "driver_standings": [
            {**race, "driver_id": d, "position": i + 1, "points": Decimal(p), "wins": int(i == 0)}
            for i, (d, p) in enumerate(drivers)
        ],
        "constructor_standings": [
            {**race, "constructor_id": c, "position": i + 1, "points": Decimal(p), "wins": int(i == 0)}
            for i, (c, p) in enumerate(teams)
        ],
    }
    for name, values in rows.items():
        frame(name, values).coalesce(1).write.parquet(f"{root}/{name}")
    return read_tables(spark, root)
