"""One driver holding half of all line items, and one item delivered 3000 times."""

import os
import shutil

import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect
from gridlake.operators import numbering

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    import duckdb

    root = str(tmp_path_factory.mktemp("skewed"))
    for table in TABLES:
        if table != "lineitem":
            shutil.copy(f"{SOURCE}/{table}.parquet", root)
    items = f"'{SOURCE}/lineitem.parquet'"
    duckdb.connect().execute(
        f"""COPY (SELECT * FROM {items}
            UNION ALL SELECT * REPLACE (CAST(3 AS BIGINT) AS l_suppkey) FROM {items}
            UNION ALL SELECT i.* FROM (SELECT * FROM {items} WHERE l_orderkey = 7 LIMIT 1) i, range(3000))
            TO '{root}/lineitem.parquet' (FORMAT parquet)"""
    )
    return root


@pytest.mark.parametrize("name", ["scan_race_results", "scan_lap_times", "scan_pit_stops", "lap_stats"])
def test_uneven_drivers(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(numbering, "COPIES_PER_PIECE", 500)
    problem, _, _ = compare(spark, connect(skewed), skewed, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None
