"""Compare registered queries with their SQL: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, root, name, query, sql):
    """None if the results agree, else what differs; and the two run times."""
    start = time.time()
    frame = query(spark, root)
    got_columns, got = rows_of(frame.columns, frame.collect())
    middle = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    times = (middle - start, time.time() - middle)
    kinds = {"bigint": "NUMBER BIGINT INTEGER", "double": "NUMBER DOUBLE", "string": "STRING VARCHAR", "boolean": "BOOLEAN bool"}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    odd = [
        (f.name, f.dataType.simpleString(), sql_types.get(f.name))
        for f in frame.schema
        if sql_types.get(f.name) not in kinds.get(f.dataType.simpleString(), "").split()
    ]
    if odd:
        print("   types", odd)
    if got_columns != want_columns:
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}", times, len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}", times, len(got)
    if got != want:
        ours, theirs = next((a, b) for a, b in zip(got, want) if a != b)
        cells = [(c, x, y) for c, x, y in zip(got_columns, ours, theirs) if x != y]
        wrong = sum(a != b for a, b in zip(got, want))
        return f"{wrong} of {len(got)} rows, e.g. {cells[:4]} in {ours}", times, len(got)
    return None, times, len(got)


def main():
    import __spark_entry__ as entry
    from gridlake.session import local_session

    args = sys.argv[1:]
    root = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(root)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name in args or queries:
        if name not in sql:
            frame = queries[name](spark, root)
            print(f"{name:32} rows only {frame.count()}")
            continue
        try:
            problem, (ours, theirs), count = compare(spark, con, root, name, queries[name], sql[name])
        except Exception as error:
            problem, ours, theirs, count = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        print(f"{name:32} {'ok' if not problem else 'FAIL'} {count} rows {ours:.2f}s / {theirs:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
