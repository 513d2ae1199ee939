"""Run a registered query and its SQL counterpart and compare types and rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hirespan.plans.bindings import TABLES  # noqa: E402

TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp", "DATE": "date",
}


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("set TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


oracle_time: list[float] = []


def differences(frame, connection, sql: str) -> list[str]:
    """Empty when the frame and the SQL agree in names, types and rows."""
    started = time.time()
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    types = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cursor.description}
    expected = sorted_rows(names, cursor.fetchall())
    oracle_time.append(time.time() - started)
    found = []
    spark_types = {n: t.replace("timestamp_ntz", "timestamp") for n, t in frame.dtypes}
    if spark_types != types:
        found.append(f"schema {sorted(spark_types.items())} != {sorted(types.items())}")
    actual = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    if actual != expected:
        for left, right in zip(actual, expected):
            if left != right:
                found.append(f"first difference {left} != {right}"[:1500])
                break
    if not expected:
        found.append("no rows")
    return found


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    from hirespan.plans import catalog
    from hirespan.session import build_session

    spark = build_session("8")
    connection = oracle_connection(sf_dir)
    bad = 0
    for name, run in catalog.QUERIES.items():
        if names and not any(part in name for part in names):
            continue
        started = time.time()
        oracle_time.clear()
        try:
            if name in catalog.ORACLES:
                found = differences(run(spark, sf_dir), connection, catalog.ORACLES[name])
            else:
                found = [] if run(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - started:.1f}s, of it SQL {sum(oracle_time):.1f}s", *found, sep="\n     ", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
