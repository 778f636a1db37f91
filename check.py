"""Run registered queries beside their reference SQL and compare the rows.

    python check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import importlib
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, build, sql):
    """(ok, message, rows, spark seconds, sql seconds)"""
    began = time.time()
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return True, "rows only", len(got[1]), took, 0.0
    began = time.time()
    cursor = con.execute(sql)
    wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    sql_took = time.time() - began
    if got[0] != wanted[0]:
        return False, f"columns {got[0]} != {wanted[0]}", len(got[1]), took, sql_took
    if got[1] != wanted[1]:
        only = [r for r in got[1] if r not in set(wanted[1])][:3]
        other = [r for r in wanted[1] if r not in set(got[1])][:3]
        note = f"rows {len(got[1])} / {len(wanted[1])}\n   spark {only}\n   sql   {other}"
        return False, note, len(got[1]), took, sql_took
    return True, "", len(got[1]), took, sql_took


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    from evidex.plans import registry
    from evidex.session import local_session

    if prefixes and prefixes[0].startswith("@"):
        importlib.import_module(f"evidex.plans.{prefixes[0][1:]}")
        prefixes = prefixes[1:]
    else:
        importlib.import_module("evidex.plans.catalog")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, build in sorted(registry.QUERIES.items()):
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note, rows, took, sql_took = compare(spark, con, sf_dir, build, registry.ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note, rows, took, sql_took = False, f"{type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {rows:8d} rows {took:6.1f}s sql {sql_took:5.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
