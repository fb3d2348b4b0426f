"""Run registered queries next to their SQL in DuckDB: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as contract


def _plain(value):
    """The value as something that can be counted: nested rows, maps and lists become tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(map(_plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        db.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return db


def compare(spark, db, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = contract.queries()[name](spark, folder)
    have = rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if have else "no rows"
    result = db.sql(sql)
    if sorted(result.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    want = rows_of(result.columns, result.fetchall())
    if have == want:
        return None
    extra, missing = list((have - want).items())[:3], list((want - have).items())[:3]
    return f"{sum(have.values())} rows != {sum(want.values())}\n  only Spark: {extra}\n  only SQL:   {missing}"


def types(df, result) -> list[str]:
    kinds = dict(zip(result.columns, map(str, result.types)))
    return [f"{f.name}: {f.dataType.simpleString()} / {kinds[f.name]}" for f in df.schema.fields]


if __name__ == "__main__":
    from tenderlake.session import build_session

    args = sys.argv[1:]
    where = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(where)
    failed = 0
    for key in args or contract.queries():
        start = time.time()
        try:
            problem = compare(session, connection, where, key)
        except Exception as error:  # report and go on with the next
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
