"""Run registered queries and their SQL in DuckDB over the same files, and compare every value."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((value is not None, str(type(value)), value if not isinstance(value, float) or not math.isnan(value) else "nan") for value in row)


def _sorted(rows):
    return sorted(rows, key=lambda row: str(_key(row)))


def compare(spark, con, folder: str, build, sql: str | None) -> tuple[str, int]:
    """Empty text when both agree, else the first difference; and the number of rows."""
    df = build(spark, folder)
    columns = sorted(df.columns)
    ours = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    if sql is None:
        return "", len(ours)
    result = con.sql(sql)
    kinds = dict(zip(result.columns, [str(t) for t in result.types]))
    if sorted(kinds) != columns:
        return f"columns {columns} and {sorted(kinds)}", len(ours)
    for field in df.schema.fields:
        if SAME.get(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} and {kinds[field.name]}", len(ours)
    position = [result.columns.index(c) for c in columns]
    theirs = [tuple(row[i] for i in position) for row in result.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}", len(ours)
    for mine, other in zip(_sorted(ours), _sorted(theirs)):
        if mine != other:
            return f"{dict(zip(columns, mine))} and {dict(zip(columns, other))}", len(ours)
    return "", len(ours)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from millwatch.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wrong = 0
    for name, build in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            problem, rows = compare(spark, con, folder, build, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        wrong += bool(problem)
        empty = " EMPTY" if rows == 0 else ""
        print(f"{'WRONG' if problem else 'ok'} {name} {rows}{empty} {time.time() - start:.1f}s {'' if name in oracles else '(no sql)'} {problem}", flush=True)
    print(f"{wrong} wrong", datetime.datetime.now())
    return wrong


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
