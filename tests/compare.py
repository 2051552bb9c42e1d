"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    for kind in (int, float, str, datetime, date, Decimal):
        if isinstance(value, kind):
            return kind.__name__
    return type(value).__name__


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when names, kinds of value and all values agree."""
    names, ours = spark_rows(df)
    expected_names, expected = duck_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(ours) != len(expected):
        return f"{len(ours)} rows != {len(expected)}"
    for a, b in zip(ours, expected):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"\n  ours     {a}\n  expected {b}"
    return None
