"""Run a registered query in Spark and its SQL in DuckDB, and compare names, types and rows."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(spark_type: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
            "double": "DOUBLE", "date": "DATE"}.get(spark_type, spark_type.upper())


def _key(value):
    return (value is not None, str(type(value)), value if value is not None else 0)


def _plain(value):
    if isinstance(value, Decimal):
        return Decimal(value).normalize()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: [_key(v) for v in r])


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, spark_type in df.dtypes:
        want = described[name]
        if want.startswith("DECIMAL") and spark_type.startswith("decimal"):
            continue
        if _kind(spark_type) != want:
            found.append(f"type of {name}: {spark_type} != {want}")
    if len(expected) != len(actual):
        found.append(f"rows {len(actual)} != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
