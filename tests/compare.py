"""Runs a sample query in Spark and its SQL in DuckDB, and compares schema and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, (int, float, decimal.Decimal)):
        return (1, float(value))
    if isinstance(value, datetime.datetime):
        return (2, value.isoformat())
    return (3, str(value))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(df, connection, sql: str, ordered: bool = False) -> list[str]:
    cursor = connection.execute(sql)
    expected_types = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cursor.description}
    names = [c[0] for c in cursor.description]
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    actual = [row.asDict() for row in df.collect()]
    found = []
    if dict(df.dtypes) != expected_types:
        found.append(f"schema {dict(df.dtypes)} != {expected_types}")
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows != {len(expected)}")
    columns = sorted(names)
    if not found:
        rows = [[[r[c] for c in columns] for r in side] for side in (actual, expected)]
        if not ordered:
            rows = [sorted(side, key=lambda r: [_key(v) for v in r]) for side in rows]
        for a, e in zip(*rows):
            if not all(_same(x, y) for x, y in zip(a, e)):
                found.append(f"{dict(zip(columns, a))} != {dict(zip(columns, e))}")
                if len(found) > 3:
                    break
    return found
