"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import math
from collections import Counter

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9) + 0.0
    return str(value)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str, shown: int = 3) -> str | None:
    """None when equal, otherwise a short description."""
    columns = df.columns
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} != {sorted(expected_columns)}"
    expected = _rows(expected_columns, cursor.fetchall())
    actual = _rows(columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    extra, missing = actual - expected, expected - actual
    return (
        f"rows {sum(actual.values())} != {sum(expected.values())}; "
        f"only Spark {list(extra.items())[:shown]}; only SQL {list(missing.items())[:shown]}; "
        f"columns {sorted(columns)}"
    )
