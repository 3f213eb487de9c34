"""Strict comparison of a registered query with its DuckDB counterpart."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return db


def cell(value):
    """Values keep their kind: 3 and 3.0 differ, decimals are not accepted."""
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal result; cast to double")
    if isinstance(value, (bool, datetime.date)):
        return str(value)
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    return repr(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(spark_df, db, sql: str) -> str | None:
    """None when both sides agree in columns, row count and every value."""
    result = db.execute(sql)
    theirs = [d[0] for d in result.description]
    ours = spark_df.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} against {sorted(theirs)}"
    left, right = rows_of(ours, spark_df.collect()), rows_of(theirs, result.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
