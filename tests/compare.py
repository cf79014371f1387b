"""Compares a Spark result with DuckDB's answer to the check SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "hour") and getattr(v, "tzinfo", None) is None:
        return v.isoformat(sep=" ")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and values agree (doubles to a rounding step)."""
    answer = con.sql(sql)
    want_types = dict(zip(answer.columns, [str(t) for t in answer.types], strict=True))
    have_types = {f.name: TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    problems = []
    if want_types != have_types:
        problems.append(f"types: spark {have_types} sql {want_types}")
    have_cols, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    want_cols, want = _rows(answer.columns, answer.fetchall())
    if have_cols != want_cols:
        return [*problems, f"columns: {have_cols} / {want_cols}"]
    if len(have) != len(want):
        return [*problems, f"rows: spark {len(have)} sql {len(want)}"]
    exact = sum(a != b for a, b in zip(have, want, strict=True))
    if exact:
        bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
        problems.append(f"{exact} of {len(have)} rows differ, first: {bad[0]}")
    return problems
