"""Runs a registered query and its SQL text side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, build, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of Spark rows, and what differs (nothing when both agree)."""
    df = build(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = _rows(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        problems.append(f"columns {sorted(set(df.columns) ^ set(rel.columns))}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    alike = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    for name, kind in kinds.items():
        if name in types and alike.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} / {types[name]}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    if mine != theirs:
        ours, other = set(mine), set(theirs)
        extra = [r for r in mine if r not in other][:2]
        missing = [r for r in theirs if r not in ours][:2]
        problems.append(f"values: only spark {extra}, only sql {missing}")
    return len(mine), problems
