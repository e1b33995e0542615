"""A local form of the driver's check: a query's rows against its SQL in DuckDB, with their types."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

from millrace.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{f'{path}/*.parquet' if path.is_dir() else path}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What is not alike: column names, types, the count of rows, or rows."""
    cursor = con.execute(sql)
    names, kinds, want = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description], cursor.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)}, in SQL {sorted(names)}"]
    for name, kind in zip(names, kinds, strict=True):
        mine = dict(df.dtypes)[name]
        if KINDS.get(mine, mine.upper().replace("DECIMAL(", "DECIMAL(").replace(",", ", ") if mine.startswith("decimal") else kind) != kind:
            out.append(f"{name} is {mine}, in SQL {kind}")
    rows = sorted((repr([plain(r[n]) for n in names]) for r in df.collect()))
    want = sorted(repr([plain(x) for x in r]) for r in want)
    if len(rows) != len(want):
        out.append(f"{len(rows)} rows, in SQL {len(want)}")
    elif rows != want:
        a, b = next((a, b) for a, b in zip(rows, want, strict=True) if a != b)
        out.append(f"row {a[:200]}, in SQL {b[:200]}")
    return out
