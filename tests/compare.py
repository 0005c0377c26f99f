"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb

# How a Spark type shows up in the checking engine.
_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs in names, types or rows; empty if nothing does."""
    names = sorted(df.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return [f"columns {names} and {sorted(relation.columns)}"]
    have = {name: _TYPES.get(kind, kind) for name, kind in df.dtypes}
    want = {n: str(t) for n, t in zip(relation.columns, relation.types, strict=True)}
    out = [f"type of {n}: {have[n]} and {want[n]}" for n in names if have[n] != want[n]]
    order = [relation.columns.index(n) for n in names]
    expected = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=repr)
    actual = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    if len(actual) != len(expected):
        out.append(f"rows: {len(actual)} and {len(expected)}")
    for left, right in zip(actual, expected, strict=False):
        if not all(_same(a, b) for a, b in zip(left, right, strict=True)):
            out.append(f"{left}\n  and {right}")
            break
    return out


def _same(a, b) -> bool:
    if isinstance(a, decimal.Decimal) or isinstance(b, decimal.Decimal):
        return False
    if isinstance(a, dt.datetime) or isinstance(b, dt.datetime):
        return type(a) is type(b) and a == b
    return a == b
