"""Run a query and its SQL twin and compare their rows as the driver does."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, (int, decimal.Decimal)):
        return f"n:{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f:{value!r}"
    if isinstance(value, (dt.datetime, dt.date)):
        return f"t:{value.isoformat()}"
    return f"s:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, folder) -> str | None:
    """None when equal, otherwise what differs."""
    df = query(spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows != {len(want)}; e.g. {sorted(set(got) ^ set(want))[:3]}"
    if got != want:
        return f"{name}: values; got {sorted(set(got) - set(want))[:3]} want {sorted(set(want) - set(got))[:3]}"
    return f"ok {name}: empty result" if not got else None
