"""Compare a registered query with its SQL on DuckDB: columns, row count, values in any order."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(repr(v)))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql: str) -> str | None:
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    sql_cols, sql_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if spark_cols != sql_cols:
        return f"columns {spark_cols} vs {sql_cols}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}; spark {spark_rows[:2]} sql {sql_rows[:2]}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(spark_rows)} differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    types = [(type(x), type(y)) for a, b in zip(spark_rows[:50], sql_rows[:50]) for x, y in zip(a, b) if x is not None and y is not None and type(x) is not type(y)]
    return f"types differ {types[0]}" if types else None
