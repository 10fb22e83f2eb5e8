"""Runs a named query in Spark and its twin in DuckDB and compares every value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda t: tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (v is None, "f", v) for v in t))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    duck_rows = cur.fetchall()
    spark_rows = [tuple(x) for x in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(duck_rows) != len(spark_rows):
        return f"{len(spark_rows)} rows against {len(duck_rows)}"
    a, b = _rows(spark_df.columns, spark_rows), _rows(names, duck_rows)
    bad = [(x, y) for x, y in zip(a, b) if not all(_same(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
