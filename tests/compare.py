"""Rows of a query and of its SQL in a form that can be compared."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if x != x else f"{round(float(x), 6):.6f}"
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(os.path.join(sf_dir, f"{t}.parquet")):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    columns = [c[0] for c in done.description]
    return sorted(columns), rows_of(columns, done.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
