"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(names: list[str], values) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if hasattr(x, "as_tuple") else x
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


def compare(con, df, sql: str) -> str:
    """Empty where both give the same columns and rows, else what differs first."""
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows(df.columns, df.collect()), rows(names, found.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(mine, theirs) if a != b), "")
