"""Runs a registered query and its SQL over the same tables and compares them as multisets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return cell(x.asDict())
    return str(x) if x is not None and not isinstance(x, (int, bool, str)) else x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    told = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(told.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(told.columns, told.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
