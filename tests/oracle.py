"""Runs a query and its SQL on the same tables and compares their rows, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or x is pd.NA or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(frame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted((tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


def matches(spark, query, sql: str, sf: str) -> bool:
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    got, want = query(spark, sf).toPandas(), c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got) == rows(want)
