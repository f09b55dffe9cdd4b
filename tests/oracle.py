"""Compares queries with their SQL twins, as the driver does: rows and values, whatever the order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(frame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def differences(spark_frame, sql_frame) -> str:
    """Empty where both hold the same rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, such as {wrong[0]}" if wrong else ""
