"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows."""
    (a_names, a), (b_names, b) = spark_rows(df), sql_rows(sql, sf_dir)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a == b:
        return ""
    only_a, only_b = a - b, b - a
    return f"{a.total()} and {b.total()} rows; only in Spark {only_a.total()}: {sorted(map(str, only_a))[:3]}; only in SQL {only_b.total()}: {sorted(map(str, only_b))[:3]}"
