"""Compares a query with its SQL twin: columns by name, rows as bags."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(canon(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same bag of rows."""
    rel = con.sql(sql)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{sum(a[1].values())} and {sum(b[1].values())} rows; only ours {list((a[1] - b[1]).items())[:3]}; only SQL's {list((b[1] - a[1]).items())[:3]}"
    return "" if sum(a[1].values()) else "both empty"
