"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def differences(df, db, sql: str) -> str:
    """Empty if the result of a Spark query equals that of the SQL."""
    found = db.sql(sql)
    if sorted(found.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
