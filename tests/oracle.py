"""Run a query in Spark and its SQL in DuckDB on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def differences(spark, name: str, sf_dir: str, queries: dict, sql: dict, show: int = 5) -> list[str]:
    """Empty if the rows agree."""
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = connect(sf_dir).execute(sql[name])
    theirs_cols = [c[0] for c in rel.description]
    if sorted(theirs_cols) != cols:
        return [f"{name}: columns {cols} and {sorted(theirs_cols)}"]
    place = [theirs_cols.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in place) for r in rel.fetchall())
    if ours == theirs:
        return []
    a, b = list((ours - theirs).elements()), list((theirs - ours).elements())
    return [f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows; {len(a)} only ours, {len(b)} only theirs", *(f"  ours {x}" for x in sorted(a, key=str)[:show]), *(f"  sql  {x}" for x in sorted(b, key=str)[:show])]
