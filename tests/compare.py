"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and df[c].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[c] = df[c].map(str)
    exact = [c for c in df.columns if df[c].dtype.kind != "f"]
    return df.sort_values(exact + [c for c in df.columns if c not in exact], ignore_index=True)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame, tolerance: float = 1e-9) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {set(ours.columns) ^ set(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} against {len(theirs)}"]
    a, b = _sorted(ours), _sorted(theirs)
    found = []
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype(float), b[c].astype(float)
            bad = ~np.isclose(x, y, atol=tolerance, rtol=1e-9, equal_nan=True)
        else:
            x, y = a[c].astype(object), b[c].astype(object)
            bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            found.append(f"{c}: {int(bad.sum())} rows, first {a[c][i]!r} against {b[c][i]!r}")
    return found


def check(spark, con, sf_dir: str, name: str, query, statement: str) -> tuple[list[str], dict]:
    t0 = time.time()
    ours = query(spark, sf_dir).toPandas()
    t1 = time.time()
    theirs = con.execute(statement).df()
    return differences(ours, theirs), {
        "rows": len(ours), "spark": round(t1 - t0, 2), "sql": round(time.time() - t1, 2)
    }
