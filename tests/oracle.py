"""Compares a query with its SQL in DuckDB, without regard to row order."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, np.ndarray)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (float, np.floating)):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (bool, np.bool_)):
        return int(x)
    return int(x) if isinstance(x, np.integer) else float(f"{x:.9g}") if type(x).__name__ == "Decimal" else x


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    return a == b


def check(spark, query, sql, path=SMALL):
    got, want = query(spark, path).toPandas(), connect(path).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(close, x, y))]
    assert not bad or a == b, bad[:3]


assert os.path.isdir(SMALL)
