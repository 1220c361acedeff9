"""Spark results beside DuckDB's on the same tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def oracle(sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con.execute(sql).df()


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return str(list(x))
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.6f}".rstrip("0").rstrip(".")
    return str(x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
