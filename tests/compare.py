"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

import math
import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float | np.floating) and math.isnan(value)) or value is getattr(__import__("pandas"), "NA", None):
        return "null"
    if isinstance(value, list | np.ndarray):
        return str([plain(v) for v in value])
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    if isinstance(value, int | float | np.integer | np.floating):
        return repr(float(value) + 0.0)
    return str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))
