"""Order-insensitive comparison of a Spark result with SQL on the same parquet files."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def _value(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(map(_value, x))
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, str):
        return x
    return round(float(x), 6) + 0.0 if isinstance(x, int | float) or type(x).__name__ == "Decimal" else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(_value, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)
