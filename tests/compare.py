"""Rows of a Spark query against rows of its SQL in DuckDB, without regard to order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
        return None
    kind = type(x).__name__
    if "bool" in kind:
        return bool(x)
    if "int" in kind:
        return int(x)
    if "float" in kind or kind == "Decimal":
        return round(float(x), 9)
    return str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False)), key=str)
