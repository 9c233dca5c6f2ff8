"""Runs a query and its SQL side by side on the smallest tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def tables(directory: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    """Order-free rows with columns by name and numbers in one form."""
    names = sorted(frame.columns)

    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 9))
        return str(v)

    frame = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))
