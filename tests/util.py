"""Comparison of results with DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{path}')")
    return db


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """The rows with columns by name, as sorted text; missing values are alike, floats rounded to 9 places."""
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
                cells.append("∅")
            elif isinstance(v, float):
                cells.append(f"{round(v, 9) + 0.0:.9f}")
            else:
                cells.append(f"{v:.9f}" if isinstance(v, int) and not isinstance(v, bool) else str(v))
        out.append(tuple(cells))
    return sorted(out)
