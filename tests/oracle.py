"""Comparison of a query with its SQL in DuckDB, without regard to order."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def tables(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, list | np.ndarray):
        return [_plain(v) for v in value]
    if value is None or pd.isna(value):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    return float(value) if isinstance(value, int | float | np.number) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([_plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False))


def assert_same(found, con, sql):
    assert rows(found.toPandas()) == rows(con.sql(sql).df())
