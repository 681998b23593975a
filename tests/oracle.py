"""Compare a query with its SQL."""

import os
from numbers import Number

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    """Text of a value; a number's does not depend on its type."""
    if pd.isna(value):
        return "none"
    return repr(float(value)) if isinstance(value, Number) and not isinstance(value, bool) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False))
