"""Order-free comparison of a Spark result with a DuckDB result."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NULL = "<null>"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value as text: numbers of any type alike, nulls apart from empty strings, lists item by item."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or pd.isna(v):
        return NULL
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)) or type(v).__name__ == "Decimal":
        return str(float(v) + 0.0)  # -0.0 is 0.0
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))
