"""Hold a query's rows against those of its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return ""
        if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and getattr(x, "shape", None) == ():
            return f"{float(x):.5f}"
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
            return str([plain(y) for y in x])
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


def compare(spark_df, sql: str, con) -> str:
    """An empty string if the rows are the same, else what differs."""
    want = con.execute(sql).df()
    got = spark_df.toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    more, less = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows; only in Spark {len(more)}: {list(more)[:2]}; only in SQL {len(less)}: {list(less)[:2]}"
