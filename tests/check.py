"""Comparison of a query's rows with those of its SQL in DuckDB, regardless of order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(round(float(v), 9)) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(zip(*(map(one, df[c]) for c in df), strict=True))


def same(query, sql: str, spark, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
