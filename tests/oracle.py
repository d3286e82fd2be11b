"""Runs SQL on the driver's tables with DuckDB and compares results without order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con.sql(sql).df()


def canonical(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).values.tolist()))
