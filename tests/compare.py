"""A query's rows against DuckDB's, in no order, columns by name."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr)


def oracle(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    names = ", ".join(f'"{c}"' for c in sorted(con.sql(sql).columns))
    return sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
