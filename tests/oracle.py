"""Side-by-side comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def differences(con, df, sql: str, scratch: str) -> tuple[list[str], int, int]:
    """(columns that only one side has, rows only the SQL has, rows only df has)."""
    df.write.mode("overwrite").parquet(scratch)
    con.sql(f"CREATE OR REPLACE TABLE want AS {sql}")
    want = con.sql("SELECT * FROM want").columns
    odd = sorted(set(want) ^ set(df.columns))
    if odd:
        return odd, -1, -1
    names = ", ".join(f'"{n}"' for n in want)
    files = glob.glob(f"{scratch}/*.parquet")
    con.sql(f"CREATE OR REPLACE TABLE got AS SELECT {names} FROM read_parquet({files})")
    count = lambda a, b: con.sql(f"SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b})").fetchall()[0][0]
    return [], count("want", "got"), count("got", "want")
