"""Query results against SQL, without regard to order."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cell(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if v is None or v != v:
        return "None"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


def agree(spark_df, con, sql):
    mine, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
