"""Runs a query and its SQL and compares the rows, as the driver does."""

import glob
import math
import os

import duckdb


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    theirs = sorted(tuple(_plain(row[names.index(c)]) for c in sorted(names)) for row in cur.fetchall())
    assert cols == sorted(names)
    assert mine == theirs
