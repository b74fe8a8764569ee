"""Runs a query beside its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def views(con, sf):
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE OR REPLACE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    con = duckdb.connect()
    views(con, sf)
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    return ours, theirs
