"""Compare a query with its SQL on the same tables."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


def compare(query, sql, spark, sf):
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = connect(sf).sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in found.fetchall())
    assert got == want
    return len(got)
