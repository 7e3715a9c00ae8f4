"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def same_rows(spark, query, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs
