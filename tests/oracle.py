"""Run a registered query and its SQL oracle on the same small tables."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    return value


def compare(spark, name: str, query, sql: str, sf: str = SF) -> int:
    """Assert equal columns and rows, in any order; the number of rows."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names, expected = [c[0] for c in found.description], found.fetchall()
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), name
    order = sorted(names)
    mine = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in expected), key=repr)
    assert mine == theirs, name
    return len(mine)
