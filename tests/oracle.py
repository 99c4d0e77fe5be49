"""Run a registered query and its SQL, and compare them as multisets of rows."""

import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connection(sf_dir):
    con = duckdb.connect(config={"memory_limit": "8GB", "max_temp_directory_size": "2GB"})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
