"""Compares a query with its SQL on DuckDB over the same tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 9)
    return int(value) if hasattr(value, "__index__") and not isinstance(value, bool) else value


def rows(frame):
    columns = sorted(frame.columns)
    return Counter(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


def assert_same(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, f"only here {list((a - b).items())[:3]}, only in SQL {list((b - a).items())[:3]}"


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
