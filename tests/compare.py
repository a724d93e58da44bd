"""Comparison of a query with its DuckDB equivalent, as unordered rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value if value is None or isinstance(value, bool) else str(value)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(c) for c in names]
    got = Counter(tuple(plain(row[i]) for i in order) for row in df.collect())
    want = Counter(tuple(map(plain, row)) for row in expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
