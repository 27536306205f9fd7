"""Spark rows against DuckDB rows, value by value, whatever the order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, int) else float(v) if type(v).__name__ == "Decimal" else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def assert_same(spark_df, con, sql):
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns)
    got, want = rows(spark_df.columns, spark_df.collect()), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
    return len(got)
