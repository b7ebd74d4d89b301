"""Rows of Spark and DuckDB brought to one form."""

from __future__ import annotations

import decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def connect(data: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(r.asDict(True)[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(connection, sql: str):
    r = connection.execute(sql)
    names = [x[0] for x in r.description]
    columns = sorted(names)
    return columns, sorted((tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
