"""Rows of a query and of its SQL in a common form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def sql_rows(sf, sql):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
