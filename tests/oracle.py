"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


def compare(df, con, sql):
    answer = con.execute(sql)
    expected = rows([d[0] for d in answer.description], answer.fetchall())
    assert rows(df.columns, df.collect()) == expected
