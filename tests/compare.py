"""Spark's rows against DuckDB's, whatever their order."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sql, folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.sql(sql)
    return rows(got.columns, got.fetchall())


def spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
