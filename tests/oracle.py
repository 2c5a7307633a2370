"""Comparison of a query's rows with those of its SQL, without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connection(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(c, sql):
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), rows_of(names, cursor.fetchall())
