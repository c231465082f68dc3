"""Spark results against DuckDB, as sets of rows with their column names."""
from __future__ import annotations

import collections
import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    """Empty when both sides agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == want:
        return ""
    more, less = got - want, want - got
    return (f"{sum(got.values())} rows and {sum(want.values())}; only Spark {sum(more.values())}: {str(list(more)[:2])[:700]}; "
            f"only SQL {sum(less.values())}: {str(list(less)[:2])[:700]}")
