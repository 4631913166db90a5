"""Compare a Spark result with DuckDB, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql) -> list[str]:
    relation = con.sql(sql)
    out = []
    if sorted(spark_df.columns) != sorted(relation.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"]
    ours = rows_of(spark_df.columns, spark_df.collect())
    theirs = rows_of(relation.columns, relation.fetchall())
    if ours != theirs:
        out.append(f"{sum(ours.values())} rows, expected {sum(theirs.values())}")
        out += [f"  only ours:   {r}" for r in list((ours - theirs))[:3]]
        out += [f"  only theirs: {r}" for r in list((theirs - ours))[:3]]
    return out
