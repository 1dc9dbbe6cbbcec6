"""Compare a Spark result with the SQL run by DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        raise AssertionError("decimal left in the output")
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of_sql(con, text: str) -> tuple[list[str], Counter]:
    result = con.execute(text)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    return names, rows


def differences(df, con, text: str) -> str | None:
    spark_names, spark_rows = rows_of_spark(df)
    sql_names, sql_rows = rows_of_sql(con, text)
    if spark_names != sql_names:
        return f"columns {spark_names} against {sql_names}"
    if spark_rows != sql_rows:
        extra, lost = spark_rows - sql_rows, sql_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} rows against {sum(sql_rows.values())}; only in Spark "
            f"{list(extra)[:3]}, only in SQL {list(lost)[:3]} of columns {spark_names}"
        )
    return None
