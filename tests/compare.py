"""Compare a Spark result with DuckDB on the same Parquet tables, as multisets of rows."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows)


def spark_rows(df: DataFrame):
    return _rows(df.columns, df.collect())


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(con, sql: str, df: DataFrame) -> str | None:
    """None when equal, else what differs."""
    (got_names, got), (want_names, want) = spark_rows(df), sql_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (f"{sum(got.values())} rows against {sum(want.values())}; "
                f"extra {list(extra)[:2]}; missing {list(missing)[:2]}")
    return None
