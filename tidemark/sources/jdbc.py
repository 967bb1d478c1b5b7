"""The hot tier in a database that Spark reaches over JDBC."""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tiers import FEW_KEYS, few_keys

#: Rows of a hot table that one task reads.
ROWS_PER_TASK = 1_000_000

#: Column of a staging table: rows of the key when it was staged.
STAGED = "staged_rows"


class JdbcHot:
    """Options of one database; credentials come from the caller, never from here.

    Scans run on the executors, so the database must be reachable from all of them.
    """

    def __init__(self, spark: SparkSession, url: str, driver: str, fetch_size: int = 10_000,
                 **properties: str):
        self.spark, self.url, self.driver = spark, url, driver
        self.properties = properties
        self.options = {"url": url, "driver": driver, "fetchsize": str(fetch_size),
                        "preferTimestampNTZ": "true", **properties}

    # Reading

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, dbtable=name).load()

    def query(self, sql: str) -> DataFrame:
        """A subquery, run by the database."""
        return self.table(f"({sql}) subquery")

    def parallel(self, name: str, column: str, partitions: int) -> DataFrame:
        """The table in key ranges of equal width, read side by side; the database finds the ends.

        Ranges suit an evenly spread key; :meth:`balanced` suits any.
        """
        c = _name(column)
        low, high = self.query(f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {name}").first()
        if low is None:
            return self.table(name)
        return self.spark.read.format("jdbc").options(
            **self.options, dbtable=name, partitionColumn=column, lowerBound=_bound(low, math.floor),
            upperBound=_bound(high, math.ceil), numPartitions=str(partitions)).load()

    def balanced(self, name: str, column: str, partitions: int) -> DataFrame:
        """The table in key ranges of about equally many rows. The ends come from a sketch of the key's
        quantiles, for which the key alone is read first, side by side. Choose a key whose values
        repeat little: the rows of one value stay together."""
        keys = self.parallel(name, column, partitions).select(column)
        return self.by_predicates(name, split_conditions(
            _name(column), split_points(keys, column, partitions)))

    def scan(self, name: str, key: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """The table, side by side in ranges of equal depth if it has more than ``rows_per_task`` rows and
        ``key`` is a number, date or timestamp; the database counts the rows."""
        if key is None:
            return self.table(name)
        kind = dict(self.table(name).dtypes).get(key, "string")
        if kind in ("string", "boolean", "binary"):
            return self.table(name)
        rows = self.query(f"SELECT COUNT(*) AS n FROM {name}").first()[0]
        return self.balanced(name, key, -(-rows // rows_per_task)) if rows > rows_per_task else self.table(name)

    def matching(self, name: str, rows: DataFrame, on: Sequence[str], staging: str,
                 limit: int = FEW_KEYS) -> DataFrame:
        """The rows of a table whose key occurs in ``rows``, picked by the database from staged keys;
        the whole table if there are more than ``limit`` keys."""
        keys = few_keys(rows, on, limit)
        if keys is None:
            return self.table(name)
        self.write(self.spark.createDataFrame(keys, rows.select(*on).schema), staging, "overwrite")
        match = " AND ".join(f"s.{_name(k)} = t.{_name(k)}" for k in on)
        return self.query(f"SELECT t.* FROM {name} t WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {match})")

    def by_predicates(self, name: str, predicates: Sequence[str]) -> DataFrame:
        """One task per condition; the conditions must cover the table without overlap."""
        return self.spark.read.jdbc(
            self.url, name, predicates=list(predicates),
            properties={k: v for k, v in self.options.items() if k != "url"})

    def attach(self, catalog: str) -> None:
        """Make every table readable as ``catalog.schema.table``."""
        prefix = f"spark.sql.catalog.{catalog}"
        self.spark.conf.set(
            prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for key, value in self.options.items():
            self.spark.conf.set(f"{prefix}.{key}", value)

    def columns(self, table: str, schema: str = "public") -> DataFrame:
        """Ordered ``(column_name, data_type)`` of a table, from the information schema."""
        text = "SELECT column_name, data_type, ordinal_position FROM information_schema.columns"
        return (
            self.query(text + f" WHERE table_schema = '{_plain(schema)}'"
                              f" AND table_name = '{_plain(table)}'")
            .orderBy("ordinal_position").select("column_name", "data_type")
        )

    def tables(self, schema: str = "public") -> DataFrame:
        return self.query("SELECT table_name FROM information_schema.tables "
                          f"WHERE table_schema = '{_plain(schema)}'")

    # Writing

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.format("jdbc").options(**self.options, dbtable=table).mode(mode).save()

    def stage_keys(self, rows: DataFrame, keys: Sequence[str], staging: str) -> None:
        """Write the distinct keys from the executors, keeping their types, and how many rows each
        has."""
        self.write(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(STAGED)), staging, "overwrite")

    def delete_statement(self, table: str, staging: str, keys: Sequence[str]) -> str:
        match = " AND ".join(f"s.{_name(k)} = {table}.{_name(k)}" for k in keys)
        return f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {match})"

    def changed_statement(self, table: str, staging: str, keys: Sequence[str]) -> str:
        """Staged keys that by now have another number of rows than were staged."""
        match = " AND ".join(f"s.{_name(k)} = {table}.{_name(k)}" for k in keys)
        return (f"SELECT 1 FROM {staging} s WHERE s.{_name(STAGED)} <> "
                f"(SELECT COUNT(*) FROM {table} WHERE {match})")

    def closed_parents(self, parent: str, child: str, on: Sequence[tuple[str, str]], ts: str,
                       last: datetime, until: datetime) -> DataFrame:
        """Parent rows whose latest child time lies in ``(last, until]``, found by the database:
        only those travel. Bounds are in the zone of the column."""
        at = _name(ts)
        bound = "CAST('{}' AS TIMESTAMP)".format
        low, high = bound(last.isoformat(sep=" ")), bound(until.isoformat(sep=" "))
        keys = ", ".join(_name(c) for _, c in on)
        match = " AND ".join(f"p.{_name(p)} = c.{_name(c)}" for p, c in on)
        return self.query(
            f"SELECT p.* FROM {parent} p JOIN (SELECT {keys} FROM {child} WHERE {at} > {low} "
            f"GROUP BY {keys} HAVING MAX({at}) > {low} AND MAX({at}) <= {high}) c ON {match}")

    @contextmanager
    def transaction(self):
        """A connection from the driver; committed at the end, rolled back on any error."""
        session = JdbcTransaction(self)
        try:
            yield session
            session.connection.commit()
        except BaseException:
            session.connection.rollback()
            raise
        finally:
            session.connection.close()


class JdbcTransaction:
    """Statements with positional arguments, one transaction."""

    def __init__(self, hot: JdbcHot):
        jvm = hot.spark.sparkContext._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(hot.driver)
        properties = jvm.java.util.Properties()
        for key, value in hot.properties.items():
            properties.setProperty(key, value)
        self.connection = jvm.java.sql.DriverManager.getConnection(hot.url, properties)
        self.connection.setAutoCommit(False)

    def execute(self, sql: str, args: Sequence = ()) -> tuple[str, int]:
        """``("select", 1 if there is any row, else 0)`` or ``("write", affected)``."""
        statement = self.connection.prepareStatement(sql)
        try:
            expected = statement.getParameterMetaData().getParameterCount()
            if expected != len(args):
                raise ValueError(f"{expected} parameters, {len(args)} arguments: {sql}")
            for i, value in enumerate(args, 1):
                statement.setObject(i, value)
            if not statement.execute():
                return "write", statement.getUpdateCount()
            return "select", int(statement.getResultSet().next())
        finally:
            statement.close()


def _plain(text: str) -> str:
    return text.replace("'", "''")


def _name(column: str) -> str:
    """A column name exactly as the database reported it."""
    return '"' + column.replace('"', '""') + '"'


def split_points(df: DataFrame, column: str, splits: int) -> list:
    """At most ``splits`` - 1 values that cut the rows into parts of about equal size: quantiles of a
    sketch whose error is a hundredth of a part. For numbers, dates and timestamps."""
    shares = [i / splits for i in range(1, splits)]
    found = df.agg(F.percentile_approx(column, shares, 100 * splits)).first()[0] if shares else None
    return sorted(set(found or []))


def split_conditions(column: str, points: Sequence) -> list[str]:
    """Conditions, in SQL, that cover all rows once: ranges between the points, nulls in the first."""
    if not points:
        return ["1 = 1"]
    text = [_sql_value(p) for p in points]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(text, text[1:])]
    return [f"({column} < {text[0]} OR {column} IS NULL)", *between, f"{column} >= {text[-1]}"]


def _bound(value, whole) -> str:
    """An end of a range as text; Spark takes whole numbers, dates and timestamps."""
    return str(whole(value)) if isinstance(value, (float, Decimal)) else str(value)


def _sql_value(value) -> str:
    if isinstance(value, datetime):
        return f"CAST('{value.isoformat(sep=' ')}' AS TIMESTAMP)"
    if isinstance(value, date):
        return f"CAST('{value.isoformat()}' AS DATE)"
    return repr(value) if isinstance(value, (int, float)) else str(value)
