"""The cold tier as catalogue tables.

:class:`LakeCold` works on a lake table format (Iceberg: its jar and catalogue settings come
with the session). The plain functions work on Spark's own Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import table_schema
from tidemark.operators.tiers import BATCH
from tidemark.schemas import TPCC, tpcc_schema
from tidemark.session import in_parallel
from tidemark.sources.jdbc import JdbcHot


class LakeCold:
    """Cold tables ``<namespace>.<table>`` with one partition per batch."""

    def __init__(self, spark: SparkSession, namespace: str, provider: str = "iceberg"):
        self.spark, self.namespace, self.provider = spark, namespace, provider

    def name(self, table: str) -> str:
        return f"{self.namespace}.{table.replace('.', '_')}"

    def create_namespace(self) -> None:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {self.namespace}")

    def create(self, table: str, columns: list[tuple[str, str]], location: str | None = None):
        """An empty table from ``(column, source type)`` pairs."""
        schema = table_schema(columns).add(BATCH, T.LongType())
        self._create(table, self.spark.createDataFrame([], schema), location)

    def write_cold(self, table: str, df: DataFrame, batch: int) -> None:
        """Write one batch in one commit; a retry replaces it."""
        rows = df.withColumn(BATCH, F.lit(batch).cast("long"))
        if self.spark.catalog.tableExists(self.name(table)):
            rows.writeTo(self.name(table)).overwrite(F.col(BATCH) == F.lit(batch).cast("long"))
        else:
            self._create(table, rows, None)

    def append(self, table: str, df: DataFrame) -> None:
        df.writeTo(self.name(table)).append()

    def read(self, table: str, snapshot: int | None = None) -> DataFrame:
        """The latest version, or a snapshot by its id."""
        if snapshot is None:
            return self.spark.table(self.name(table))
        return self.spark.sql(f"SELECT * FROM {self.name(table)} VERSION AS OF {int(snapshot)}")

    def cold_batch(self, table: str, batch: int, schema: T.StructType) -> DataFrame:
        return self.read(table).where(F.col(BATCH) == batch).select(*schema.fieldNames())

    def snapshots(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name(table)}.snapshots")

    def add_column(self, table: str, column: str, ddl_type: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({column} {ddl_type})")

    def merge(self, table: str, changes: DataFrame, keys: list[str]) -> None:
        """Keyed upsert as one statement."""
        changes.createOrReplaceTempView("_tidemark_changes")
        match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        self.spark.sql(f"MERGE INTO {self.name(table)} t USING _tidemark_changes s ON {match} "
                       "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")

    def _create(self, table: str, df: DataFrame, location: str | None) -> None:
        writer = df.writeTo(self.name(table)).using(self.provider)
        if self.provider == "iceberg":
            writer = writer.partitionedBy(F.col(BATCH))
        if location is not None:
            writer = writer.tableProperty("location", location)
        writer.create()


def create_table(spark: SparkSession, table: str, schema: T.StructType, location: str,
                 partition_by: list[str] | None = None) -> None:
    """An empty Parquet table at a location, unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{parts} "
              f"LOCATION '{location}'")


def name_table(spark: SparkSession, table: str, path: str) -> None:
    """Give Parquet files that exist a name in the catalogue; nothing is copied, and dropping the name
    leaves the files."""
    spark.catalog.createTable(table, path=path, source="parquet")


def add_column(spark: SparkSession, table: str, column: str, ddl_type: str) -> None:
    """A new last column; rows written earlier read NULL. Files stay as they are."""
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (`{column}` {ddl_type})")


def create_from_source(spark: SparkSession, table: str, columns: list[tuple[str, str]],
                       location: str) -> T.StructType:
    """An empty Parquet table from ``(column, source type)`` pairs; dots in names become ``_``."""
    schema = table_schema(columns)
    create_table(spark, table.replace(".", "_"), schema, location)
    return schema


def create_all(spark: SparkSession, hot: JdbcHot, location: str, schema: str = "public",
               database: str | None = None) -> dict[str, T.StructType]:
    """An empty cold table for every table of a database, from its catalogue; by cold name.

    The catalogue is small (a row per column) and read once per table."""
    made = {}
    for table in sorted(r[0] for r in hot.tables(schema).collect()):
        columns = [(r[0], r[1]) for r in hot.columns(table, schema).collect()]
        name = f"{database}.{table}" if database else table
        made[name] = table_schema(columns)
        create_table(spark, name, made[name], f"{location.rstrip('/')}/{table}")
    return made


def create_tpcc(spark: SparkSession, location: str, names: dict[str, str] | None = None,
                wide: bool = False) -> dict[str, str]:
    """The nine order-processing tables with their declared types; ``layout -> table name``."""
    names = names or {t: t for t in TPCC}
    for layout, table in names.items():
        create_table(spark, table, tpcc_schema(layout, wide), f"{location.rstrip('/')}/{layout}")
    return names


def append(df: DataFrame, table: str) -> None:
    """Append by column name to a Parquet table, from as many tasks as the data has."""
    columns = df.sparkSession.table(table).columns
    df.select(*columns).write.insertInto(table)


def bulk_load(spark: SparkSession, source: str, names: dict[str, str], target: str) -> dict:
    """Load ``<source>/<name>.parquet`` into catalogue tables under new names; ``new name -> path``.
    A name may have a database before a dot; a table that exists is loaded anew."""
    paths = {new: f"{target.rstrip('/')}/{new.replace('.', '/')}" for new in names.values()}

    def load(old: str, new: str) -> None:
        df = spark.read.parquet(f"{source}/{old}.parquet")
        df.write.mode("overwrite").parquet(paths[new])
        create_table(spark, new, df.schema, paths[new])
        spark.catalog.refreshTable(new)
    in_parallel(spark, [lambda o=old, n=new: load(o, n) for old, new in names.items()])
    return paths
