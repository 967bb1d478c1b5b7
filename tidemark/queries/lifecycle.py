"""Cold tables: create, load, append, evolve, travel, partition, prune."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import iso_text
from tidemark.operators.tiers import BATCH
from tidemark.functions.types import SOURCE_TYPES, spark_type_column, table_schema
from tidemark.queries.staging import (
    ANALYTIC_TABLES,
    MOVED_SQL,
    TPCC_SQL,
    analytic_store,
    given,
    money,
    staged,
    tpcc_frames,
    tpcc_store,
)
from tidemark.schemas import CH_NAMES, TPCC, conform, schema_drift, tpcc_schema
from tidemark.session import in_parallel, scratch
from tidemark.sources.files import file_stats, read_paths
from tidemark.sources.lake import (
    add_column,
    append,
    bulk_load,
    create_from_source,
    create_table,
    create_tpcc,
    name_table,
)

# Source types of the orders columns, as its database declares them.
ORDERS_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "character varying"),
    ("o_totalprice", "numeric(15,2)"), ("o_orderdate", "timestamp without time zone"),
    ("o_orderpriority", "TEXT"),
]


def _new_table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


def _released(spark: SparkSession, name: str) -> DataFrame:
    """The table as a frame that has been looked up; the name is given up."""
    df = spark.table(name)
    df.schema  # noqa: B018 - looks the table up
    spark.sql(f"DROP TABLE {name}")
    return df


def cold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue table read by name: the files are there, the name is new."""
    name = _new_table("cold_events")
    name_table(spark, name, f"{sf_dir}/events.parquet")
    return _released(spark, name).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), money("value", "total"))


def catalog_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added to a catalogue table between two appends: earlier rows read NULL."""
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    name = _new_table("growing_orders")
    first = orders.drop("o_orderpriority")
    create_table(spark, name, first.schema, scratch(spark, name))
    append(first.where("o_orderstatus = 'F'"), name)
    add_column(spark, name, "o_orderpriority", "STRING")
    append(orders.where("o_orderstatus <> 'F'"), name)
    return _released(spark, name).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


def parquet_paths_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit list of paths: those of the cold batches the commit log names."""
    store = analytic_store(spark, sf_dir)
    batches = [r.batch_id for r in store.snapshots("lineitem").where("moved > 0").collect()]
    base = store.cold_path("lineitem")
    rows = read_paths(spark, [f"{base}/{BATCH}={b}" for b in batches],
                      store.cold("lineitem").schema, base)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                            money("l_extendedprice", "total"))


def cold_filtered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold rows under a condition; ``toArrow()`` turns them into an Arrow table at the edge."""
    cold = analytic_store(spark, sf_dir).cold("orders")
    return cold.where("o_totalprice > 250000 AND o_orderstatus = 'F'").select(
        "o_orderkey", "o_custkey", "o_totalprice")


def cold_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one table, in whatever number of tasks the data has."""
    orders = given(spark, sf_dir, "orders")
    name = _new_table("cold_orders")
    create_table(spark, name, orders.schema, scratch(spark, name))
    append(orders.where("o_orderstatus = 'F'"), name)
    append(orders.where("o_orderstatus <> 'F'"), name)
    return _released(spark, name).select("o_orderkey", "o_orderstatus", "o_totalprice")


def create_from_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose columns come from source types, filled from its source."""
    name = _new_table("public.orders")
    schema = create_from_source(spark, name, ORDERS_COLUMNS, scratch(spark, "mapped"))
    table = name.replace(".", "_")
    append(given(spark, sf_dir, "orders").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), table)
    return _released(spark, table).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("total"),
        F.max(F.typeof("o_totalprice")).alias("price_type"))


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT of a query and of literal rows."""
    name = _new_table("order_log")
    schema = T.StructType.fromDDL("order_id BIGINT, customer_id BIGINT, order_status STRING, "
                                  "total_amount DECIMAL(15,2), last_updated TIMESTAMP_NTZ")
    create_table(spark, name, schema, scratch(spark, name))
    given(spark, sf_dir, "orders").createOrReplaceTempView("order_source")
    spark.sql(f"INSERT INTO {name} SELECT o_orderkey, o_custkey, o_orderstatus, "
              "CAST(o_totalprice AS DECIMAL(15,2)), o_orderdate FROM order_source")
    spark.sql(f"""INSERT INTO {name}
        (order_id, customer_id, order_status, total_amount, last_updated) VALUES
        (-1, 7, 'reserved', 12.50, TIMESTAMP_NTZ '2023-05-17 08:30:00'),
        (-2, 7, 'reserved', 0.75, TIMESTAMP_NTZ '2023-05-18 09:00:00'),
        (-3, 8, 'returned', 640.00, TIMESTAMP_NTZ '2023-06-02 17:45:30')""")
    return _released(spark, name).groupBy("order_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("total"))


def _layout(name: str) -> str:
    """The orders of a policy are laid out as ``oorder``."""
    return "oorder" if name == "orders" else name


def tpcc_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine order-processing tables, created with their declared types and filled; what the
    catalogue says of every column, and the rows. The names are given up again."""
    frames, root = tpcc_frames(spark, sf_dir), scratch(spark, "tpcc-tables")
    layouts = {_layout(n): n for n in frames}
    tables = create_tpcc(spark, root, {t: _new_table(t) for t in layouts})

    def fill(layout: str) -> None:
        append(conform(frames[layouts[layout]], tpcc_schema(layout)), tables[layout])
    in_parallel(spark, [lambda t=t: fill(t) for t in layouts])
    out = None
    for layout, table in tables.items():
        df = spark.table(table)
        columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("type"))
                            for n, t in df.dtypes])
        stored = spark.read.schema(df.schema).parquet(f"{root}/{layout}")
        spark.sql(f"DROP TABLE {table}")
        part = stored.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(layout).alias("table_name"), F.explode(columns).alias("c"), "rows").select(
            "table_name", "c.column_name", "c.type", "rows")
        out = part if out is None else out.unionAll(part)
    return out


def bulk_load_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the catalogue under new names, in a database of their own."""
    database = _new_table("lake")
    spark.sql(f"CREATE DATABASE {database}")
    names = {t: f"{database}.{CH_NAMES[t]}" for t in ANALYTIC_TABLES}
    paths = bulk_load(spark, sf_dir, names, scratch(spark, "bulk"))
    listed = {r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect()}
    out = None
    for name, path in sorted(paths.items()):
        short = name.partition(".")[2]
        part = spark.read.schema(spark.table(name).schema).parquet(path).agg(
            F.count(F.lit(1)).alias("rows")).select(
            F.lit(short).alias("table_name"), F.lit(short in listed).alias("listed"), "rows")
        out = part if out is None else out.unionAll(part)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


def export_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    given(spark, sf_dir, "part").write.parquet(path)
    return spark.read.parquet(path)


def schema_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added between two appends: earlier rows read NULL, nothing is rewritten."""
    def build(store) -> None:
        customer = given(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
        store.load({"customer": customer.where("c_acctbal < 0")})
        store.add_column("customer", "email", "string")
        store.append_cold("customer", customer.where("c_acctbal >= 0").withColumn(
            "email", F.concat(F.lower("c_name"), F.lit("@example.com"))))
    store = staged(spark, sf_dir, "evolution", build)
    return store.read("customer").select("c_custkey", "c_name", "email")


def time_travel_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as of the first of two commits."""
    def build(store) -> None:
        orders = given(spark, sf_dir, "orders")
        early = "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
        store.load({"orders": orders.where(early)})
        store.append_cold("orders", orders.where(f"NOT {early}"))
    store = staged(spark, sf_dir, "travel", build)
    return store.read("orders", as_of=0).select("o_orderkey", "o_orderstatus", "o_totalprice")


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tpcc_store(spark, sf_dir)
    out = None
    for name in ("orders", "order_line", "hhistory"):
        part = store.snapshots(name).select(F.lit(name).alias("relname"), "batch_id", "moved")
        out = part if out is None else out.unionAll(part)
    return out.where("batch_id > 0")


def partitioned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the partition column reads one partition."""
    events = given(spark, sf_dir, "events")
    name = _new_table("events_by_type")
    create_table(spark, name, events.schema, scratch(spark, name), ["event_type"])
    append(events, name)
    return spark.table(name).where("event_type = 'purchase'").select(
        "event_id", "user_id", "value", "event_type")


def file_stats_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold files' rows and ranges, summed up: files are named differently in every run."""
    return file_stats(tpcc_store(spark, sf_dir).cold("order_line"), ["ol_delivery_d"]).agg(
        F.sum("rows").alias("rows"),
        iso_text(F.min("min_ol_delivery_d")).alias("first"),
        iso_text(F.max("max_ol_delivery_d")).alias("last"))


def _clustered_lines(spark: SparkSession, sf_dir: str):
    """Delivered lines in two cold batches, kept together by time and item."""
    def build(store) -> None:
        lines = tpcc_frames(spark, sf_dir, "order_line")["order_line"]
        late = F.col("ol_dist_info") == "R"
        store.load({"order_line": lines.where(F.lit(False))})
        for part in (~late, late):
            store.append_cold("order_line", lines.where(part), cluster=["ol_delivery_d", "ol_i_id"])
    return staged(spark, sf_dir, "clustered", build)


def file_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the clustered lines: Parquet's statistics rule out the files and row groups."""
    low = F.lit("1998-03-01 00:00:00").cast("timestamp_ntz")
    high = F.lit("1998-05-31 00:00:00").cast("timestamp_ntz")
    return _clustered_lines(spark, sf_dir).read("order_line").where(
        F.col("ol_delivery_d").between(low, high)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ol_amount").cast("double").alias("amount"))


def cold_clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few items of the same lines: the other column they are kept together by."""
    return _clustered_lines(spark, sf_dir).read("order_line").where(
        "ol_i_id BETWEEN 10 AND 19").groupBy("ol_i_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ol_amount").cast("double").alias("amount"))


# Every type name a source may declare, some with sizes and in other spellings, and what it becomes.
_DECLARED_TYPES = [*SOURCE_TYPES.items(), ("numeric(12,2)", "decimal(12,2)"),
                   ("DECIMAL(9)", "decimal(9,0)"), ("numeric ( 20 , 5 )", "decimal(20,5)"),
                   ("character varying(255)", "string"), ("char(1)", "string"),
                   ("Timestamp(6) without time zone", "timestamp_ntz"), ("interval", "string")]

# How the source database names the types of the given tables.
_SOURCE_NAMES = {"bigint": "bigint", "int": "integer", "string": "character varying",
                 "double": "double precision", "timestamp_ntz": "timestamp without time zone"}


def _column_counts(df: DataFrame, table: str) -> DataFrame:
    """``table_name, column_name, type, non_null``, one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{n}', '{t}', `{n}`" for n, t in df.dtypes)
    return counts.selectExpr(
        f"'{table}' AS table_name",
        f"stack({len(df.columns)}, {pairs}) AS (column_name, type, non_null)")


def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the given tables with source type, lake type and filled rows."""
    out = None
    for name in (*ANALYTIC_TABLES, "events"):
        part = _column_counts(given(spark, sf_dir, name), name)
        out = part if out is None else out.unionAll(part)
    source = F.create_map(*[F.lit(x) for pair in _SOURCE_NAMES.items() for x in pair])[F.col("type")]
    out = out.select("table_name", "column_name", source.alias("source_type"), "non_null")
    # a catalogue whose columns have every type a source may declare, filled for each nation
    kinds = F.array(*[F.struct(F.lit(f"c{i}").alias("column_name"), F.lit(t).alias("source_type"))
                      for i, (t, _) in enumerate(_DECLARED_TYPES)])
    declared = given(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("non_null")).select(
        F.explode(kinds).alias("c"), "non_null").select(
        F.lit("declared").alias("table_name"), "c.column_name", "c.source_type", "non_null")
    out = out.unionAll(declared)
    return out.select("table_name", "column_name", "source_type",
                      spark_type_column(F.col("source_type")).alias("lake_type"), "non_null")


def schema_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared orders columns against what the given table holds."""
    declared = spark.createDataFrame(
        [("orders", n, t) for n, t in ((f.name, f.dataType.simpleString()) for f in table_schema(
            ORDERS_COLUMNS + [("o_comment", "text")]).fields)],
        "table_name string, column_name string, type string")
    observed = _column_counts(given(spark, sf_dir, "orders").withColumnRenamed(
        "o_orderpriority", "o_priority"), "orders")
    drift = schema_drift(declared, observed)
    return drift.join(observed.select("table_name", "column_name", "non_null"),
                      ["table_name", "column_name"], "left").drop("table_name")


QUERIES = {f.__name__: f for f in (
    cold_scan, parquet_paths_scan, cold_filtered_fetch, cold_append, create_from_mapping,
    insert_values, tpcc_schemas, bulk_load_renamed, export_parquet_roundtrip,
    schema_evolution_read, time_travel_read, snapshot_list, partitioned_read,
    file_stats_manifest, file_pruned_scan, cold_clustered_scan, catalog_add_column, type_mapping)} | {"schema_drift": schema_drift_report}

_TPCC_SOURCES = {"customer": "customer", "district": "nation", "hhistory": "events",
                 "item": "part", "new_order": "orders WHERE o_orderstatus = 'O'",
                 "oorder": "orders", "order_line": "lineitem", "stock": "part",
                 "warehouse": "region"}
_GIVEN_COLUMNS = {
    "region": "r_regionkey integer, r_name character varying",
    "nation": "n_nationkey integer, n_name character varying, n_regionkey integer",
    "supplier": "s_suppkey bigint, s_name character varying, s_nationkey integer, "
                "s_acctbal double precision",
    "customer": "c_custkey bigint, c_name character varying, c_nationkey integer, "
                "c_acctbal double precision, c_mktsegment character varying",
    "part": "p_partkey bigint, p_name character varying, p_brand character varying, "
            "p_type character varying, p_size integer, p_retailprice double precision",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus character varying, "
              "o_totalprice double precision, o_orderdate timestamp without time zone, "
              "o_orderpriority character varying",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, "
                "l_quantity double precision, l_extendedprice double precision, "
                "l_discount double precision, l_tax double precision, "
                "l_returnflag character varying, l_linestatus character varying, "
                "l_shipdate timestamp without time zone",
    "events": "event_id bigint, ts timestamp without time zone, user_id bigint, "
              "event_type character varying, value double precision, props character varying",
}
_LAKE_NAMES = {"bigint": "bigint", "integer": "int", "character varying": "string",
               "double precision": "double", "timestamp without time zone": "timestamp_ntz"}


def _declared(table: str) -> list[str]:
    """``('column', 'type')`` of a layout as its text states them."""
    columns = [c.strip().split(" ", 1) for c in re.split(r",(?![^(]*\))", TPCC[table])]
    return [f"('{n}', '{t.lower()}')" for n, t in columns]


def _type_mapping_sql() -> str:
    parts = []
    for table, columns in _GIVEN_COLUMNS.items():
        for column in columns.split(", "):
            name, source = column.split(" ", 1)
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                         f"'{source}' AS source_type, '{_LAKE_NAMES[source]}' AS lake_type, "
                         f"COUNT({name}) AS non_null FROM {table}")
    for i, (source, lake) in enumerate(_DECLARED_TYPES):
        parts.append(f"SELECT 'declared' AS table_name, 'c{i}' AS column_name, '{source}' AS "
                     f"source_type, '{lake}' AS lake_type, COUNT(*) AS non_null FROM nation")
    return " UNION ALL ".join(parts)


ORACLES = {
    "cold_scan": "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS "
                 "DOUBLE) AS total FROM events GROUP BY event_type",
    "parquet_paths_scan": "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS "
                          "DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem "
                          "WHERE l_orderkey > 100 GROUP BY l_returnflag",
    "cold_filtered_fetch": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE "
                           "o_orderkey > 100 AND o_totalprice > 250000 AND o_orderstatus = 'F'",
    "cold_append": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "create_from_mapping": "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS "
                           "DECIMAL(15,2))) AS DOUBLE) AS total, 'decimal(15,2)' AS price_type "
                           "FROM orders GROUP BY o_orderstatus",
    "insert_values": """
        SELECT order_status, COUNT(*) AS n, CAST(SUM(total_amount) AS DOUBLE) AS total FROM (
          SELECT o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount
          FROM orders
          UNION ALL VALUES ('reserved', 12.50), ('reserved', 0.75), ('returned', 640.00))
        GROUP BY order_status""",
    "tpcc_schemas": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, c.column_name, c.type, n.rows FROM "
        f"(VALUES {', '.join(_declared(t))}) c(column_name, type), "
        f"(SELECT COUNT(*) AS rows FROM {s}) n" for t, s in _TPCC_SOURCES.items()),
    "bulk_load_renamed": " UNION ALL ".join(
        f"SELECT '{CH_NAMES[t]}' AS table_name, TRUE AS listed, COUNT(*) AS rows FROM {t}"
        for t in ANALYTIC_TABLES),
    "export_parquet_roundtrip": "SELECT * FROM part",
    "schema_evolution_read": "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN "
                             "lower(c_name) || '@example.com' END AS email FROM customer",
    "time_travel_read": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
                        "WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
    "snapshot_list": f"""
        WITH {TPCC_SQL}, {MOVED_SQL}
        SELECT relname, batch AS batch_id, COUNT(m) AS moved
        FROM (SELECT relname, batch, 1 AS m FROM moved WHERE batch IS NOT NULL
              UNION ALL SELECT relname, batch, NULL FROM
              (VALUES ('orders'), ('order_line'), ('hhistory')) t(relname),
              (VALUES (1), (2), (3)) b(batch))
        GROUP BY relname, batch""",
    "partitioned_read": "SELECT event_id, user_id, value, event_type FROM events "
                        "WHERE event_type = 'purchase'",
    "file_stats_manifest": f"""
        WITH {TPCC_SQL}
        SELECT COUNT(*) AS rows, strftime(MIN(ol_delivery_d), '%Y-%m-%d %H:%M:%S.%f') AS first,
               strftime(MAX(ol_delivery_d), '%Y-%m-%d %H:%M:%S.%f') AS last
        FROM order_line WHERE delivered_utc <= TIMESTAMP '2024-01-15 00:00:00'""",
    "file_pruned_scan": "SELECT COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) "
                        "AS DOUBLE) AS amount FROM lineitem WHERE l_linestatus = 'F' AND "
                        "l_shipdate BETWEEN TIMESTAMP '1998-03-01 00:00:00' "
                        "AND TIMESTAMP '1998-05-31 00:00:00'",
    "catalog_add_column": """
        SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END
               AS o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL""",
    "cold_clustered_scan": """
        SELECT l_partkey AS ol_i_id, COUNT(*) AS n,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS amount
        FROM lineitem WHERE l_partkey BETWEEN 10 AND 19 GROUP BY l_partkey""",
    "type_mapping": _type_mapping_sql(),
    "schema_drift": """
        SELECT column_name, declared_type, observed_type, status,
               CASE WHEN observed_type IS NULL THEN NULL ELSE n END AS non_null
        FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'same'),
                     ('o_custkey', 'bigint', 'bigint', 'same'),
                     ('o_orderstatus', 'string', 'string', 'same'),
                     ('o_totalprice', 'decimal(15,2)', 'double', 'retyped'),
                     ('o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'same'),
                     ('o_orderpriority', 'string', NULL, 'missing'),
                     ('o_priority', NULL, 'string', 'added'),
                     ('o_comment', 'string', NULL, 'missing'))
             t(column_name, declared_type, observed_type, status),
             (SELECT COUNT(*) AS n FROM orders)""",
}
