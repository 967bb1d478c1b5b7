"""Change records, streams and objects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keyed import latest_by_key, snapshot_diff
from tidemark.plans.changes import apply_batch, apply_poll
from tidemark.plans.store import Layout
from tidemark.queries.staging import given, money, staged
from tidemark.session import scratch
from tidemark.sources.feed import decode, fits, folder_stream, parse_records, poll_records, row_json
from tidemark.sources.files import object_report
from tidemark.streaming.ingest import Route, ingest

FIRST_POLL, SECOND_POLL = datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 0, 30)
ORDER = (T.StructType().add("o_orderkey", "long").add("o_custkey", "long")
         .add("o_orderstatus", "string").add("o_totalprice", "double"))
CUSTOMER = (T.StructType().add("c_custkey", "long").add("c_mktsegment", "string")
            .add("c_acctbal", "double"))


def bulk_poll_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(F.col("o_orderkey").cast("string").alias("key"),
                         row_json(orders).alias("value"))


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders polled twice; by the second poll the early ones have been finished."""
    orders = given(spark, sf_dir, "orders")
    later = orders.withColumn("o_orderstatus", F.when(
        F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "F").otherwise(
        F.col("o_orderstatus")))
    names = ORDER.fieldNames()
    return poll_records(orders.select(*names), "orders", "o_orderkey", FIRST_POLL).unionAll(
        poll_records(later.select(*names), "orders", "o_orderkey", SECOND_POLL))


def cdc_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = parse_records(_polls(spark, sf_dir), ORDER)
    latest = latest_by_key(rows, ["o_orderkey"], ["record_timestamp"])
    return latest.select(*ORDER.fieldNames())


# Between two polls low-priority orders have gone, early ones are finished and some are new.
_GONE, _EARLY = "o_orderpriority = '5-LOW'", "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
_NEW = "o_orderpriority = '2-HIGH'"


def _two_polls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = given(spark, sf_dir, "orders")
    names = ORDER.fieldNames()
    later = orders.where(f"NOT ({_GONE})").withColumn("o_orderstatus", F.when(
        F.expr(_EARLY), "F").otherwise(F.col("o_orderstatus")))
    new = orders.where(_NEW).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return orders.select(*names), later.select(*names).unionAll(new.select(*names))


def poll_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came, changed and went between two polls."""
    return snapshot_diff(*_two_polls(spark, sf_dir), ["o_orderkey"])


def poll_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table kept like its source by polls alone, those that went included."""
    def build(store) -> None:
        first, second = _two_polls(spark, sf_dir)
        store.load({"orders": first}, layouts={"orders": Layout(("o_orderkey",), 16)})
        apply_poll(store, "orders", second, ["o_orderkey"])
    return staged(spark, sf_dir, "poll-sync", build).read("orders")


def cdc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as records; those of errors arrive cut short and must be rejected."""
    text = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 4)")).otherwise(
        F.col("props"))
    records = given(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").cast("binary").alias("key"),
        text.cast("binary").alias("value"), F.col("event_type").alias("topic"),
        F.col("ts").alias("timestamp"))
    decoded = decode(records, T.StructType().add("k", "integer"))
    kind = F.when(fits(), "row").otherwise("reject").alias("kind")
    return decoded.groupBy("topic", kind).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(fits(), F.col("_row.k"))).alias("k_sum"))


def cdc_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics and some broken records through several micro-batches of a stream into tables."""
    def build(store) -> None:
        source = scratch(spark, "records")
        customers = given(spark, sf_dir, "customer").select(*CUSTOMER.fieldNames())
        broken = given(spark, sf_dir, "supplier").select(
            F.col("s_name").cast("binary").alias("key"), F.col("s_name").cast("binary").alias(
                "value"), F.lit("orders").alias("topic"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"))
        routes = [Route("orders", "orders", ORDER), Route("customer", "customer", CUSTOMER)]
        checkpoint = scratch(spark, "checkpoint")
        # a file for each core, at least two: with fewer a micro-batch would leave cores idle
        per_batch = max(2, spark.sparkContext.defaultParallelism)

        def arrive(records: DataFrame) -> None:
            records.write.mode("append").parquet(source)
            ingest(folder_stream(spark, source, max_files=per_batch), store, routes,
                   checkpoint).awaitTermination()
        # other commits come between the micro-batches of one stream
        arrive(_polls(spark, sf_dir))
        store.add_column("customer", "note", "string")
        arrive(poll_records(customers, "customer", "c_custkey", FIRST_POLL))
        store.load({"region": given(spark, sf_dir, "region")})
        apply_batch(store, "region", given(spark, sf_dir, "region").withColumn(
            "op", F.lit("delete")), ["r_regionkey"])
        arrive(broken)
    store = staged(spark, sf_dir, "stream", build)
    orders = latest_by_key(store.read("orders"), ["o_orderkey"], ["record_timestamp"])
    parts = [
        orders.agg(F.count(F.lit(1)).alias("n"), money("o_totalprice", "total")).select(
            F.lit("orders").alias("table_name"), "n", "total"),
        store.read("customer").agg(F.count(F.lit(1)).alias("n"), money("c_acctbal", "total"))
        .select(F.lit("customer").alias("table_name"), "n", "total"),
        store.read("rejects").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("rejects").alias("table_name"), "n", F.lit(None).cast("double").alias("total")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def stream_unrepeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bulk polls, each a stream run of its own that goes on from the checkpoint: the second
    repeats the first but for some orders that changed, the third repeats the second."""
    def build(store) -> None:
        source, checkpoint = scratch(spark, "polls"), scratch(spark, "checkpoint")
        route = Route("orders", "orders", ORDER, ("o_orderkey",))
        orders = given(spark, sf_dir, "orders")
        later = orders.withColumn("o_orderstatus", F.when(F.expr(_EARLY), "F").otherwise(
            F.col("o_orderstatus")))
        for i, rows in enumerate((orders, later, later)):
            poll_records(rows.select(*ORDER.fieldNames()), "orders", "o_orderkey",
                         datetime(2024, 1, 1, 0, i)).write.mode("append").parquet(source)
            ingest(folder_stream(spark, source), store, [route], checkpoint).awaitTermination()
    store = staged(spark, sf_dir, "stream-unrepeated", build)
    return store.read("orders").select(*ORDER.fieldNames(), F.minute("record_timestamp").alias("poll"))


OBJECT_DOCS = 200  # documents per object


def object_read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as many small objects, read back whole; three expected ones are absent."""
    docs = given(spark, sf_dir, "documents").select(
        F.expr(f"doc_id DIV {OBJECT_DOCS}").alias("object"), "text")
    root = scratch(spark, "objects")
    docs.repartition("object").write.partitionBy("object").text(root)
    present = docs.select("object").distinct()
    absent = spark.range(3).select((-F.col("id") - 1).alias("object"))
    expected = present.unionAll(absent).select(F.col("object").cast("string").alias("key"))
    return object_report(spark, root, expected,
                         F.regexp_extract(F.col("path"), r"/object=(-?\d+)/", 1))


QUERIES = {f.__name__: f for f in (bulk_poll_to_json, cdc_latest_by_key, poll_diff, poll_sync,
                                   cdc_parse, cdc_stream_ingest, stream_unrepeated, object_read_report)}

_STATUS = f"CASE WHEN {_EARLY.replace('_NTZ', '')} THEN 'F' ELSE o_orderstatus END"
_SECOND = f"""
    SELECT o_orderkey, o_custkey, {_STATUS} AS o_orderstatus, o_totalprice FROM orders
    WHERE NOT ({_GONE})
    UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE {_NEW}"""

ORACLES = {
    "bulk_poll_to_json": """
        SELECT CAST(o_orderkey AS VARCHAR) AS key,
               '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
               || ',"o_orderstatus":"' || o_orderstatus || '"}' AS value FROM orders""",
    "cdc_latest_by_key": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < "
                         "TIMESTAMP '1998-01-01 00:00:00' THEN 'F' ELSE o_orderstatus END AS "
                         "o_orderstatus, o_totalprice FROM orders",
    "poll_diff": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'delete' AS op FROM orders
        WHERE {_GONE}
        UNION ALL SELECT o_orderkey, o_custkey, 'F', o_totalprice, 'update' FROM orders
        WHERE NOT ({_GONE}) AND {_EARLY.replace('_NTZ', '')} AND o_orderstatus <> 'F'
        UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, 'insert' FROM orders
        WHERE {_NEW}""",
    "poll_sync": _SECOND,
    "cdc_parse": """
        SELECT event_type AS topic, COUNT(*) AS n,
               SUM(CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INT)
                   END) AS k_sum,
               CASE WHEN event_type = 'error' THEN 'reject' ELSE 'row' END AS kind
        FROM events GROUP BY event_type""",
    "cdc_stream_ingest": """
        SELECT 'orders' AS table_name, COUNT(*) AS n,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
        UNION ALL SELECT 'customer', COUNT(*),
               CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer
        UNION ALL SELECT 'rejects', COUNT(*), NULL FROM supplier""",
    "stream_unrepeated": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 0 AS poll FROM orders
        UNION ALL SELECT o_orderkey, o_custkey, 'F', o_totalprice, 1 FROM orders
        WHERE {_EARLY.replace('_NTZ', '')} AND o_orderstatus <> 'F'""",
    "object_read_report": f"""
        SELECT COUNT(DISTINCT doc_id // {OBJECT_DOCS}) + 3 AS total,
               COUNT(DISTINCT doc_id // {OBJECT_DOCS}) AS success, 3 AS missing,
               CAST(SUM(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents""",
}
