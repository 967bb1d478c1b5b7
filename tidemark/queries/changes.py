"""Change batches on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.changes import apply_batch
from tidemark.plans.store import Layout
from tidemark.queries.staging import given, staged

# The three kinds of change: repeat orders under new keys, finished orders marked, low-priority
# orders dropped. An order that is both marked and dropped is dropped: deletes come last.
_INSERT = "o_orderpriority = '2-HIGH'"
_UPDATE = "o_orderstatus = 'F'"
_DELETE = "o_orderpriority = '5-LOW'"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _changes(orders: DataFrame) -> dict[str, DataFrame]:
    return {
        "insert": orders.where(_INSERT).withColumn("o_orderkey", -F.col("o_orderkey") - 1),
        "update": orders.where(_UPDATE).withColumn("o_orderstatus", F.lit("X")),
        "delete": orders.where(_DELETE),
    }


def _one_by_one(spark: SparkSession, sf_dir: str):
    """Batch 0 loads, then one batch per kind: each state stays readable."""
    def build(store) -> None:
        orders = _orders(spark, sf_dir)
        store.load({"orders": orders})
        for op, rows in _changes(orders).items():
            apply_batch(store, "orders", rows.withColumn("op", F.lit(op)), ["o_orderkey"])
    return staged(spark, sf_dir, "changes", build)


def apply_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_by_one(spark, sf_dir).read("orders", as_of=1)


def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_by_one(spark, sf_dir).read("orders", as_of=2)


def apply_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_by_one(spark, sf_dir).read("orders", as_of=3)


def _mixed(spark: SparkSession, sf_dir: str, name: str = "mixed-changes", layouts=None):
    def build(store) -> None:
        orders = _orders(spark, sf_dir)
        store.load({"orders": orders}, layouts=layouts)
        parts = [rows.withColumn("op", F.lit(op)).withColumn("seq", F.lit(i))
                 for i, (op, rows) in enumerate(_changes(orders).items())]
        changes = parts[0].unionByName(parts[1]).unionByName(parts[2])
        apply_batch(store, "orders", changes, ["o_orderkey"], ["seq"])
    return staged(spark, sf_dir, name, build)


def apply_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected rows by kind of one batch that holds all three, counted in what it wrote."""
    store = _mixed(spark, sf_dir)
    images = spark.read.parquet(store.hot_path("orders", 1))
    return images.where("_change <> 'same'").groupBy(F.col("_change").alias("op")).agg(
        F.count(F.lit(1)).alias("affected"))


def apply_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).read("orders")


def apply_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed batch on a table laid out by key."""
    layouts = {"orders": Layout(("o_orderkey",), 32)}
    return _mixed(spark, sf_dir, "bucketed-changes", layouts).read("orders")


# A customer's orders, as one change would touch them: a few buckets of many.
_ONE = "o_custkey = 7"


def apply_few_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders change on a table laid out by key; what other buckets hold stays as it is."""
    def build(store) -> None:
        orders = _orders(spark, sf_dir)
        store.load({"orders": orders}, layouts={"orders": Layout(("o_orderkey",), 128)})
        changes = orders.where(_ONE).withColumn("o_orderstatus", F.lit("X"))
        apply_batch(store, "orders", changes.withColumn("op", F.lit("update")), ["o_orderkey"])
    return staged(spark, sf_dir, "bucketed-customer", build).read("orders")


QUERIES = {f.__name__: f for f in (apply_inserts, apply_updates, apply_deletes,
                                   apply_batch_report, apply_mixed, apply_in_buckets,
                                   apply_few_buckets)}

_COLUMNS = "o_custkey, {status} AS o_orderstatus, o_totalprice, o_orderpriority"
_MARKED = _COLUMNS.format(
    status=f"CASE WHEN {_UPDATE} THEN 'X' ELSE o_orderstatus END")
_ADDED = (f"SELECT -o_orderkey - 1, {_COLUMNS.format(status='o_orderstatus')} FROM orders "
          f"WHERE {_INSERT}")

ORACLES = {
    "apply_inserts": "SELECT o_orderkey, " + _COLUMNS.format(status="o_orderstatus")
                     + f" FROM orders UNION ALL {_ADDED}",
    "apply_updates": f"SELECT o_orderkey, {_MARKED} FROM orders UNION ALL {_ADDED}",
    "apply_deletes": f"SELECT o_orderkey, {_MARKED} FROM orders WHERE NOT ({_DELETE}) "
                     f"UNION ALL {_ADDED}",
    "apply_mixed": f"SELECT o_orderkey, {_MARKED} FROM orders WHERE NOT ({_DELETE}) "
                   f"UNION ALL {_ADDED}",
    "apply_in_buckets": f"SELECT o_orderkey, {_MARKED} FROM orders WHERE NOT ({_DELETE}) "
                        f"UNION ALL {_ADDED}",
    "apply_few_buckets": "SELECT o_orderkey, " + _COLUMNS.format(
        status=f"CASE WHEN {_ONE} THEN 'X' ELSE o_orderstatus END") + " FROM orders",
    "apply_batch_report": f"""
        SELECT 'insert' AS op, COUNT(*) AS affected FROM orders WHERE {_INSERT}
        UNION ALL SELECT 'update', COUNT(*) FROM orders WHERE {_UPDATE} AND NOT ({_DELETE})
        UNION ALL SELECT 'delete', COUNT(*) FROM orders WHERE {_DELETE}""",
}
