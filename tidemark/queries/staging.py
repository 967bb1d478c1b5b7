"""Stores built from the given tables, once per application and data folder.

The lake exists before a query runs; queries share it the way users would. Stores that a query
changes are built for that query alone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.extract import TPCC_POLICIES
from tidemark.operators.tiers import register_hybrid, split_tiers
from tidemark.plans.migrate import run_rounds
from tidemark.plans.store import TierStore
from tidemark.schemas import CH_COLD, conform, tpcc_schema
from tidemark.session import scratch

ANALYTIC_TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

# Moments of the staged migration rounds; the delay of one minute makes the cutoffs midnight.
ROUNDS = (datetime(1998, 1, 1, 0, 1), datetime(1999, 1, 1, 0, 1), datetime(2024, 1, 15, 0, 1))

_ROOTS: dict[tuple[str, str, str], str] = {}
# Frames belong to a session: given tables by path, and the tables of a store by its root.
_GIVEN: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()
_FRAMES: WeakKeyDictionary[SparkSession, dict[str, dict[str, DataFrame]]] = WeakKeyDictionary()


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    frames, path = _GIVEN.setdefault(spark, {}), f"{sf_dir}/{table}.parquet"
    if path not in frames:
        frames[path] = spark.read.parquet(path)
    return frames[path]


def staged(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[TierStore], None]) -> TierStore:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ROOTS:
        store = TierStore(spark, scratch(spark, name))
        build(store)
        _ROOTS[key] = store.root
    return TierStore(spark, _ROOTS[key])


def fresh(spark: SparkSession, name: str) -> TierStore:
    return TierStore(spark, scratch(spark, name))


def analytic_store(spark: SparkSession, sf_dir: str) -> TierStore:
    """The analytic tables, split by key; region, nation and supplier are hot only."""
    def build(store: TierStore) -> None:
        tiers = {}
        for name in ANALYTIC_TABLES:
            df = given(spark, sf_dir, name)
            tiers[name] = split_tiers(df, CH_COLD[name]) if name in CH_COLD else (df, None)
        store.load_tiers(tiers)
    return staged(spark, sf_dir, "analytic", build)


def _register(store: TierStore, text: str, aliases: dict[str, str]) -> None:
    """Views of the tables that occur in ``text``, over the last commit.

    The frames are kept, since a published state never changes.
    """
    frames = _FRAMES.setdefault(store.spark, {})
    if store.root not in frames:
        frames[store.root] = store.tables()
    register_hybrid({aliases.get(name, name): df for name, df in frames[store.root].items()
                     if aliases.get(name, name) in text})


def analytic_views(spark: SparkSession, sf_dir: str, text: str) -> None:
    _register(analytic_store(spark, sf_dir), text, {})


# Each order-processing table: the given table in its role, the rows, and the columns. Warehouse
# and district numbers, which the given tables lack, are derived from the keys.
_ROLES = {
    "customer": ("customer", None, ["c_custkey c_id", ("c_custkey", "c"), "c_name c_last",
                                    "c_mktsegment c_credit", "c_acctbal c_balance"]),
    "district": ("nation", None, ["n_nationkey d_id", "n_regionkey + 1 d_w_id", "n_name d_name"]),
    "hhistory": ("events", None, ["user_id h_c_id", ("user_id", "h_c"), ("user_id", "h"),
                                  "ts h_date", "value h_amount", "event_type h_data"]),
    "item": ("part", None, ["p_partkey i_id", "p_size i_im_id", "p_name i_name",
                            "p_retailprice i_price", "p_type i_data"]),
    "new_order": ("orders", "o_orderstatus = 'O'", ["o_orderkey no_o_id", ("o_orderkey", "no")]),
    "orders": ("orders", None, ["o_orderkey o_id", "o_custkey o_c_id", ("o_orderkey", "o"),
                                "o_orderdate o_entry_d", "o_orderstatus <> 'P' o_all_local"]),
    "order_line": ("lineitem", None, [
        "l_orderkey ol_o_id", ("l_orderkey", "ol"), "l_linenumber ol_number",
        "l_partkey ol_i_id", "l_suppkey ol_supply_w_id",
        "CASE WHEN l_linestatus = 'F' THEN l_shipdate END ol_delivery_d",
        "l_quantity ol_quantity", "l_extendedprice ol_amount", "l_returnflag ol_dist_info"]),
    "stock": ("part", None, ["p_partkey s_i_id", "p_size s_quantity", "p_brand s_data"]),
    "warehouse": ("region", None, ["r_regionkey + 1 w_id", "r_name w_name"]),
}


def tpcc_frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Order-processing tables, all nine by default; the layout is the wide one, since keys
    outgrow 32 bits as the data grows."""
    frames = {}
    for name in names or _ROLES:
        source, rows, columns = _ROLES[name]
        exprs = [e for c in columns for e in (_place(*c) if isinstance(c, tuple) else (c,))]
        df = given(spark, sf_dir, source)
        df = df.where(rows) if rows else df
        layout = "oorder" if name == "orders" else name
        frames[name] = conform(df.selectExpr(*exprs), tpcc_schema(layout, wide=True))
    return frames


def _place(key: str, prefix: str) -> tuple[str, str]:
    return f"{key} % 10 + 1 {prefix}_d_id", f"{key} % 5 + 1 {prefix}_w_id"


TPCC_MOVED = ("orders", "order_line", "hhistory")


def tpcc_store(spark: SparkSession, sf_dir: str) -> TierStore:
    """The tables with a policy, loaded hot and then migrated in the three rounds."""
    def build(store: TierStore) -> None:
        store.load(tpcc_frames(spark, sf_dir, *TPCC_MOVED))
        run_rounds(store, TPCC_POLICIES, ROUNDS)
    return staged(spark, sf_dir, "tpcc", build)


def tpcc_views(spark: SparkSession, sf_dir: str, text: str) -> None:
    _register(tpcc_store(spark, sf_dir), text, {"orders": "oorder"})


# The same roles in SQL, for the counterparts of queries over the order-processing tables.
TPCC_SQL = """
orders_t AS (SELECT o_orderkey AS o_id, o_custkey AS o_c_id, o_orderkey % 10 + 1 AS o_d_id,
  o_orderkey % 5 + 1 AS o_w_id, o_orderdate AS o_entry_d, o_totalprice FROM orders),
order_line AS (SELECT l_orderkey AS ol_o_id, l_orderkey % 10 + 1 AS ol_d_id,
  l_orderkey % 5 + 1 AS ol_w_id, l_linenumber AS ol_number, l_partkey AS ol_i_id,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS ol_delivery_d,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate - INTERVAL 9 HOUR END AS delivered_utc,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS ol_amount FROM lineitem),
hhistory AS (SELECT user_id AS h_c_id, ts AS h_date, ts - INTERVAL 9 HOUR AS date_utc,
  CAST(value AS DECIMAL(12,2)) AS h_amount, event_type AS h_data FROM events),
closed AS (SELECT ol_w_id AS o_w_id, ol_d_id AS o_d_id, ol_o_id AS o_id,
  MAX(delivered_utc) AS closed_at FROM order_line WHERE ol_delivery_d IS NOT NULL GROUP BY 1, 2, 3),
placed AS (SELECT o.*, x.closed_at FROM orders_t o LEFT JOIN closed x USING (o_w_id, o_d_id, o_id))
"""


def batch_of(column: str) -> str:
    """SQL for the staged round that moves a row settled at ``column``, NULL for none."""
    return (f"CASE WHEN {column} <= TIMESTAMP '1998-01-01 00:00:00' THEN 1 "
            f"WHEN {column} <= TIMESTAMP '1999-01-01 00:00:00' THEN 2 "
            f"WHEN {column} <= TIMESTAMP '2024-01-15 00:00:00' THEN 3 END")


# Where each row of the three tables is after the staged rounds, in SQL.
MOVED_SQL = f"""
moved AS (
  SELECT 'orders' AS relname, {batch_of('closed_at')} AS batch, CAST(o_c_id AS DECIMAL(18,2)) AS v
  FROM placed
  UNION ALL SELECT 'order_line', {batch_of('delivered_utc')}, ol_amount FROM order_line
  UNION ALL SELECT 'hhistory', {batch_of('date_utc')}, h_amount FROM hhistory)
"""


def money(column: str, alias: str) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double").alias(alias)
