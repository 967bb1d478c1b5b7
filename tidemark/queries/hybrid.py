"""Queries over hybrid tables: the SQL is the same with and without tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tiers import BATCH, hybrid, reduced, split_tiers, tier_concat, tier_diff
from tidemark.plans.migrate import tier_counts
from tidemark.queries.staging import (
    analytic_store,
    analytic_views,
    given,
    money,
    staged,
    tpcc_views,
)
from tidemark.schemas import CH_COLD
from tidemark.sources.jdbc import split_conditions, split_points
from tidemark.sources.files import has_rows

# Fixed value: the one example query, with its date anchored in the test data.
FLAGSHIP = """
SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate >= DATE '2001-11-04' - INTERVAL '7' DAY
"""

# Run unchanged over the hybrid views here and over the whole tables as their counterpart.
SQL = {
    "hybrid_join_agg": FLAGSHIP,
    "hybrid_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority "
                   "FROM orders",
    "hybrid_hot_only": """
        SELECT r.r_name, COUNT(*) AS suppliers,
               CAST(SUM(CAST(s.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
    "hybrid_group_having": """
        SELECT l_suppkey, COUNT(*) AS n,
               CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
        FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600""",
    "hybrid_topk": "SELECT o_orderkey, o_totalprice FROM orders "
                   "ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "hybrid_limit_offset": "SELECT o_orderkey, o_orderstatus FROM orders "
                           "ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100",
    "hybrid_filter_pushdown": """
        SELECT COUNT(*) AS n,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
        FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'
          AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_quantity < 24""",
    "hybrid_projection": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0",
    "hybrid_comma_join": """
        SELECT c.c_mktsegment, COUNT(*) AS n,
               CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM customer c, orders o WHERE c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""",
    "hybrid_group_count": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "hybrid_all_aggs": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
               ROUND(AVG(l_quantity), 4) AS avg_qty, MAX(l_extendedprice) AS max_price,
               MIN(l_extendedprice) AS min_price
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "hybrid_distinct": "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem",
}

PARAM_SQL = ("SELECT o_orderkey, o_totalprice FROM orders "
             "WHERE o_totalprice > ? AND o_orderpriority = ? AND o_orderkey >= ?")
PARAM_ARGS = [150000.0, "1-URGENT", 10]

RECENT_LINES = """
SELECT CAST(SUM(ol.ol_amount) AS DOUBLE) AS amount, COUNT(*) AS n
FROM order_line ol JOIN oorder o ON ol.ol_o_id = o.o_id
WHERE ol.ol_delivery_d >= DATE '2001-11-04' - INTERVAL '7' DAY
"""


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        analytic_views(spark, sf_dir, text)
        return spark.sql(text)
    return run


def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    analytic_views(spark, sf_dir, PARAM_SQL)
    return spark.sql(PARAM_SQL, args=PARAM_ARGS)


def hybrid_recent_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent order lines over tables that three migration rounds have split."""
    tpcc_views(spark, sf_dir, RECENT_LINES)
    return spark.sql(RECENT_LINES)


def tier_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_counts(analytic_store(spark, sf_dir), list(CH_COLD))


def tier_concat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold = analytic_store(spark, sf_dir).tiers("orders")["orders"]

    def wanted(df: DataFrame) -> DataFrame:
        return df.where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return tier_concat(wanted, hot, cold)


def tier_vs_whole_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = analytic_store(spark, sf_dir).read("lineitem")
    return tier_diff(given(spark, sf_dir, "lineitem"), tiers)


def tier_planted_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier that lost one order's lines, holds another's twice and has one changed."""
    whole = given(spark, sf_dir, "lineitem")
    tiers = analytic_store(spark, sf_dir).read("lineitem")
    wrong = tiers.where("l_orderkey <> 1").unionByName(tiers.where("l_orderkey = 2"))
    return tier_diff(whole, wrong.withColumn("l_quantity", F.when(
        F.col("l_orderkey") == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))))


def hybrid_reduced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few customers and their orders in both tiers: the customers' keys go to the scans."""
    store = analytic_store(spark, sf_dir)
    some = store.read("customer").where("c_acctbal > 9500").select("c_custkey")
    keys = some.withColumnRenamed("c_custkey", "o_custkey")
    hot, cold = (reduced(tier, keys, ["o_custkey"]) for tier in store.tiers("orders")["orders"])
    return hybrid(hot, cold).join(some, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_custkey").agg(F.count(F.lit(1)).alias("n"), money("o_totalprice", "total"))


def hot_scan_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in splits of equally many rows, over a key with a third of its rows in a hundredth of
    its range: how many splits, their rows, and whether none has more than twice the mean."""
    lines = given(spark, sf_dir, "lineitem").select(F.when(
        F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") / 100).otherwise(
        F.col("l_orderkey")).cast("double").alias("key"))
    parts = [lines.where(c).agg(F.count(F.lit(1)).alias("n"))
             for c in split_conditions("key", split_points(lines, "key", 16))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole.agg(F.count(F.lit(1)).cast("int").alias("splits"), F.sum("n").alias("rows"),
                     (F.max("n") <= 2 * F.avg("n")).alias("even"))


def _in_flight(spark: SparkSession, sf_dir: str):
    """Orders in the middle of a move: appended to cold, not yet gone from hot."""
    def build(store) -> None:
        early, later = ("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'",
                        "o_orderdate < TIMESTAMP_NTZ '1999-01-01 00:00:00'")
        batch = store.load_tiers({"orders": split_tiers(given(spark, sf_dir, "orders"), early)})
        store.write_cold("orders", store.hot("orders").where(later), batch + 1)
    store = staged(spark, sf_dir, "overlap", build)
    committed, states = store.state()
    hot = store.hot_version(states["orders"])
    schema = T.StructType(states["orders"].struct.fields + [T.StructField(BATCH, T.LongType())])
    return hot, spark.read.schema(schema).parquet(store.cold_path("orders")), committed


def _order_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                           money("o_totalprice", "total"))


def hybrid_overlap_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold, committed = _in_flight(spark, sf_dir)
    return _order_totals(hybrid(hot, cold, committed=committed))


def hybrid_overlap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot, cold, committed = _in_flight(spark, sf_dir)
    return _order_totals(hybrid(hot, cold, committed=committed, keys=["o_orderkey"]))


def hot_nonempty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is any hot row that a query sees decides if the hot tier takes part in it."""
    hot = analytic_store(spark, sf_dir).hot("orders").where("o_totalprice > 100000")
    return hot.agg(F.count(F.lit(1)).alias("hot_rows"), F.lit(has_rows(hot)).alias("takes_part"))


def result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result under a fixed name, replaced by the next query."""
    for text in (SQL["hybrid_group_count"], SQL["hybrid_comma_join"]):
        analytic_views(spark, sf_dir, text)
        spark.sql(text).createOrReplaceTempView("last_result")
    return spark.table("last_result")


QUERIES = {name: _sql(text) for name, text in SQL.items()} | {
    f.__name__: f for f in (
        param_query, hybrid_recent_order_lines, tier_split_counts, tier_concat_scan,
        tier_vs_whole_diff, tier_planted_diff, hybrid_reduced_join, hot_scan_splits,
        hybrid_overlap_safe, hybrid_overlap_keys, hot_nonempty_gate,
        result_view)}

_KEYS = {"customer": "c_custkey", "lineitem": "l_orderkey", "orders": "o_orderkey",
         "part": "p_partkey"}
_TOTALS = ("SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) "
           "AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus")

ORACLES = dict(SQL) | {
    "param_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000.0 "
                   "AND o_orderpriority = '1-URGENT' AND o_orderkey >= 10",
    "hybrid_recent_order_lines": """
        SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS amount, COUNT(*) AS n
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE l_linestatus = 'F' AND l_shipdate >= DATE '2001-11-04' - INTERVAL '7' DAY""",
    "tier_split_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS relname, CASE WHEN {k} > 100 THEN 'cold' ELSE 'hot' END AS tier, "
        f"COUNT(*) AS rows FROM {t} GROUP BY 1, 2" for t, k in _KEYS.items()),
    "tier_concat_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "tier_vs_whole_diff": "SELECT 0 AS missing, 0 AS extra",
    "tier_planted_diff": "SELECT COUNT(*) FILTER (WHERE l_orderkey IN (1, 3)) AS missing, "
                         "COUNT(*) FILTER (WHERE l_orderkey IN (2, 3)) AS extra FROM lineitem",
    "hybrid_reduced_join": """
        SELECT c_custkey, COUNT(*) AS n,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9500
        GROUP BY c_custkey""",
    "hot_scan_splits": "SELECT 16 AS splits, COUNT(*) AS rows, TRUE AS even FROM lineitem",
    "hybrid_overlap_safe": _TOTALS,
    "hybrid_overlap_keys": _TOTALS,
    "hot_nonempty_gate": "SELECT COUNT(*) AS hot_rows, COUNT(*) > 0 AS takes_part FROM orders "
                         "WHERE o_orderkey <= 100 AND o_totalprice > 100000",
    "result_view": SQL["hybrid_comma_join"],
}
