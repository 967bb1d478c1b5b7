"""Physical plans: what reaches the scans, what is exchanged, and how a heavy key is handled."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidemark.functions.times import EPOCH
from tidemark.operators.extract import CloseBy, TablePolicy, extract, unsettled
from tidemark.operators.keyed import change_images, delete_using, latest_by_key
from tidemark.operators.tiers import hybrid, split_tiers
from tidemark.queries.staging import analytic_store
from tidemark.session import scratch

QUERIES = contract.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(text):
    """``(location, pushed filters, partition filters, read schema)`` of each Parquet scan."""
    out = []
    for block in re.split(r"\n\n", text):
        if "Scan parquet" in block and "ReadSchema" in block:
            field = {k: (re.search(rf"{k}: (.*)", block) or [None, ""])[1]
                     for k in ("Location", "PushedFilters", "PartitionFilters", "ReadSchema")}
            out.append(field)
    return out


def test_filter_and_columns_reach_both_tiers(spark, sf):
    found = scans(plan(QUERIES["hybrid_filter_pushdown"](spark, sf)))
    assert len(found) == 2
    for scan in found:
        assert "GreaterThanOrEqual(l_shipdate" in scan["PushedFilters"]
        assert "LessThan(l_quantity" in scan["PushedFilters"]
        assert "l_partkey" not in scan["ReadSchema"] and "l_tax" not in scan["ReadSchema"]
    assert sum("_batch_id" in s["PartitionFilters"] for s in found) == 1


def test_projection_reads_three_columns(spark, sf):
    for scan in scans(plan(QUERIES["hybrid_projection"](spark, sf))):
        assert "c_name" not in scan["ReadSchema"]


def test_top_rows_are_kept_per_task(spark, sf):
    text = plan(QUERIES["hybrid_topk"](spark, sf))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_aggregates_shrink_before_the_exchange(spark, sf):
    text = plan(QUERIES["hybrid_group_count"](spark, sf))
    assert text.index("Union") > text.index("Exchange")
    assert "partial_count" in text


@pytest.mark.parametrize("predicate", ["k > 100", "k <= 5"])
def test_both_halves_of_a_split_reach_the_scan(spark, predicate):
    path = scratch(spark, "split")
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(path)
    for half in split_tiers(spark.read.parquet(path), predicate):
        assert "(k," in scans(plan(half))[0]["PushedFilters"]


@pytest.mark.parametrize("zone", [None, "Asia/Seoul", "Europe/Berlin"])
def test_windows_and_their_complement_reach_the_scan(spark, sf, zone):
    events = spark.read.parquet(f"{sf}/events.parquet")
    policy = TablePolicy("events", "append_only", "ts", ("event_id",), zone=zone)
    last, until = datetime(2024, 3, 29), datetime(2024, 4, 1)  # around a clock change in Europe
    moved = scans(plan(extract(policy, events, last, until)))[0]["PushedFilters"]
    assert "GreaterThan(ts" in moved and "LessThanOrEqual(ts" in moved
    rest = scans(plan(events.where(unsettled(policy, last, until))))[0]["PushedFilters"]
    assert "Or(Or(IsNull(ts),LessThanOrEqual(ts" in rest and "GreaterThan(ts" in rest


def test_window_moves_exchange_nothing(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    policy = TablePolicy("events", "append_only", "ts", ("event_id",))
    for df in (extract(policy, events, EPOCH, datetime(2024, 1, 10)),
               events.where(unsettled(policy, EPOCH, datetime(2024, 1, 10)))):
        assert "Exchange" not in plan(df)


def test_children_are_reduced_before_the_exchange_and_bounded_below(spark, sf):
    policy = TablePolicy("orders", "update_once", "o_orderdate", ("o_orderkey",),
                         close_by=CloseBy("lineitem", (("o_orderkey", "l_orderkey"),),
                                          "l_shipdate"))
    text = plan(extract(policy, spark.read.parquet(f"{sf}/orders.parquet"),
                        datetime(1998, 1, 1), datetime(1999, 1, 1),
                        spark.read.parquet(f"{sf}/lineitem.parquet")))
    assert "partial_max" in text
    child = [s for s in scans(text) if "lineitem" in s["Location"]][0]
    assert "GreaterThan(l_shipdate" in child["PushedFilters"]
    assert "LessThanOrEqual(l_shipdate" not in child["PushedFilters"]


def test_in_flight_comparison_reads_later_batches_only(spark, sf):
    store = analytic_store(spark, sf)
    cold = spark.read.parquet(store.cold_path("orders"))
    text = plan(hybrid(store.hot("orders"), cold, committed=3, keys=["o_orderkey"]))
    bounded = [s for s in scans(text) if "_batch_id" in s["PartitionFilters"]]
    assert len(bounded) == 1 and "> 3" in bounded[0]["PartitionFilters"]
    assert bounded[0]["ReadSchema"] == "struct<o_orderkey:bigint>"


# A third of all rows under one key, joins forced to shuffle, and thresholds small enough for
# test data: the run-time plan must split the heavy partition.

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    path = scratch(spark, "skewed")
    spark.range(0, 120_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v")).write.parquet(path)
    yield spark.read.parquet(path)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_adapted(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_key_is_split_in_deletes(spark, skewed):
    df = delete_using(skewed, skewed.where("k > 7 AND k < 2000").select("k"), ["k"])
    assert "skew=true" in run_adapted(df)


def test_heavy_key_is_split_in_change_batches(spark, skewed):
    path = scratch(spark, "changes")
    skewed.where("k < 2000").groupBy("k").agg(F.max("v").alias("v")).withColumn(
        "op", F.lit("update")).write.parquet(path)
    df = change_images(skewed, spark.read.parquet(path), ["k"])
    assert "skew=true" in run_adapted(df)


def test_heavy_key_is_split_in_hybrid_joins(spark, skewed):
    hot, cold = split_tiers(skewed, "k > 100")
    names = spark.range(0, 120_000).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    df = hybrid(hot, cold).join(names, "k")
    assert "skew=true" in run_adapted(df)


def test_heavy_key_sends_one_row_per_task_to_the_latest(spark, skewed):
    text = plan(latest_by_key(skewed, ["k"], ["v"]))
    assert text.index("partial_max") < text.rindex("max(struct")
    assert latest_by_key(skewed, ["k"], ["v"]).where("k = 7").count() == 1
