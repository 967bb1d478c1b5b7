"""Splitting and hybrid reading."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.keyed import latest_by_key, orphans
from tidemark.operators.tiers import BATCH, hybrid, multiset_diff, split_tiers, tier_concat

ROWS = [(1, "a"), (2, None), (None, "c"), (None, None), (5, "e"), (5, "e")]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "k int, v string")


@pytest.mark.parametrize("predicate", [
    "k > 2", "v = 'a'", "k > 1 AND v IS NOT NULL", "k > 1 OR v = 'c'", "NOT (k = 5)", "true",
    "false", "k IN (1, NULL)", "CAST(NULL AS BOOLEAN)", "k <=> NULL"])
def test_split_loses_and_repeats_nothing(table, predicate):
    hot, cold = split_tiers(table, predicate)
    assert rows(hot) + rows(cold) == Counter(ROWS)
    assert rows(cold) == rows(table.where(predicate))
    assert rows(hybrid(hot, cold)) == Counter(ROWS)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(-1, 7), st.integers(-1, 7), st.sampled_from(["AND", "OR"]))
def test_random_splits_are_invisible(table, low, high, word):
    hot, cold = split_tiers(table, f"k > {low} {word} k < {high}")
    diff = multiset_diff(table, hybrid(hot, cold)).first()
    assert (diff.missing, diff.extra) == (0, 0)


def test_hot_only(table):
    assert hybrid(table) is table


def test_result_concat_differs_for_aggregates(table):
    hot, cold = split_tiers(table, "k > 2")

    def count(df):
        return df.agg(F.count(F.lit(1)).alias("n"))
    assert tier_concat(count, hot, cold).count() == 2
    assert [r.n for r in count(hybrid(hot, cold)).collect()] == [6]


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("step", ["before", "appended", "deleted"])
def test_each_row_once_at_every_step_of_a_move(spark, keys, step):
    """Batch 1 moves k > 5. A live store is read by keys; a version store by commit."""
    def numbers(low, high):
        return spark.range(low, high).select(F.col("id").alias("k"))
    cold = numbers(0, 3).withColumn(BATCH, F.lit(0))
    if step != "before":
        cold = cold.unionAll(numbers(6, 10).withColumn(BATCH, F.lit(1)))
    hot = numbers(3, 6) if step == "deleted" else numbers(3, 10)
    committed = 1 if step == "deleted" and not keys else 0
    read = hybrid(hot, cold, committed=committed, keys=keys)
    assert sorted(r.k for r in read.collect()) == list(range(10))


def test_evolved_column_reads_null_in_the_older_tier(spark):
    hot = spark.createDataFrame([(1, "x")], "k int, extra string")
    cold = spark.createDataFrame([(2,)], "k int")
    assert rows(hybrid(hot, cold)) == Counter([(1, "x"), (2, None)])


def test_multiset_diff_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    assert tuple(multiset_diff(a, b).first()) == (2, 2)


def test_latest_by_key_with_ties_and_a_heavy_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") % 7).alias("seq"), F.col("id").alias("v"))
    got = {r.k: (r.seq, r.v) for r in latest_by_key(df, ["k"], ["seq"]).collect()}
    want = {}
    for r in df.collect():
        want[r.k] = max(want.get(r.k, (-1, -1)), (r.seq, r.v))
    assert got == want


def test_orphans(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(10,)], "pk int")
    assert sorted(r.id for r in orphans(child, parent, "p", "pk").collect()) == [2, 3]
