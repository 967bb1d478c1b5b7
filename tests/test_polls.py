"""Differences of polls, multiset digests, reduced scans, tables in buckets."""

import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.keyed import orphans, snapshot_diff
from tidemark.operators.tiers import differing_buckets, few_keys, multiset_diff, reduced, tier_diff
from tidemark.plans.changes import ChangeError, apply_batch, apply_poll
from tidemark.plans.migrate import move_by_predicate
from tidemark.plans.store import BUCKET, VERSION, Layout
from tidemark.sources.jdbc import split_conditions, split_points

COLUMNS = "a int, b string, v double, w string"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_polls_differ_in_rows_that_came_changed_and_went(spark):
    before = [(1, "x", 1.0, None), (1, None, 2.0, "n"), (None, "x", 3.0, "n"), (2, "x", None, "p"),
              (3, "x", 0.0, "q"), (4, "x", 5.0, "gone")]
    after = [(1, "x", 1.0, None), (1, None, 2.0, None), (None, "x", 3.0, "n"), (2, "x", 1.0, None),
             (3, "x", -0.0, "q"), (5, None, 5.0, "new")]
    diff = snapshot_diff(spark.createDataFrame(before, COLUMNS), spark.createDataFrame(after, COLUMNS), ["a", "b"])
    assert rows(diff) == Counter([(1, None, 2.0, None, "update"), (2, "x", 1.0, None, "update"),
                                  (5, None, 5.0, "new", "insert"), (4, "x", 5.0, "gone", "delete")])


def test_swapped_nulls_are_a_difference(spark):
    a, b = (spark.createDataFrame([r], "k int, x string, y string") for r in ((1, "s", None), (1, None, "s")))
    assert rows(snapshot_diff(a, b, ["k"])) == Counter([(1, None, "s", "update")])
    assert snapshot_diff(a, a, ["k"]).count() == 0
    assert tuple(tier_diff(a, b).first()) == (1, 1)


def test_empty_polls(spark):
    some = spark.createDataFrame([(1, "x", 1.0, "w")], COLUMNS)
    none = some.where("false")
    assert [r.op for r in snapshot_diff(none, some, ["a"]).collect()] == ["insert"]
    assert [r.op for r in snapshot_diff(some, none, ["a"]).collect()] == ["delete"]


def test_a_table_follows_its_polls(spark, store):
    first = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
    second = first.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") < 5, "new").otherwise(F.col("v")))
    store.load({"t": first}, layouts={"t": Layout(("k",), 8)})
    assert apply_poll(store, "t", second, ["k"]) == {"insert": 0, "update": 4, "delete": 8}
    assert rows(store.read("t")) == rows(second) and rows(store.read("t", as_of=0)) == rows(first)
    assert apply_poll(store, "t", first, ["k"]) == {"insert": 8, "update": 4, "delete": 0}
    assert rows(store.read("t")) == rows(first)


def test_digests_tell_multisets_apart(spark):
    whole = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    assert differing_buckets(whole, whole.repartition(7), 64) == []
    assert tuple(tier_diff(whole, whole.repartition(7)).first()) == (0, 0)
    wrong = whole.where("k <> 5").unionAll(whole.where("k = 6")).unionAll(whole.where("k = 6"))
    assert 1 <= len(differing_buckets(whole, wrong, 64)) <= 2
    assert tuple(tier_diff(whole, wrong).first()) == (1, 2) == tuple(multiset_diff(whole, wrong).first())
    # a value that an xor of hashes would lose
    twice = spark.createDataFrame([(1, 1), (1, 1)], "k long, g long")
    assert tuple(tier_diff(twice, twice.limit(0)).first()) == (2, 0)
    # like values of another type are compared as values
    assert tuple(tier_diff(whole, whole.withColumn("g", F.col("g").cast("int"))).first()) == (0, 0)


def test_equal_sides_move_no_whole_row(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = plan(tier_diff(lines, lines.repartition(5)))
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]


def test_reduced_scans(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    some = orders.where("o_orderkey < 20").select("o_custkey").unionAll(
        spark.createDataFrame([(None,)], "o_custkey long"))
    got = reduced(orders, some, ["o_custkey"])
    assert "PushedFilters: [In(o_custkey" in plan(got)
    assert rows(got) == rows(orders.join(some, "o_custkey", "left_semi").select(*orders.columns))
    assert reduced(orders, some, ["o_custkey"], limit=3) is orders and few_keys(some, ["o_custkey"], 3) is None
    two = orders.where("o_orderkey < 20").select("o_custkey", "o_orderstatus")
    assert rows(reduced(orders, two, two.columns)) == rows(orders.join(two, two.columns, "left_semi").select(*orders.columns))
    assert reduced(orders, some.where("false"), ["o_custkey"]).count() == 0


def test_splits_of_equal_depth(spark):
    """A third of the rows in a hundredth of the range, and nulls."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id") / 100).when(
        F.col("id") != 7, F.col("id")).cast("double").alias("k"))
    conditions = split_conditions("k", split_points(df, "k", 12))
    sizes = [df.where(c).count() for c in conditions]
    assert len(sizes) == 12 and sum(sizes) == 30_000 and max(sizes) <= 2 * 30_000 / 12
    days = spark.range(100).select(F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("d"))
    conditions = split_conditions("d", split_points(days, "d", 4))
    assert [days.where(c).count() for c in conditions] == pytest.approx([25] * 4, abs=2)
    one = spark.range(10).select(F.lit(4).alias("k"))
    assert sum(one.where(c).count() for c in split_conditions("k", split_points(one, "k", 5))) == 10
    assert split_conditions("k", split_points(one.where("false"), "k", 5)) == ["1 = 1"]


def test_orphans_by_several_columns(spark):
    child = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, None, "b")], "id int, p int, q string")
    parent = spark.createDataFrame([(1, "a")], "x int, y string")
    assert sorted(r.id for r in orphans(child, parent, ["p", "q"], ["x", "y"]).collect()) == [2, 3]


# Tables in buckets

CHANGE_COLUMNS = "k long, v string, op string"


@pytest.fixture
def bucketed(spark, store):
    store.load({"t": spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"))},
               layouts={"t": Layout(("k",), 50)})
    return store


def files(store, version):
    return glob.glob(f"{store.root}/buckets/t/{VERSION}={version}/**/*.parquet", recursive=True)


def test_a_change_writes_its_buckets_alone(spark, bucketed):
    before = rows(bucketed.read("t"))
    changes = spark.createDataFrame([(7, "new", "update")], CHANGE_COLUMNS)
    assert apply_batch(bucketed, "t", changes, ["k"]) == {"insert": 0, "update": 1, "delete": 0}
    assert 50 <= len(files(bucketed, 0)) and len(files(bucketed, 1)) == 1
    assert spark.read.parquet(*files(bucketed, 1)).count() < 300
    after = rows(bucketed.read("t"))
    assert after == before - Counter([(7, "old")]) + Counter([(7, "new")])
    assert rows(bucketed.read("t", as_of=0)) == before
    state = bucketed.state()[1]["t"]
    assert sorted(Counter(state.buckets).values()) == [1, 49] and state.hot_rows == 5000


def test_readers_choose_buckets_by_partitions(spark, bucketed):
    apply_batch(bucketed, "t", spark.createDataFrame([(7, "new", "update")], CHANGE_COLUMNS), ["k"])
    text = plan(bucketed.read("t"))
    assert "PartitionFilters: [" in text and VERSION in text.split("PartitionFilters: [")[1].split("]")[0] + text
    touched = bucketed.touched(bucketed.state()[1]["t"], bucketed.read("t").where("k = 7"))
    assert len(touched) == 1
    few = bucketed.hot_version(bucketed.state()[1]["t"], touched)
    assert 0 < few.count() < 300 and BUCKET not in few.columns


def test_a_refused_batch_and_its_retry(spark, bucketed):
    before = rows(bucketed.read("t"))
    with pytest.raises(ChangeError):
        apply_batch(bucketed, "t", spark.createDataFrame([(7, "x", "insert"), (9, "y", "update")],
                                                         CHANGE_COLUMNS), ["k"])
    assert rows(bucketed.read("t")) == before
    # the retry touches other buckets than what the refused batch left behind
    apply_batch(bucketed, "t", spark.createDataFrame([(11, "z", "update"), (-1, "n", "insert"),
                                                      (12, None, "delete")], CHANGE_COLUMNS), ["k"])
    want = dict(before)
    for gone in ((11, "old"), (12, "old")):
        del want[gone]
    assert rows(bucketed.read("t")) == Counter(want) + Counter([(11, "z"), (-1, "n")])
    state = bucketed.state()[1]["t"]
    assert state.hot_rows - state.gone_rows == 5000


def test_no_changes_and_moves_of_a_bucketed_table(spark, bucketed):
    none = spark.createDataFrame([], CHANGE_COLUMNS)
    assert apply_batch(bucketed, "t", none, ["k"]) == {"insert": 0, "update": 0, "delete": 0}
    assert bucketed.read("t").count() == 5000
    assert move_by_predicate(bucketed, {"t": "k < 100"}) == {"t": 100}
    assert bucketed.hot("t").count() == 4900 and bucketed.read("t").count() == 5000
    apply_batch(bucketed, "t", spark.createDataFrame([(200, None, "delete")], CHANGE_COLUMNS), ["k"])
    assert bucketed.read("t").count() == 4999
    for _ in range(3):
        apply_batch(bucketed, "t", spark.createDataFrame([(300, "a", "update")], CHANGE_COLUMNS), ["k"])
    bucketed.expire()
    assert bucketed.read("t").count() == 4999 and not files(bucketed, 0)
