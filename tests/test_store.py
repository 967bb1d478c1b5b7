"""Stores that have lived: many commits, other writers, restarts, upkeep."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.extract import TablePolicy
from tidemark.plans import store as store_module
from tidemark.plans.changes import apply_batch
from tidemark.plans.migrate import move_by_predicate, run_batch
from tidemark.plans.store import TierStore
from tidemark.plans.workload import replay, take_unseen, top_statements
from tidemark.session import scratch
from tidemark.sources.feed import folder_stream, poll_records
from tidemark.sources.files import has_rows
from tidemark.sources.paths import names
from tidemark.streaming.ingest import Route, ingest

CAR = T.StructType().add("id", "long").add("v", "string")
AT = datetime(2024, 1, 1)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def arrive(spark, store, source, checkpoint, first, last):
    cars = spark.range(first, last).withColumn("v", F.col("id").cast("string"))
    poll_records(cars, "cars", "id", AT).write.mode("append").parquet(source)
    ingest(folder_stream(spark, source, max_files=1), store, [Route("cars", "car", CAR)],
           checkpoint).awaitTermination()


def test_other_commits_between_micro_batches_lose_nothing(spark, store):
    source, checkpoint = scratch(spark, "records"), scratch(spark, "checkpoint")
    arrive(spark, store, source, checkpoint, 0, 10)
    store.add_column("car", "note", "string")
    store.append_cold("rejects", store.read("rejects"))
    arrive(spark, store, source, checkpoint, 10, 30)
    assert sorted(r.id for r in store.read("car").collect()) == list(range(30))
    # another checkpoint is another stream, which begins at its own micro-batch 0
    other = scratch(spark, "records")
    arrive(spark, store, other, scratch(spark, "checkpoint"), 100, 150)
    assert store.read("car").count() == 80


def test_load_refuses_a_table_it_has(spark, store):
    df = spark.range(100).withColumn("c", F.col("id") > 4)
    store.load({"t": df})
    move_by_predicate(store, {"t": "id >= 50"})
    with pytest.raises(ValueError, match="already has t"):
        store.load({"t": df.limit(5)})
    assert store.read("t").count() == 100
    store.load({"t": df.where("id < 5")}, replace_existing=True)
    assert store.read("t").count() == 5


def test_two_writers_of_one_batch(spark, store):
    store.load({"t": spark.range(10).toDF("id")})
    first, second = TierStore(spark, store.root), TierStore(spark, store.root)
    batch, states = first.state()
    first.commit(batch + 1, list(states.values()))
    with pytest.raises(RuntimeError, match="already"):
        second.commit(batch + 1, list(states.values()))


def test_alternating_tables_checkpoints_and_upkeep(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "CHECKPOINT_EVERY", 5)
    store.load({"a": spark.range(0).toDF("id"), "b": spark.range(0).toDF("id")})
    want = {"a": Counter(), "b": Counter()}
    for i in range(12):
        name = "ab"[i % 2]
        store.append_cold(name, spark.range(i, i + 1).toDF("id"))
        want[name][(i,)] += 1
    last, states = store.state()
    assert last == 12 and len(states["a"].cold) == 6
    assert {n: rows(store.read(n)) for n in "ab"} == want
    # the state is read from the last checkpoint and at most the commits after it
    assert names(spark, f"{store.root}/checkpoints") == ["upto=4", "upto=9"]
    assert rows(store.read("a", as_of=3)) == Counter([(0,), (2,)])
    store.compact("a")
    store.append_cold("a", spark.range(99, 100).toDF("id"))
    want["a"][(99,)] += 1
    assert {n: rows(store.read(n)) for n in "ab"} == want
    assert store.state()[1]["a"].cold == ((13, 14),)
    assert rows(store.read("a", as_of=12)) == want["a"] - Counter([(99,)])
    store.expire(keep=2)
    assert {n: rows(store.read(n)) for n in "ab"} == want
    assert rows(store.read("a", as_of=13)) == want["a"] - Counter([(99,)])
    assert names(spark, f"{store.root}/commits") == ["batch_id=13", "batch_id=14"]
    assert names(spark, f"{store.root}/cold") == ["a@13", "b"]


def test_many_ranges_make_a_flat_filter(spark, store):
    store.load({"t": spark.range(0).toDF("id")})
    batch = store.append_cold("t", spark.range(3).toDF("id"))
    state = store.state()[1]["t"]
    ranges = ((batch, batch), *((n, n) for n in range(10, 4000, 2)))
    import dataclasses
    store.commit(batch + 1, [dataclasses.replace(state, cold=ranges)])
    assert store.read("t").count() == 3


def test_empty_moves_leave_no_folder(spark, store):
    store.load({"t": spark.range(5).toDF("id")})
    assert move_by_predicate(store, {"t": "id > 10"}) == {"t": 0}
    assert names(spark, f"{store.root}/cold/t") == []


def test_deleted_rows_count_as_gone(spark, store):
    df = spark.range(100).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    store.load({"t": df})
    apply_batch(store, "t", df.where("id < 90").withColumn("op", F.lit("delete")), ["id"])
    state = store.state()[1]["t"]
    assert (state.hot_rows, state.gone_rows) == (100, 90)
    run_batch(store, [TablePolicy("t", "append_only", "ts", ("id",))], datetime(2024, 2, 1), 0)
    state = store.state()[1]["t"]
    assert (state.hot_rows, state.gone_rows) == (0, 0) and store.read("t").count() == 10


def test_stragglers_are_hot_rows_up_to_the_watermark(spark, store):
    df = spark.range(10).select("id", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(id)").alias("ts"))
    store.load({"t": df})
    run_batch(store, [TablePolicy("t", "append_only", "ts", ("id",))], datetime(2024, 1, 5), 0)
    assert store.stragglers("t", "ts").count() == 0
    late = df.where("id IN (2, 8)").select((F.col("id") + 100).alias("id"), "ts", F.lit("insert").alias("op"))
    apply_batch(store, "t", late, ["id"])
    assert [r.id for r in store.stragglers("t", "ts").collect()] == [102]


def test_replay_runs_all_and_top_counts_only_workload(spark):
    spark.range(3).toDF("c").createOrReplaceTempView("customer")
    log = spark.createDataFrame(
        [(f"SELECT c + {i} FROM customer", 1) for i in range(60)]
        + [(f"SELECT {i} FROM pg_catalog.pg_class, customer", 99) for i in range(50)],
        "query string, calls int")
    assert len(replay(spark, top_statements(log, 110))) == 60
    assert top_statements(log, 110).where("query LIKE '%pg_catalog%'").count() == 0
    assert top_statements(log).count() == 0  # the control statements are the most called


def test_unseen_statements_across_polls(spark):
    path = scratch(spark, "seen")
    poll = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    assert rows(take_unseen(poll("a", "b", "a"), path, 0)) == Counter([("a",), ("b",)])
    assert rows(take_unseen(poll("b", "c"), path, 1)) == Counter([("c",)])
    assert not has_rows(take_unseen(poll("a", "c"), path, 2))
    # a poll that failed after it had stored its statements gives them again
    assert rows(take_unseen(poll("b", "c", "d"), path, 1)) == Counter([("c",), ("d",)])
    assert not has_rows(take_unseen(poll("d"), path, 3))


def test_control_statements_take_places_among_the_most_called(spark):
    log = spark.createDataFrame(
        [(f"SET customer_{i} = 1", 100) for i in range(30)]
        + [(f"SELECT {i} FROM customer", 99 - i) for i in range(60)], "query string, calls int")
    top = top_statements(log)
    assert top.count() == 20 and top.agg(F.min("calls")).first()[0] == 80
