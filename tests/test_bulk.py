"""What large moves and micro-batches cost: exchanges left out, cores used, text held and tables written."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.extract import CloseBy, TablePolicy
from tidemark.plans.migrate import run_batch
from tidemark.plans.store import TierStore
from tidemark.queries import feed
from tidemark.session import scratch
from tidemark.sources.feed import RECORD_SCHEMA, decode_each, folder_stream, poll_records
from tidemark.streaming.ingest import REJECTS, Route, ingest

AT = datetime(2024, 1, 1)
ITEM = T.StructType().add("k", "long").add("v", "string")
LOG = TablePolicy("log", "append_only", "ts", ("id",))
PARENT = TablePolicy("parent", "update_once", "ts", ("id",), close_by=CloseBy("child", (("id", "of"),), "ts"))


@pytest.fixture
def written(monkeypatch):
    """``(table, whether it was rebalanced)`` of each cold write."""
    seen, original = [], TierStore.write_cold

    def write_cold(self, name, df, batch, rebalance=False, generation=0):
        seen.append((name, rebalance))
        return original(self, name, df, batch, rebalance, generation)
    monkeypatch.setattr(TierStore, "write_cold", write_cold)
    return seen


def day(n):
    return datetime(2024, 1, 1 + n)


def timed(spark, *names):
    """100 rows, one with a null key and one without a time; row ``id`` on day ``id % 25``."""
    rows = [(i if i != 7 else None, None if i == 30 else day(i % 25)) for i in range(100)]
    return spark.createDataFrame(rows, f"{names[0]} int, ts timestamp_ntz")


@pytest.mark.parametrize("until,moved,rebalance", [(0, 4, True), (9, 39, False)])
def test_only_a_small_share_of_a_window_move_is_exchanged(spark, store, written, until, moved, rebalance):
    store.load({"log": timed(spark, "id")})
    assert [r["moved"] for r in run_batch(store, [LOG], day(until), 0)] == [moved]
    assert written == [("log", rebalance)] and store.read("log").count() == 100


@pytest.mark.parametrize("until,rebalance", [(0, True), (9, False)])
def test_closed_parents_go_by_the_share_of_their_children(spark, store, written, until, rebalance):
    store.load({"parent": timed(spark, "id"), "child": timed(spark, "of")})
    run_batch(store, [PARENT], day(until), 0)
    assert written == [("parent", rebalance)] and store.read("parent").count() == 100
    moved = store.cold("parent")
    assert moved.where("id IS NULL").count() == 0 and moved.agg(F.max("ts")).first()[0] == day(until)


def record(text, topic):
    return None, None if text is None else text.encode(), topic, AT


def test_each_record_is_decoded_once_and_text_kept_where_it_does_not_fit(spark):
    texts = [('{"k": 1, "v": "a"}', "items"), ('{"k": "x"}', "items"), (None, "items"), ('{"k": 2}', "other"),
             ("oops", "nowhere"), ('{"k": 3}', None)]
    frame = decode_each(spark.createDataFrame([record(*t) for t in texts], RECORD_SCHEMA),
                        [("items", ITEM), ("items", T.StructType().add("v", "long")), ("other", ITEM)])
    assert frame._jdf.queryExecution().executedPlan().toString().count("from_json") == 3  # one a route
    found = [(r.value, r._known, r._fits_0, r._0_k, r._fits_1, r._fits_2, r._2_k) for r in frame.collect()]
    assert found == [
        ('{"k": 1, "v": "a"}', True, True, 1, False, None, None),  # the second route of the topic rejects it
        ('{"k": "x"}', True, False, None, True, None, None),
        (None, True, False, None, False, None, None),
        (None, True, None, None, None, True, 2),
        ("oops", False, None, None, None, None, None),
        ('{"k": 3}', False, None, None, None, None, None)]


def test_a_micro_batch_writes_only_tables_that_it_has_rows_of(spark, store, written):
    source, checkpoint = scratch(spark, "items"), scratch(spark, "checkpoint")
    routes = [Route("items", "item", ITEM), Route("tags", "tag", T.StructType().add("tag", "string"))]

    def arrive(*rows):
        spark.createDataFrame([record(*r) for r in rows], RECORD_SCHEMA).write.mode("append").parquet(source)
        ingest(folder_stream(spark, source), store, routes, checkpoint).awaitTermination()
    arrive(('{"k": 1}', "items"))
    assert {n for n, _ in written} == {"item"}
    arrive(("oops", "tags"))
    assert {n for n, _ in written} == {"item", REJECTS}
    assert [store.read(n).count() for n in ("item", "tag", REJECTS)] == [1, 0, 1]


def test_changed_records_are_exchanged_again_only_if_few(spark, store, written):
    source, checkpoint = scratch(spark, "items"), scratch(spark, "checkpoint")
    route = Route("items", "item", ITEM, ("k",))
    polls = [[(i, "a") for i in range(40)], [(i, "b" if i < 20 else "a") for i in range(40)],
             [(i, "c" if i < 2 else "b" if i < 20 else "a") for i in range(40)]]
    for minute, rows in enumerate(polls):
        poll_records(spark.createDataFrame(rows, "k long, v string"), "items", "k",
                     datetime(2024, 1, 1, 0, minute)).write.mode("append").parquet(source)
        ingest(folder_stream(spark, source), store, [route], checkpoint).awaitTermination()
    assert written == [("item", False), ("item", False), ("item", True)]
    assert store.read("item").count() == 40 + 20 + 2


def test_a_micro_batch_of_the_feed_has_a_file_for_each_core(spark, tmp_path, monkeypatch):
    tables = {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp_ntz", [(i, i, "O", 1.5, AT) for i in range(20)]),
        "customer": ("c_custkey long, c_mktsegment string, c_acctbal double", [(1, "a", 2.0)]),
        "supplier": ("s_name string", [("s",)]), "region": ("r_regionkey int, r_name string", [(1, "r")])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    limits, original = [], feed.folder_stream
    monkeypatch.setattr(feed, "folder_stream", lambda spark, path, max_files=None: limits.append(max_files)
                        or original(spark, path, max_files))
    found = {r.table_name: (r.n, r.total) for r in feed.cdc_stream_ingest(spark, str(tmp_path)).collect()}
    assert found == {"orders": (20, 30.0), "customer": (1, 2.0), "rejects": (1, None)}
    assert len(limits) == 3 and min(limits) >= spark.sparkContext.defaultParallelism > 2
