"""Rounds driven by a stream, moves along foreign keys, clustered batches, streams without repeats."""

import glob
from collections import Counter
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.clustering import clustered, interleaved
from tidemark.operators.extract import TablePolicy
from tidemark.operators.keyed import orphans
from tidemark.operators.references import ForeignKey, dependents, parents_first
from tidemark.plans.migrate import move_with_children
from tidemark.plans.store import TierStore
from tidemark.session import scratch
from tidemark.sources.feed import folder_stream, poll_records
from tidemark.streaming.ingest import Route, ingest, latest_table
from tidemark.streaming.rounds import clock, run_stream

DAY = datetime(2024, 1, 1)
LOG = TablePolicy("log", "append_only", "ts", ("id",))


def day(n):
    return DAY + timedelta(days=n)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# Rounds

@pytest.fixture
def log(spark, store):
    store.load({"log": spark.createDataFrame([(i, day(i % 10)) for i in range(40)],
                                             "id int, ts timestamp_ntz")})
    return store


def ticks(spark, path, *days):
    for n in days:
        spark.createDataFrame([(day(n),)], "at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)


def marks(store):
    return [r.last_ts for r in store.snapshots("log").orderBy("batch_id").collect()]


@pytest.mark.parametrize("after", [False, True])
def test_a_killed_run_goes_on_with_the_missing_round(spark, log, monkeypatch, after):
    source, checkpoint = scratch(spark, "ticks"), scratch(spark, "rounds")
    stream = ticks(spark, source, 1, 3, 5)
    original, calls = TierStore.commit, []

    def dies(self, batch, states):
        calls.append(batch)
        if len(calls) == 2:
            if after:
                original(self, batch, states)
            raise RuntimeError("killed")
        original(self, batch, states)
    with monkeypatch.context() as patch:
        patch.setattr(TierStore, "commit", dies)
        with pytest.raises(Exception, match="killed"):
            run_stream(stream, log, [LOG], checkpoint, 0).awaitTermination()
    run_stream(stream, log, [LOG], checkpoint, 0).awaitTermination()
    assert marks(log)[1:] == [day(1), day(3), day(5)] and log.read("log").count() == 40
    assert sorted(r.ts for r in log.hot("log").select("ts").distinct().collect()) == [day(n) for n in (6, 7, 8, 9)]
    # nothing new, no round; and two ticks more
    run_stream(stream, log, [LOG], checkpoint, 0).awaitTermination()
    assert len(marks(log)) == 4
    run_stream(ticks(spark, source, 7, 20), log, [LOG], checkpoint, 0).awaitTermination()
    assert marks(log)[-2:] == [day(7), day(20)] and log.hot("log").count() == 0


def test_ticks_of_the_clock(spark, log):
    at = datetime(2024, 1, 3)
    stream = clock(spark, at, 24 * 3600)
    query = run_stream(stream, log, [LOG], scratch(spark, "clock"), 0, every="200 milliseconds")
    try:
        for _ in range(200):
            if query.awaitTermination(1) or len(marks(log)) > 2:
                break
    finally:
        query.stop()
    assert marks(log)[1:3] == [at, at + timedelta(days=1)]


# Foreign keys

def test_tables_in_order():
    refs = [ForeignKey("line", ("o",), "ord", ("o",)), ForeignKey("ord", ("c",), "cust", ("c",)),
            ForeignKey("line", ("p",), "part", ("p",))]
    order = parents_first(refs, ["other"])
    assert order.index("cust") < order.index("ord") < order.index("line") > order.index("part")
    assert "other" in order and dependents(refs, ["ord"]) == {"ord", "line"}
    assert dependents(refs, ["other"]) == {"other"}
    with pytest.raises(ValueError):
        parents_first([*refs, ForeignKey("cust", ("x",), "line", ("x",))])


REFS = [ForeignKey("ord", ("w", "c"), "cust", ("w", "c")), ForeignKey("line", ("o",), "ord", ("o",))]


def test_children_move_with_their_parents(spark, store):
    """Composite keys, null references, a customer with a third of all orders, repeated moves."""
    cust = [(w, c) for w in range(3) for c in range(10)]
    order = [(o, 1, 4) if o % 3 == 0 else (o, o % 3, o % 10) if o % 7 else (o, None, 4) for o in range(200)]
    line = [(o if o % 11 else None, n) for o in range(200) for n in range(3)]
    data = {"cust": spark.createDataFrame(cust, "w int, c int"),
            "ord": spark.createDataFrame(order, "o int, w int, c int"),
            "line": spark.createDataFrame(line, "o int, n int")}
    store.load(data)
    want = {n: rows(df) for n, df in data.items()}

    def check():
        hot = {n: store.hot(n) for n in data}
        for name in data:
            assert rows(store.read(name).select(*data[name].columns)) == want[name]
        for r in REFS:
            lost = orphans(hot[r.child], hot[r.parent], r.columns, r.parent_columns)
            assert lost.where(" AND ".join(f"{c} IS NOT NULL" for c in r.columns)).count() == 0

    moved = move_with_children(store, {"cust": "w = 1 AND c = 4", "ord": "o = 1"}, REFS)
    gone = {o for o, w, c in order if (w, c) == (1, 4)} | {1}
    assert moved == {"cust": 1, "ord": len(gone), "line": 3 * sum(1 for o in gone if o % 11)}
    check()
    moved = move_with_children(store, {"line": "o < 20"}, REFS)
    assert set(moved) == {"line"}
    check()
    move_with_children(store, {"cust": "w = 2"}, REFS)
    check()
    assert move_with_children(store, {"cust": "w = 99"}, REFS) == {"cust": 0, "ord": 0, "line": 0}
    with pytest.raises(ValueError, match="itself"):
        move_with_children(store, {"cust": "w = 0"}, [ForeignKey("cust", ("c",), "cust", ("w",))])


# Clustered batches

def row_groups(path, column, low, high):
    """``(groups that the statistics leave, all)``."""
    kept = every = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            every += 1
            kept += stats.max >= low and stats.min <= high
    return kept, every


def test_two_filters_each_leave_few_row_groups(spark, sf, store):
    """Many small row groups, skewed columns; half of what a plain copy reads, at most."""
    lines = spark.range(200_000).select(
        F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("part"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3000))).alias("day"))
    paths = {"plain": scratch(spark, "plain"), "clustered": scratch(spark, "clustered")}
    for name, df in (("plain", lines.repartition(8)), ("clustered", clustered(lines, ["part", "day"], 8))):
        df.write.option("parquet.block.size", 20_000).option("parquet.page.row.count.limit", 1000).parquet(paths[name])
    assert rows(spark.read.parquet(paths["clustered"]).groupBy("day").count()) == rows(
        lines.groupBy("day").count())
    for column, low, high in (("part", 4000, 4400), ("day", 1000, 1060)):
        before, after = (row_groups(paths[n], column, low, high) for n in ("plain", "clustered"))
        assert before[0] == before[1] >= 40 and after[1] >= 40
        assert after[0] / after[1] < 0.5 * before[0] / before[1], (column, before, after)


def test_places_on_the_curve(spark):
    df = spark.createDataFrame([(3, 0), (0, 3), (1, 2), (5, 6)], "a int, b int")
    z = [r.z for r in df.select(interleaved([F.col("a"), F.col("b")], 3).alias("z")).collect()]
    assert z == [0b000101, 0b001010, 0b001001, 0b111001]
    assert clustered(df.where("false"), ["a", "b"]).count() == 0
    nulls = spark.createDataFrame([(None, 1), (2, None), (None, None)], "a int, b int")
    assert rows(clustered(nulls, ["a", "b"])) == rows(nulls)


def test_clustered_append(spark, store):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("v"))
    store.load({"t": df.where("false")})
    store.append_cold("t", df, cluster=["id", "v"])
    assert rows(store.read("t").select("id", "v")) == rows(df)


def test_moves_cluster_what_they_move(spark, store, monkeypatch):
    from tidemark.plans import store as stores
    from tidemark.plans.migrate import move_by_predicate, run_batch
    seen = []
    original = stores.clustered
    monkeypatch.setattr(stores, "clustered", lambda df, columns: seen.append(tuple(columns)) or original(df, columns))
    df = spark.range(300).select(F.col("id").cast("int").alias("id"), F.expr(
        "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(CAST(id % 10 AS INT))").alias("ts"))
    store.load({"log": df, "t": df})
    run_batch(store, [TablePolicy("log", "append_only", "ts", ("id",), cluster=("ts", "id"))], day(5), 0)
    assert move_by_predicate(store, {"t": "id < 100"}, {"t": ["id"]}) == {"t": 100}
    assert seen == [("ts", "id"), ("id",)]
    assert all(rows(store.read(n).select("id", "ts")) == rows(df) for n in ("log", "t"))


# Streams without repeats

ITEM = T.StructType().add("k", "long").add("v", "string")
ROUTE = Route("items", "item", ITEM, ("k",))


def poll(spark, source, minute, data):
    poll_records(spark.createDataFrame(data, "k long, v string"), "items", "k",
                 datetime(2024, 1, 1, 0, minute)).write.mode("append").parquet(source)


def run(spark, store, source, checkpoint):
    ingest(folder_stream(spark, source), store, [ROUTE], checkpoint).awaitTermination()


def kept(store):
    return sorted(((r.k, r.v, r.record_timestamp.minute) for r in store.read("item").collect()), key=str)


def test_only_what_differs_from_the_last_record_is_stored(spark, store):
    source, checkpoint = scratch(spark, "items"), scratch(spark, "checkpoint")
    poll(spark, source, 1, [(1, "a"), (2, "a"), (3, None), (None, "n")])
    run(spark, store, source, checkpoint)
    # all of it again, one changed, one new
    poll(spark, source, 2, [(1, "b"), (2, "a"), (3, None), (None, "n"), (4, "d")])
    run(spark, store, source, checkpoint)
    # back to an earlier value, two polls in one micro-batch, and one that comes late
    poll(spark, source, 4, [(1, "a"), (2, "a"), (3, "x")])
    poll(spark, source, 5, [(1, "a"), (2, "c"), (3, None)])
    poll(spark, source, 0, [(2, "a")])
    run(spark, store, source, checkpoint)
    want = [(1, "a", 1), (1, "a", 4), (1, "b", 2), (2, "a", 0), (2, "a", 1), (2, "c", 5), (3, None, 1),
            (3, None, 5), (3, "x", 4), (4, "d", 2), (None, "n", 1)]
    assert kept(store) == sorted(want, key=str)
    before = store.state()[0]
    run(spark, store, source, checkpoint)
    assert store.state()[0] == before
    state = store.state()[1][latest_table("item")]
    assert state.hot_rows == store.hot(latest_table("item")).count() == 5


@pytest.mark.parametrize("after", [False, True])
def test_a_failed_micro_batch_remembers_nothing(spark, store, monkeypatch, after):
    source, checkpoint = scratch(spark, "items"), scratch(spark, "checkpoint")
    poll(spark, source, 1, [(1, "a"), (2, "a")])
    run(spark, store, source, checkpoint)
    poll(spark, source, 2, [(1, "a"), (2, "b")])
    original = TierStore.commit

    def failing(self, batch, states):
        if after:
            original(self, batch, states)
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(TierStore, "commit", failing)
        with pytest.raises(Exception, match="lost"):
            run(spark, store, source, checkpoint)
    run(spark, store, source, checkpoint)
    assert kept(store) == [(1, "a", 1), (2, "a", 1), (2, "b", 2)]
    poll(spark, source, 3, [(1, "a"), (2, "b")])
    run(spark, store, source, checkpoint)
    assert kept(store) == [(1, "a", 1), (2, "a", 1), (2, "b", 2)]


def test_routes_to_a_table_agree_on_its_keys(spark, store):
    with pytest.raises(ValueError, match="keys"):
        ingest(None, store, [ROUTE, Route("other", "item", ITEM)], "nowhere")
