"""Migration: conservation, retries, windows, policies."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import EPOCH
from tidemark.operators.extract import (
    TPCC_POLICIES,
    CloseBy,
    TablePolicy,
    active_policies,
    extract,
    policy_frame,
    rejected_policies,
    upsert_policies,
)
from tidemark.operators.tiers import BATCH
from tidemark.plans.changes import apply_batch
from tidemark.plans import migrate
from tidemark.plans.migrate import move_by_predicate, run_batch, run_for, run_rounds
from tidemark.plans.store import Layout, TierStore

DAY = datetime(2024, 1, 1)
LOG = TablePolicy("log", "append_only", "ts", ("id",))
LINE = TablePolicy("line", "update_once", "done", ("o", "n"))
ORDER = TablePolicy("ord", "update_once", "done", ("o",),
                    close_by=CloseBy("line", (("o", "o"),), "done"))
POLICIES = [ORDER, LINE, LOG]


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def tables(spark):
    log = [(i, day(i % 10)) for i in range(40)] + [(99, None)]
    line = [(o, n, day(d)) for o, days in enumerate([[1, 2], [1, 6], [None, 3], [None], [8, 8, 8]])
            for n, d in enumerate(days)]
    return {"log": spark.createDataFrame(log, "id int, ts timestamp_ntz"),
            "line": spark.createDataFrame(line, "o int, n int, done timestamp_ntz"),
            "ord": spark.createDataFrame([(o, f"c{o}") for o in range(6)], "o int, c string")}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def whole(store):
    return {n: rows(df) for n, df in store.tables().items()}


def test_rounds_keep_every_row(spark, store):
    data = tables(spark)
    store.load(data)
    want = {n: rows(df) for n, df in data.items()}
    marks = [EPOCH]
    for moment in (day(2), day(5), day(5), day(30)):
        run_batch(store, POLICIES, moment, delay_minutes=0)
        assert whole(store) == want
        marks.append(store.state()[1]["log"].last_ts)
    assert marks == sorted(marks)
    assert rows(store.hot("log")) == Counter([(99, None)])
    assert sorted(r.o for r in store.hot("ord").collect()) == [3, 5]


def test_parent_moves_with_its_last_child(spark, store):
    store.load(tables(spark))
    moved = []
    for moment in (day(2), day(5), day(7), day(9)):
        report = {r["relname"]: r["moved"] for r in run_batch(store, POLICIES, moment, 0)}
        moved.append((report["ord"], report["line"]))
    # day 2: order 0; day 5: order 2, whose other line never finishes; day 7: order 1; day 9: 4
    assert moved == [(1, 3), (1, 1), (1, 1), (1, 3)]


def test_empty_batch_keeps_the_version_and_advances(spark, store):
    store.load(tables(spark))
    run_batch(store, POLICIES, day(30), 0)
    before = store.state()[1]["log"]
    report = run_batch(store, POLICIES, day(40), 0)
    after = store.state()[1]["log"]
    assert all(r["moved"] == 0 for r in report)
    assert after.hot_version == before.hot_version and after.last_ts == day(40)


def test_small_windows_are_noted_and_rewritten_once_half_is_gone(spark, store):
    """41 rows, 4 per day: versions stay until 21 rows have gone."""
    data = tables(spark)["log"]
    store.load({"log": data})
    seen = []
    for n in range(10):
        run_batch(store, [LOG], day(n), 0)
        state = store.state()[1]["log"]
        seen.append((state.hot_version, state.hot_rows, state.gone_rows))
        assert rows(store.read("log")) == rows(data)
        assert store.hot("log").count() == state.hot_rows - state.gone_rows == 41 - 4 * (n + 1)
    assert seen[:6] == [(0, 41, 4), (0, 41, 8), (0, 41, 12), (0, 41, 16), (0, 41, 20), (6, 17, 0)]
    assert seen[6:] == [(6, 17, 4), (6, 17, 8), (9, 5, 0), (10, 1, 0)]
    for batch in range(11):
        assert rows(store.read("log", as_of=batch)) == rows(data)


def test_changes_between_windows(spark, store):
    """A late row, an update of a settled row's key, then more windows."""
    store.load({"log": tables(spark)["log"]})
    run_batch(store, [LOG], day(1), 0)
    assert store.state()[1]["log"].gone is not None
    apply_batch(store, "log", spark.createDataFrame(
        [(500, day(0), "insert"), (2, day(7), "update"), (0, day(7), "update")],
        "id int, ts timestamp_ntz, op string"), ["id"])
    want = rows(store.read("log"))
    assert store.state()[1]["log"].gone is None
    assert want[(500, day(0))] == want[(2, day(7))] == want[(0, day(0))] == 1
    for n in (2, 3, 8, 9):
        run_batch(store, [LOG], day(n), 0)
        assert rows(store.read("log")) == want
    assert (500, day(0)) in rows(store.hot("log"))


def test_another_time_column_forces_a_rewrite(spark, store):
    df = spark.createDataFrame([(i, day(i), day(9 - i)) for i in range(10)],
                               "id int, ts timestamp_ntz, other timestamp_ntz")
    store.load({"log": df})
    run_batch(store, [LOG], day(1), 0)
    assert store.state()[1]["log"].gone is not None
    run_batch(store, [TablePolicy("log", "append_only", "other", ("id",))], day(3), 0)
    assert store.state()[1]["log"].gone is None
    assert rows(store.read("log")) == rows(df)
    # ids 0 and 1 went by ts; of the rest, other lies after day 1 and up to day 3 for 6 and 7
    assert sorted(r.id for r in store.hot("log").collect()) == [2, 3, 4, 5, 8, 9]


def test_straggler_stays_readable(spark, store):
    store.load({"log": tables(spark)["log"]})
    run_batch(store, [LOG], day(5), 0)
    late = spark.createDataFrame([(1000, day(3))], "id int, ts timestamp_ntz")
    apply_batch(store, "log", late.withColumn("op", F.lit("insert")), ["id"])
    run_batch(store, [LOG], day(9), 0)
    assert (1000, day(3)) in rows(store.hot("log"))
    assert (1000, day(3)) in rows(store.read("log"))


@pytest.mark.parametrize("step", ["write_cold", "cold_batch", "write_hot", "commit"])
@pytest.mark.parametrize("after", [False, True])
def test_failure_at_any_step_is_invisible_and_retried(spark, store, monkeypatch, step, after):
    data = tables(spark)
    store.load(data)
    want = {n: rows(df) for n, df in data.items()}
    original = getattr(TierStore, step)

    def failing(self, *args, **kwargs):
        if after:
            original(self, *args, **kwargs)
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(TierStore, step, failing)
        with pytest.raises(RuntimeError, match="lost"):
            run_batch(store, POLICIES, day(5), 0)
    assert whole(store) == want
    published = step == "commit" and after
    assert store.state()[0] == (1 if published else 0)
    run_batch(store, POLICIES, day(5), 0)
    assert whole(store) == want
    assert rows(store.cold("log").drop(BATCH)) == Counter(
        {r: n for r, n in want["log"].items() if r[1] is not None and r[1] <= day(5)})


def test_remains_of_a_failed_batch_do_not_join_another(spark, store, monkeypatch):
    """The failed batch wrote all three tables; the next one with its number moves only one."""
    data = tables(spark)
    store.load(data)
    with monkeypatch.context() as patch:
        patch.setattr(TierStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_batch(store, POLICIES, day(5), 0)
    run_batch(store, [LOG], day(5), 0)
    run_batch(store, [LOG], day(6), 0)
    assert whole(store) == {n: rows(df) for n, df in data.items()}


def test_a_published_batch_cannot_be_published_again(spark, store):
    store.load(tables(spark))
    with pytest.raises(RuntimeError, match="already"):
        store.commit(0, list(store.state()[1].values()))


def test_skipped_policies_are_reported_and_keep_their_mark(spark, store):
    store.load(tables(spark))
    policies = [TablePolicy("log", "append_only", "ts", ("id",), enabled=False),
                TablePolicy("line", "weekly", "done", ("o", "n")),
                TablePolicy("nowhere", "append_only", "ts", ("id",))]
    report = run_batch(store, policies, day(5), 0)
    assert [r["skipped"] for r in report] == ["disabled", "unknown category 'weekly'",
                                              "unknown table"]
    assert store.state()[1]["log"].last_ts == EPOCH


def test_move_by_predicate_isolates_errors_and_keeps_nulls(spark, store):
    data = tables(spark)
    store.load(data)
    report = move_by_predicate(store, {"log": "ts >= TIMESTAMP_NTZ '2024-01-04 00:00:00'",
                                       "line": "no_such_column = 1", "absent": "true"})
    assert report["log"] == 28
    assert isinstance(report["line"], Exception) and isinstance(report["absent"], KeyError)
    assert whole(store) == {n: rows(df) for n, df in data.items()}
    assert (99, None) in rows(store.hot("log"))


def test_travel_through_commits(spark, store):
    data = tables(spark)
    store.load(data)
    run_rounds(store, POLICIES, [day(2), day(5)], 0)
    want = {n: rows(df) for n, df in data.items()}
    for batch in range(3):
        assert {n: rows(df) for n, df in store.tables(batch).items()} == want
    assert store.cold("log", as_of=0) is None
    assert store.cold("log", as_of=1).count() < store.cold("log").count()
    assert [r.moved for r in store.snapshots("log").orderBy("batch_id").collect()] == [0, 12, 12]


def test_zone_window_and_its_complement(spark):
    """Seoul is nine hours ahead; every row is on exactly one side."""
    df = spark.createDataFrame(
        [(i, DAY + timedelta(hours=i)) for i in range(72)] + [(-1, None)],
        "id int, ts timestamp_ntz")
    policy = TablePolicy("t", "append_only", "ts", ("id",), zone="Asia/Seoul")
    last, until = DAY, DAY + timedelta(days=1)
    inside = extract(policy, df, last, until)
    outside = migrate._remaining(policy, df, inside, last, until)
    assert sorted(r.id for r in inside.collect()) == list(range(10, 34))
    assert rows(inside) + rows(outside) == rows(df)


@pytest.mark.parametrize("zone", ["Asia/Seoul", "Europe/Berlin", "America/New_York"])
def test_complement_across_clock_changes(spark, zone):
    start = datetime(2024, 10, 20)
    df = spark.createDataFrame([(i, start + timedelta(minutes=30 * i)) for i in range(1000)],
                               "id int, ts timestamp_ntz")
    policy = TablePolicy("t", "append_only", "ts", ("id",), zone=zone)
    edges = [EPOCH] + [start + timedelta(days=7, hours=h) for h in (0, 1, 2)] + [
        datetime(2025, 1, 1)]
    seen = Counter()
    for last, until in zip(edges, edges[1:]):
        inside = extract(policy, df, last, until)
        seen += rows(inside)
        rest = migrate._remaining(policy, df, inside, last, until)
        assert rows(inside) + rows(rest) == rows(df)
    assert seen == rows(df)


def test_policy_frames(spark):
    base = policy_frame(spark, TPCC_POLICIES)
    changes = policy_frame(spark, [TablePolicy("hhistory", "append_only", "h_date", ("h_c_id",),
                                               enabled=False),
                                   TablePolicy("stock", "weekly", "x", ("s_i_id",))])
    after = upsert_policies(base, changes)
    assert after.count() == 4
    assert {r.relname for r in active_policies(after).collect()} == {"orders", "order_line"}
    assert {r.relname for r in rejected_policies(after).collect()} == {"stock"}
    unset = spark.createDataFrame([("t", "append_only", "ts", ["k"], None)], base.schema)
    assert active_policies(unset).count() == 1


def test_run_for_stops_at_the_budget():
    now = [0.0]
    rounds = run_for(lambda: None, 700, 120, clock=lambda: now[0],
                     sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert rounds == 6


def closing(spark, parents, settled):
    """Parents with two lines each, of which the first ones are done on their own day."""
    line = [(o, n, day(o + 1) if o < settled else None) for o in range(parents) for n in range(2)]
    return {"line": spark.createDataFrame(line, "o int, n int, done timestamp_ntz"),
            "ord": spark.createDataFrame([(o, f"c{o}") for o in range(parents)], "o int, c string")}


def test_closed_parents_are_noted_and_rewritten_once_half_have_gone(spark, store):
    data = closing(spark, 20, 15)
    store.load(data)
    want = rows(data["ord"])
    seen = []
    for n in (3, 6, 7, 12, 20):
        run_batch(store, [ORDER], day(n), 0)
        state = store.state()[1]["ord"]
        seen.append((state.hot_version, state.hot_rows, state.gone_rows, state.gone_keys is not None))
        assert rows(store.read("ord").select("o", "c")) == want
        assert store.hot("ord").count() == state.hot_rows - state.gone_rows
    assert seen == [(0, 20, 3, True), (0, 20, 6, True), (0, 20, 7, True), (4, 8, 0, False), (4, 8, 3, True)]
    for n in range(6):
        assert rows(store.read("ord", as_of=n).select("o", "c")) == want
    store.compact("ord")
    assert rows(store.read("ord").select("o", "c")) == want
    store.expire()
    assert rows(store.read("ord").select("o", "c")) == want


@pytest.mark.parametrize("layout", [None, Layout(("o",), 8)])
def test_a_moved_key_can_be_hot_again(spark, store, layout):
    data = closing(spark, 20, 4)
    store.load(data, layouts={"ord": layout} if layout else None)
    run_batch(store, [ORDER], day(30), 0)
    assert store.state()[1]["ord"].gone_keys is not None and store.hot("ord").count() == 16
    again = spark.createDataFrame([(2, "back", "insert"), (9, "new", "update")], "o int, c string, op string")
    apply_batch(store, "ord", again, ["o"])
    assert store.state()[1]["ord"].gone_keys is None
    got = rows(store.hot("ord"))
    assert got[(2, "back")] == got[(9, "new")] == 1 and sum(got.values()) == 17
    assert store.cold("ord").count() == 4


def test_a_failed_batch_of_closed_parents_hides_nothing(spark, store, monkeypatch):
    data = closing(spark, 20, 8)
    store.load(data)
    run_batch(store, [ORDER], day(3), 0)

    def failing(self, batch, states):
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(TierStore, "commit", failing)
        with pytest.raises(RuntimeError):
            run_batch(store, [ORDER], day(6), 0)
    assert store.hot("ord").count() == 17 and store.read("ord").count() == 20
    run_batch(store, [ORDER], day(6), 0)
    assert store.hot("ord").count() == 14 and rows(store.read("ord").select("o", "c")) == rows(data["ord"])
