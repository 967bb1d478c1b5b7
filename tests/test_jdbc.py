"""A database as the hot tier: Derby inside this process, in memory, without a port.

Only a local session can use it, as its tasks run in the same process; the registered queries
therefore do not.
"""

import uuid
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.operators.extract import CloseBy, TablePolicy
from tidemark.operators.tiers import BATCH
from tidemark.plans import migrate
from tidemark.plans.migrate import BATCH_DDL, WATERMARK_DDL, jdbc_hybrid, run_jdbc_batch
from tidemark.plans.store import TierStore
from tidemark.plans.workload import run_statements
from tidemark.sources.jdbc import JdbcHot
from tidemark.session import scratch
from tidemark.sources.lake import LakeCold

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
DAY = datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(days=n)


@pytest.fixture
def hot(spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty(
        "derby.stream.error.file", str(tmp_path / "derby.log"))
    db = JdbcHot(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", DERBY)
    with db.transaction() as tx:
        tx.execute(WATERMARK_DDL)
        tx.execute(BATCH_DDL)
    return db


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_agree(spark, hot, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    hot.write(orders, "orders")
    want = rows(orders)
    assert rows(hot.table("orders")) == want
    assert rows(hot.query('SELECT * FROM orders WHERE "o_orderkey" < 10')) == rows(
        orders.where("o_orderkey < 10"))
    parallel = hot.parallel("orders", "o_orderkey", 4)
    assert parallel.rdd.getNumPartitions() == 4 and rows(parallel) == want
    split = hot.by_predicates("orders", [f'MOD("o_orderkey", 3) = {i}' for i in range(3)])
    assert split.rdd.getNumPartitions() == 3 and rows(split) == want


def test_parallel_scan_of_an_empty_table(spark, hot):
    hot.write(spark.createDataFrame([], "k int"), "nothing")
    assert hot.parallel("nothing", "k", 4).count() == 0


def test_catalog_scan_pushes_the_work_down(spark, hot):
    hot.write(spark.range(100).selectExpr("id AS k", "id % 7 AS g"), "numbers")
    name = f"hot_{uuid.uuid4().hex[:8]}"
    hot.attach(name)
    spark.conf.set(f"spark.sql.catalog.{name}.pushDownAggregate", "true")
    df = spark.sql(f"SELECT COUNT(*) AS n FROM {name}.APP.NUMBERS WHERE k >= 50")
    assert df.first().n == 50
    assert "PushedAggregates: [COUNT(*)]" in plan(df) or "PushedFilters: [k" in plan(df)
    assert "NUMBERS" in {r.tableName for r in spark.sql(f"SHOW TABLES IN {name}.APP").collect()}


def test_introspection(hot):
    with hot.transaction() as tx:
        tx.execute("CREATE SCHEMA information_schema")
        tx.execute("CREATE TABLE information_schema.columns (table_schema VARCHAR(20), "
                   "table_name VARCHAR(20), column_name VARCHAR(20), data_type VARCHAR(40), "
                   "ordinal_position INT)")
        tx.execute("CREATE TABLE information_schema.tables (table_schema VARCHAR(20), "
                   "table_name VARCHAR(20))")
        tx.execute("INSERT INTO information_schema.tables VALUES ('public', 't'), ('x', 'u')")
        for name, kind, place in (("b", "text", 2), ("a", "bigint", 1)):
            tx.execute("INSERT INTO information_schema.columns VALUES ('public', 't', ?, ?, ?)",
                       [name, kind, place])
    assert [tuple(r) for r in hot.columns("t").collect()] == [("a", "bigint"), ("b", "text")]
    assert [r[0] for r in hot.tables().collect()] == ["t"]


LINE = TablePolicy("line", "update_once", "done", ("o", "n"))
ORDER = TablePolicy("ord", "update_once", "done", ("o",),
                    close_by=CloseBy("line", (("o", "o"),), "done"))


@pytest.fixture
def loaded(spark, hot):
    lines = [(o, n, day(d)) for o, days in enumerate([[1, 2], [1, 6], [None, 3], [None], [8, 8]])
             for n, d in enumerate(days)]
    hot.write(spark.createDataFrame(lines, "o int, n int, done timestamp_ntz"), "line")
    hot.write(spark.createDataFrame([(o,) for o in range(6)], "o int"), "ord")
    return hot


def cold_table(spark, store, name, schema):
    from tidemark.sources.files import try_read
    return try_read(spark, store.cold_path(name)) if schema is None else try_read(
        spark, store.cold_path(name), schema)


def whole(spark, hot, store):
    out = {}
    for policy in (LINE, ORDER):
        schema = hot.table(policy.relname).schema.add(BATCH, "long")
        cold = cold_table(spark, store, policy.relname, schema)
        out[policy.relname] = rows(jdbc_hybrid(hot, cold, policy.relname, policy.pk_columns))
    return out


def test_batches_move_rows_and_keep_them_readable(spark, loaded, store):
    want = whole(spark, loaded, store)
    moved = []
    for moment in (day(2), day(5), day(9)):
        report = run_jdbc_batch(loaded, store, [ORDER, LINE], moment, 0,
                                read=lambda t: loaded.parallel(t, "o", 2))
        moved.append([r["moved"] for r in report])
        assert whole(spark, loaded, store) == want
    assert moved == [[1, 3], [1, 1], [2, 3]]
    assert rows(loaded.table("line")) == Counter([(2, 0, None), (3, 0, None)])
    marks = migrate.jdbc_watermarks(loaded)
    assert marks["line"] == (day(9), 2)


@pytest.mark.parametrize("step", ["write_cold", "stage_keys", "delete_statement", "_advance"])
def test_failure_at_any_step_loses_and_repeats_nothing(spark, loaded, store, monkeypatch, step):
    want = whole(spark, loaded, store)
    run_jdbc_batch(loaded, store, [ORDER, LINE], day(2), 0)
    owner = {"write_cold": TierStore, "_advance": migrate}.get(step, JdbcHot)
    original = getattr(owner, step)

    def failing(*args, **kwargs):
        original(*args, **kwargs)
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(owner, step, failing)
        with pytest.raises(RuntimeError, match="lost"):
            run_jdbc_batch(loaded, store, [ORDER, LINE], day(7), 0)
    assert whole(spark, loaded, store) == want
    run_jdbc_batch(loaded, store, [ORDER, LINE], day(7), 0)
    assert whole(spark, loaded, store) == want
    assert migrate.jdbc_watermarks(loaded)["ord"] == (day(7), 1)


def test_window_reaches_the_database(loaded):
    from tidemark.operators.extract import extract
    text = plan(extract(LINE, loaded.table("line"), day(1), day(2)))
    assert "PushedFilters: [*IsNotNull(done), *GreaterThan(done" in text


def test_hybrid_filter_reaches_both_tiers(spark, loaded, store):
    run_jdbc_batch(loaded, store, [LINE], day(5), 0)
    cold = cold_table(spark, store, "line", loaded.table("line").schema.add(BATCH, "long"))
    text = plan(jdbc_hybrid(loaded, cold, "line", LINE.pk_columns).where("o > 2").select("n"))
    assert "GreaterThan(o,2)" in text.split("JDBCRelation")[-1]
    assert "PushedFilters: [IsNotNull(o), GreaterThan(o,2)]" in text


def test_statement_batch(spark, loaded):
    loaded.table("line").createOrReplaceTempView("line_view")
    report = run_statements(spark, loaded, [
        ["INSERT INTO ord VALUES (?)", [77]],
        ['UPDATE ord SET "o" = "o" + 100 WHERE "o" > ? AND "o" < 50', [3]],
        ['DELETE FROM ord WHERE "o" IN (?, ?)', [0, 1]],
        ['SELECT "o" FROM ord WHERE "o" = ? FOR UPDATE', [2]],
        ["SELECT o, COUNT(*) AS n FROM line_view WHERE n < ? GROUP BY o", [5]],
    ])
    assert report == {"status": "ok", "executed": 4, "results": [
        {"index": 0, "type": "write", "affected": 1},
        {"index": 1, "type": "write", "affected": 2},
        {"index": 2, "type": "write", "affected": 2},
        {"index": 4, "type": "olap", "rows": 5}]}
    assert sorted(r.o for r in loaded.table("ord").collect()) == [2, 3, 77, 104, 105]


@pytest.mark.parametrize("bad", [
    ["INSERT INTO nowhere VALUES (1)", []], ["SELECT * FROM view_nowhere", []],
    ["GRANT x", []], ["INSERT INTO ord VALUES (?)", []], ["SELECT 1"]])
def test_a_bad_statement_undoes_the_batch(spark, loaded, bad):
    before = rows(loaded.table("ord"))
    report = run_statements(spark, loaded, [["DELETE FROM ord", []], bad])
    assert report["status"] == "error" and report["message"]
    assert rows(loaded.table("ord")) == before


def test_lake_table_append_and_batch_read(spark, hot):
    """The catalogue calls of the lake variant, on the one V2 catalogue at hand."""
    hot.write(spark.createDataFrame([(1, 0)], f"K int, {BATCH} long"), "cold_t")
    name = f"lake_{uuid.uuid4().hex[:8]}"
    hot.attach(name)
    lake = LakeCold(spark, f"{name}.APP")
    assert lake.name("public.orders") == f"{name}.APP.public_orders"
    lake.append("COLD_T", spark.createDataFrame([(2, 1), (3, 1)], f"K int, {BATCH} long"))
    assert rows(lake.read("COLD_T").select("K")) == Counter([(1,), (2,), (3,)])
    schema = spark.createDataFrame([], "K int").schema
    assert rows(lake.cold_batch("COLD_T", 1, schema)) == Counter([(2,), (3,)])


def test_closed_parents_are_found_by_the_database(loaded):
    got = loaded.closed_parents("ord", "line", [("o", "o")], "done", day(1), day(6))
    assert sorted(r.o for r in got.collect()) == [0, 1, 2]
    assert "GROUP BY" in plan(got)


def test_a_key_that_gains_a_row_meanwhile_is_not_deleted(spark, hot, store, monkeypatch):
    """Two equal keys are copied; a third arrives between reading and deleting."""
    policy = TablePolicy("hist", "append_only", "ts", ("c",), unique=False)
    frame = lambda *v: spark.createDataFrame([(1, day(1), x) for x in v], "c int, ts timestamp_ntz, v int")
    hot.write(frame(1, 2), "hist")
    original = JdbcHot.stage_keys

    def late(self, *args):
        original(self, *args)
        hot.write(frame(3), "hist")
    with monkeypatch.context() as patch:
        patch.setattr(JdbcHot, "stage_keys", late)
        with pytest.raises(RuntimeError, match="run again"):
            run_jdbc_batch(hot, store, [policy], day(2), 0)
    assert hot.table("hist").count() == 3
    run_jdbc_batch(hot, store, [policy], day(2), 0)
    assert hot.table("hist").count() == 0
    cold = cold_table(spark, store, "hist", hot.table("hist").schema.add(BATCH, "long"))
    assert sorted(r.v for r in jdbc_hybrid(hot, cold, "hist", ("c", "v")).collect()) == [1, 2, 3]


def test_a_retry_that_leaves_a_table_out(spark, loaded, store, monkeypatch):
    want = whole(spark, loaded, store)
    with monkeypatch.context() as patch:
        patch.setattr(JdbcHot, "delete_statement", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            run_jdbc_batch(loaded, store, [ORDER, LINE], day(5), 0)
    run_jdbc_batch(loaded, store, [ORDER], day(5), 0)
    run_jdbc_batch(loaded, store, [ORDER, LINE], day(9), 0)
    assert whole(spark, loaded, store) == want


def test_cold_tables_for_every_hot_table(spark, hot):
    from tidemark.sources.lake import create_all

    with hot.transaction() as tx:
        tx.execute("CREATE SCHEMA information_schema")
        tx.execute('CREATE TABLE information_schema.columns (table_schema VARCHAR(20), table_name '
                   'VARCHAR(20), column_name VARCHAR(20), data_type VARCHAR(40), ordinal_position INT)')
        tx.execute("CREATE TABLE information_schema.tables (table_schema VARCHAR(20), "
                   "table_name VARCHAR(20))")
        tx.execute("INSERT INTO information_schema.tables VALUES ('public', 'h1'), ('public', 'h2'), "
                   "('other', 'h3')")
        for row in (["h1", "b", "numeric(10,2)", 2], ["h1", "a", "bigint", 1], ["h2", "u", "uuid", 1]):
            tx.execute("INSERT INTO information_schema.columns VALUES ('public', ?, ?, ?, ?)", row)
    database = f"cold_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {database}")
    made = create_all(spark, hot, scratch(spark, "all"), database=database)
    assert sorted(made) == [f"{database}.h1", f"{database}.h2"]
    assert spark.table(f"{database}.h1").dtypes == [("a", "bigint"), ("b", "decimal(10,2)")]
    assert spark.table(f"{database}.h2").dtypes == [("u", "string")]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_splits_of_equal_depth(spark, hot):
    """A third of the rows in a hundredth of the range: equal widths pile them up, quantiles do not."""
    from pyspark.sql import functions as F
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") / 100).otherwise(
        F.col("id")).cast("double").alias("k"), F.col("id").alias("v"))
    hot.write(df, "skewed")
    sizes = [len(p) for p in hot.balanced("skewed", "k", 8).rdd.glom().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 3000 / 8
    assert rows(hot.balanced("skewed", "k", 8)) == rows(df)
    assert max(len(p) for p in hot.parallel("skewed", "k", 8).rdd.glom().collect()) > 2 * 3000 / 8
    hot.write(df.where("false"), "nothing_skewed")
    assert hot.balanced("nothing_skewed", "k", 4).count() == 0


def test_the_database_picks_the_rows_of_staged_keys(spark, hot):
    orders = spark.range(1000).selectExpr("id AS o", "id % 50 AS c")
    hot.write(orders, "ord2")
    some = spark.createDataFrame([(7,), (7,), (9,), (None,), (1234,)], "c long")
    found = hot.matching("ord2", some, ["c"], "staging_some")
    # what is fetched is what matches
    assert rows(found) == rows(orders.where("c IN (7, 9)")) and found.count() == 40
    assert hot.matching("ord2", some, ["c"], "staging_some", limit=2).count() == 1000
    two = spark.createDataFrame([(7, 7), (8, 9)], "o long, c long")
    assert rows(hot.matching("ord2", two, ["o", "c"], "staging_two")) == Counter([(7, 7)])


def test_very_many_noted_batches_in_a_constant_plan(spark, loaded, store):
    want = whole(spark, loaded, store)
    run_jdbc_batch(loaded, store, [LINE], day(5), 0)
    cold = cold_table(spark, store, "line", loaded.table("line").schema.add(BATCH, "long"))
    short = len(plan(jdbc_hybrid(loaded, cold, "line", LINE.pk_columns)))
    loaded.write(spark.range(1, 10_000).selectExpr("'line' AS relname", "id AS batch_id"), "noted_batches")
    with loaded.transaction() as tx:
        tx.execute('INSERT INTO sync_batch SELECT "relname", "batch_id" FROM noted_batches')
    read = jdbc_hybrid(loaded, cold, "line", LINE.pk_columns)
    assert len(plan(read)) < 1.2 * short and rows(read) == want["line"]


def test_deletes_go_children_first(spark, hot, store):
    """The database enforces the reference; parents first would be refused."""
    from tidemark.operators.references import ForeignKey
    with hot.transaction() as tx:
        tx.execute('CREATE TABLE ord ("o" INT PRIMARY KEY, "done" TIMESTAMP)')
        tx.execute('CREATE TABLE line ("o" INT REFERENCES ord ("o"), "n" INT, "done" TIMESTAMP)')
        for o in range(4):
            tx.execute("INSERT INTO ord VALUES (?, CAST(? AS TIMESTAMP))", [o, str(day(o))])
            tx.execute("INSERT INTO line VALUES (?, 1, CAST(? AS TIMESTAMP))", [o, str(day(o))])
    policies = [TablePolicy("ord", "append_only", "done", ("o",)), LINE]
    with pytest.raises(Exception):
        run_jdbc_batch(hot, store, policies, day(1), 0)
    run_jdbc_batch(hot, store, policies, day(1), 0,
                   references=[ForeignKey("line", ("o",), "ord", ("o",))])
    assert sorted(r.o for r in hot.table("ord").collect()) == [2, 3]
    assert sorted(r.o for r in hot.table("line").collect()) == [2, 3]


def test_large_tables_are_read_side_by_side(spark, hot):
    hot.write(spark.range(1000).selectExpr("id AS k", "CAST(id AS STRING) AS s"), "wide_table")
    split = hot.scan("wide_table", "k", rows_per_task=300)
    assert split.rdd.getNumPartitions() == 4 and rows(split) == rows(hot.table("wide_table"))
    for small in (hot.scan("wide_table", "k"), hot.scan("wide_table"), hot.scan("wide_table", "s", 300)):
        assert small.rdd.getNumPartitions() == 1 and small.count() == 1000
