"""Extraction rules, policies, watermarks and migration batches."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import EPOCH, cutoff, in_window, iso_text, ntz
from tidemark.operators.extract import (
    TPCC_POLICIES,
    CloseBy,
    TablePolicy,
    active_policies,
    extract,
    policy_frame,
    upsert_policies,
    with_watermark,
)
from tidemark.operators.keyed import delete_using, key_rows, keyed_upsert, orphans
from tidemark.operators.tiers import BATCH, hybrid
from tidemark.plans.changes import apply_batch
from tidemark.operators.references import ForeignKey
from tidemark.plans.migrate import move_by_predicate, move_with_children, run_batch, tier_counts
from tidemark.queries.staging import (
    MOVED_SQL,
    ROUNDS,
    TPCC_MOVED,
    TPCC_SQL,
    analytic_store,
    given,
    money,
    staged,
    tpcc_frames,
    tpcc_store,
)
from tidemark.schemas import CH_COLD
from tidemark.session import scratch
from tidemark.streaming.rounds import run_stream

LAST, UNTIL = datetime(1998, 1, 1), datetime(1999, 1, 1)


def extract_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = TablePolicy("events", "append_only", "ts", ("event_id",))
    rows = extract(policy, given(spark, sf_dir, "events"), EPOCH, datetime(2024, 1, 15))
    return rows.select("event_id", "user_id", "event_type", "value")


def extract_update_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered lines of the window; undelivered ones have no timestamp and stay."""
    lines = given(spark, sf_dir, "lineitem").withColumn(
        "delivered", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")))
    policy = TablePolicy("lineitem", "update_once", "delivered", ("l_orderkey", "l_linenumber"))
    return extract(policy, lines, LAST, UNTIL).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def extract_closed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose last delivered line lies in the window."""
    lines = given(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    policy = TablePolicy("orders", "update_once", "o_orderdate", ("o_orderkey",),
                         close_by=CloseBy("lineitem", (("o_orderkey", "l_orderkey"),),
                                          "l_shipdate"))
    return extract(policy, given(spark, sf_dir, "orders"), LAST, UNTIL, lines).select(
        "o_orderkey", "o_custkey", "o_totalprice")


def extract_zone_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times against a UTC window."""
    return given(spark, sf_dir, "events").where(
        in_window(F.col("ts"), datetime(2024, 1, 5), datetime(2024, 1, 6), "Asia/Seoul")
    ).select("event_id", "user_id", "value")


# Policy rows to insert or replace, one disabled and one of an unknown category.
_POLICY_CHANGES = [
    replace(TPCC_POLICIES[2], enabled=False),
    TablePolicy("customer", "weekly", "c_since", ("c_w_id", "c_d_id", "c_id")),
]


def _policies(spark: SparkSession) -> DataFrame:
    return upsert_policies(policy_frame(spark, TPCC_POLICIES), policy_frame(spark, _POLICY_CHANGES))


def _row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("relname"), "rows")
        out = part if out is None else out.unionAll(part)
    return out


def policy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy after the upsert, with the rows of the table it governs."""
    rows = _row_counts(tpcc_frames(spark, sf_dir, *TPCC_MOVED, "customer"))
    return _policies(spark).join(rows, "relname").select(
        "relname", "category", "ts_column", F.concat_ws(",", "pk_columns").alias("pk"),
        "enabled", "rows")


def policy_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that a batch would run, with the rows it would move."""
    frames = tpcc_frames(spark, sf_dir, *TPCC_MOVED)
    until = cutoff(ROUNDS[1], 1)
    due = _row_counts({
        p.relname: extract(p, frames[p.relname], EPOCH, until,
                           frames[p.close_by.child] if p.close_by else None)
        for p in TPCC_POLICIES})
    return active_policies(_policies(spark)).join(due, "relname").select(
        "relname", "category", F.col("rows").alias("due"))


def watermark_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with their marks; customer was never moved, so its mark is the epoch."""
    store = tpcc_store(spark, sf_dir)
    marks = with_watermark(_policies(spark), store.watermarks())
    rows = _row_counts({n: cold for n, (_, cold) in store.tiers(*TPCC_MOVED).items()})
    return marks.join(rows, "relname", "left").select(
        "relname", iso_text(F.col("last_ts")).alias("last_ts"),
        F.coalesce("rows", F.lit(0)).alias("cold_rows"))


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks after each round, with the rows the round moved."""
    store = tpcc_store(spark, sf_dir)
    return store.log().where("batch_id > 0").groupBy(
        iso_text(F.col("last_ts")).alias("last_ts")).agg(
        F.count(F.lit(1)).alias("tables"), F.sum("moved").alias("moved"))


def pk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_rows(given(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def delete_using_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after those of all pending orders are deleted by staged keys."""
    keys = given(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return delete_using(given(spark, sf_dir, "lineitem"), keys, ["l_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _where_rows_are(store, names) -> DataFrame:
    """``relname, batch, n, total`` of the rows in each tier; batch NULL is hot."""
    value = {"orders": "o_c_id", "order_line": "ol_amount", "hhistory": "h_amount"}
    out = None
    for name, (hot, cold) in store.tiers(*names).items():
        for df, batch in ((hot, F.lit(None).cast("long")), (cold, F.col(BATCH))):
            if df is None:
                continue
            part = df.select(F.lit(name).alias("relname"), batch.alias("batch"),
                             F.col(value[name]).cast("decimal(18,2)").alias("v"))
            out = part if out is None else out.unionAll(part)
    return out.groupBy("relname", "batch").agg(F.count(F.lit(1)).alias("n"), money("v", "total"))


def migrate_batch_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold rows of one batch over all three policies."""
    return _where_rows_are(_one_batch(spark, sf_dir), TPCC_MOVED).where("batch IS NOT NULL")


def migrate_batch_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the batch left hot."""
    return _where_rows_are(_one_batch(spark, sf_dir), TPCC_MOVED).where(
        "batch IS NULL").drop("batch")


def _one_batch(spark: SparkSession, sf_dir: str):
    def build(store) -> None:
        store.load(tpcc_frames(spark, sf_dir, *TPCC_MOVED))
        run_batch(store, TPCC_POLICIES, ROUNDS[0])
    return staged(spark, sf_dir, "tpcc-one-batch", build)


def migrate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table and batch after three rounds that a stream of ticks drives, with a restart
    after the first; batch 0 stands for hot."""
    def build(store) -> None:
        store.load(tpcc_frames(spark, sf_dir, *TPCC_MOVED))
        source, checkpoint = scratch(spark, "ticks"), scratch(spark, "rounds")
        for ticks in (ROUNDS[:1], ROUNDS[1:]):
            for at in ticks:
                spark.range(1).select(ntz(at).alias("at")).write.mode("append").parquet(source)
            stream = spark.readStream.schema("at timestamp_ntz").option("maxFilesPerTrigger", 1)
            run_stream(stream.parquet(source), store, TPCC_POLICIES, checkpoint).awaitTermination()
    store = staged(spark, sf_dir, "tpcc-stream-rounds", build)
    return _where_rows_are(store, TPCC_MOVED).fillna(0, ["batch"])


# Customers, their orders, and the orders' lines.
REFERENCES = (ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
              ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)))


def move_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers move with their orders, and early orders, all with their lines: rows by tier, and hot
    rows whose parent is not hot."""
    def build(store) -> None:
        store.load({n: given(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")})
        move_with_children(store, {"customer": "c_custkey > 100", "orders":
                                   "o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'"}, REFERENCES)
    store = staged(spark, sf_dir, "references", build)
    tiers = store.tiers("customer", "orders", "lineitem")
    lost = {r.child: orphans(tiers[r.child][0], tiers[r.parent][0], r.columns, r.parent_columns)
            for r in REFERENCES}
    out = None
    for name, (hot, cold) in tiers.items():
        for tier, df in (("hot", hot), ("cold", cold), ("orphan", lost.get(name))):
            if df is not None:
                part = df.agg(F.count(F.lit(1)).alias("n")).select(
                    F.lit(name).alias("relname"), F.lit(tier).alias("tier"), "n")
                out = part if out is None else out.unionAll(part)
    return out


def move_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-shot move: which tier each row is in afterwards."""
    def build(store) -> None:
        store.load({n: given(spark, sf_dir, n) for n in CH_COLD})
        move_by_predicate(store, CH_COLD)
    store = staged(spark, sf_dir, "one-shot", build)
    keys = {"customer": "c_custkey", "lineitem": "l_orderkey", "orders": "o_orderkey",
            "part": "p_partkey"}
    out = None
    for name, tiers in store.tiers(*keys).items():
        for tier, df in zip(("hot", "cold"), tiers):
            part = df.select(F.lit(name).alias("relname"), F.lit(tier).alias("tier"),
                             F.col(keys[name]).cast("decimal(18,0)").alias("k"))
            out = part if out is None else out.unionAll(part)
    return out.groupBy("relname", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").cast("double").alias("key_sum"))


def tier_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over both tiers after three rounds, which must be all there were."""
    counts = tier_counts(tpcc_store(spark, sf_dir), list(TPCC_MOVED))
    return counts.groupBy("relname").agg(F.sum("rows").alias("rows"))


def keyed_upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are replaced, repeat orders of high priority come in under new keys."""
    orders = given(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    replaced = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("X"))
    added = orders.where("o_orderpriority = '2-HIGH'").withColumn(
        "o_orderkey", -F.col("o_orderkey") - 1)
    return keyed_upsert(orders, replaced.unionAll(added), ["o_orderkey"])


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot orders without a customer: in the hot tier alone, and over both tiers."""
    store = analytic_store(spark, sf_dir)
    tiers = store.tiers("orders", "customer")
    child, (hot, cold) = tiers["orders"][0], tiers["customer"]
    parts = [
        orphans(child, parent, "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("orphans"))
        .select(F.lit(label).alias("parents"), "orphans")
        for label, parent in (("hot", hot), ("hybrid", hybrid(hot, cold)))]
    return parts[0].unionAll(parts[1])


def straggler_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events arrive only after their window was moved: those up to the watermark stay hot."""
    def build(store) -> None:
        events = given(spark, sf_dir, "events")
        late = F.col("event_type") == "error"
        store.load({"events": events.where(~late)})
        run_batch(store, [TablePolicy("events", "append_only", "ts", ("event_id",))],
                  datetime(2024, 1, 15), 0)
        apply_batch(store, "events", events.where(late).withColumn("op", F.lit("insert")),
                    ["event_id"])
    store = staged(spark, sf_dir, "late-events", build)
    return store.stragglers("events", "ts").select("event_id", "user_id", "value")


def iso_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").select("event_id", iso_text(F.col("ts")).alias("ts_text"))


QUERIES = {f.__name__: f for f in (
    extract_append_only, extract_update_once, extract_closed_parents, extract_zone_window,
    policy_upsert, policy_active, watermark_lookup, watermark_advance, pk_distinct,
    delete_using_keys, migrate_batch_cold, migrate_batch_hot, migrate_rounds, move_references, tier_conservation,
    orphan_check)} | {
    "move_by_predicate": move_predicate, "keyed_upsert": keyed_upsert_orders,
    "stragglers": straggler_rows, "iso_text": iso_text_events}

_WHERE_SQL = f"WITH {TPCC_SQL}, {MOVED_SQL} "
_KEYS = {"customer": "c_custkey", "lineitem": "l_orderkey", "orders": "o_orderkey",
         "part": "p_partkey"}
_MARK = {1: "1998-01-01", 2: "1999-01-01", 3: "2024-01-15"}

ORACLES = {
    "extract_append_only": "SELECT event_id, user_id, event_type, value FROM events "
                           "WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'",
    "extract_update_once": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                           "l_extendedprice FROM lineitem WHERE l_linestatus = 'F' "
                           "AND l_shipdate > TIMESTAMP '1998-01-01 00:00:00' "
                           "AND l_shipdate <= TIMESTAMP '1999-01-01 00:00:00'",
    "extract_closed_parents": """
        SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o JOIN (
          SELECT l_orderkey AS o_orderkey, MAX(l_shipdate) AS closed_at
          FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) x USING (o_orderkey)
        WHERE x.closed_at > TIMESTAMP '1998-01-01 00:00:00'
          AND x.closed_at <= TIMESTAMP '1999-01-01 00:00:00'""",
    "extract_zone_window": "SELECT event_id, user_id, value FROM events WHERE "
                           "ts - INTERVAL 9 HOUR > TIMESTAMP '2024-01-05 00:00:00' AND "
                           "ts - INTERVAL 9 HOUR <= TIMESTAMP '2024-01-06 00:00:00'",
    "policy_upsert": """
        SELECT 'orders' AS relname, 'update_once' AS category, 'o_entry_d' AS ts_column,
               'o_w_id,o_d_id,o_id' AS pk, TRUE AS enabled, COUNT(*) AS rows FROM orders
        UNION ALL SELECT 'order_line', 'update_once', 'ol_delivery_d',
               'ol_w_id,ol_d_id,ol_o_id,ol_number', TRUE, COUNT(*) FROM lineitem
        UNION ALL SELECT 'hhistory', 'append_only', 'h_date',
               'h_c_id,h_c_d_id,h_c_w_id,h_date', FALSE, COUNT(*) FROM events
        UNION ALL SELECT 'customer', 'weekly', 'c_since', 'c_w_id,c_d_id,c_id', TRUE, COUNT(*)
        FROM customer""",
    "policy_active": f"""
        WITH {TPCC_SQL}
        SELECT 'orders' AS relname, 'update_once' AS category, COUNT(*) AS due FROM placed
        WHERE closed_at <= TIMESTAMP '1999-01-01 00:00:00'
        UNION ALL SELECT 'order_line', 'update_once', COUNT(*) FROM order_line
        WHERE delivered_utc <= TIMESTAMP '1999-01-01 00:00:00'""",
    "watermark_lookup": _WHERE_SQL + """
        SELECT relname, '2024-01-15 00:00:00.000000' AS last_ts, COUNT(batch) AS cold_rows
        FROM moved GROUP BY relname
        UNION ALL SELECT 'customer', '1970-01-01 00:00:00.000000', 0""",
    "watermark_advance": _WHERE_SQL + " UNION ALL ".join(
        f"SELECT '{day} 00:00:00.000000' AS last_ts, 3 AS tables, COUNT(*) AS moved FROM moved "
        f"WHERE batch = {batch}" for batch, day in _MARK.items()),
    "pk_distinct": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem",
    "delete_using_keys": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice "
                         "FROM lineitem WHERE l_orderkey NOT IN "
                         "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "migrate_batch_cold": _WHERE_SQL + "SELECT relname, batch, COUNT(*) AS n, CAST(SUM(v) AS "
                                       "DOUBLE) AS total FROM moved WHERE batch = 1 GROUP BY ALL",
    "migrate_batch_hot": _WHERE_SQL + "SELECT relname, COUNT(*) AS n, CAST(SUM(v) AS DOUBLE) AS "
                                      "total FROM moved WHERE COALESCE(batch, 0) <> 1 "
                                      "GROUP BY ALL",
    "migrate_rounds": _WHERE_SQL + "SELECT relname, COALESCE(batch, 0) AS batch, COUNT(*) AS n, "
                                   "CAST(SUM(v) AS DOUBLE) AS total FROM moved GROUP BY ALL",
    "move_by_predicate": " UNION ALL ".join(
        f"SELECT '{t}' AS relname, CASE WHEN {k} > 100 THEN 'cold' ELSE 'hot' END AS tier, "
        f"COUNT(*) AS n, CAST(SUM(CAST({k} AS DECIMAL(18,0))) AS DOUBLE) AS key_sum "
        f"FROM {t} GROUP BY 1, 2" for t, k in _KEYS.items()),
    "move_references": """
        WITH c AS (SELECT c_custkey AS k, c_custkey > 100 AS goes FROM customer),
        o AS (SELECT o_orderkey AS k, o_custkey AS p, (o_orderdate < TIMESTAMP '1996-01-01 00:00:00'
                OR COALESCE(c.goes, FALSE)) AS goes FROM orders LEFT JOIN c ON c.k = o_custkey),
        l AS (SELECT l_orderkey AS p, COALESCE(o.goes, FALSE) AS goes
              FROM lineitem LEFT JOIN o ON o.k = l_orderkey),
        t AS (SELECT 'customer' AS relname, goes FROM c UNION ALL SELECT 'orders', goes FROM o
              UNION ALL SELECT 'lineitem', goes FROM l)
        SELECT relname, CASE WHEN goes THEN 'cold' ELSE 'hot' END AS tier, COUNT(*) AS n
        FROM t GROUP BY ALL
        UNION ALL SELECT 'orders', 'orphan', COUNT(*) FROM o
        WHERE NOT goes AND p NOT IN (SELECT k FROM c WHERE NOT goes)
        UNION ALL SELECT 'lineitem', 'orphan', COUNT(*) FROM l
        WHERE NOT goes AND p NOT IN (SELECT k FROM o WHERE NOT goes)""",
    "tier_conservation": "SELECT 'orders' AS relname, COUNT(*) AS rows FROM orders "
                         "UNION ALL SELECT 'order_line', COUNT(*) FROM lineitem "
                         "UNION ALL SELECT 'hhistory', COUNT(*) FROM events",
    "keyed_upsert": """
        SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END
               AS o_orderstatus, o_totalprice, o_orderpriority FROM orders
        UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice, o_orderpriority
        FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "orphan_check": "SELECT 'hot' AS parents, COUNT(*) AS orphans FROM orders "
                    "WHERE o_orderkey <= 100 AND o_custkey > 100 "
                    "UNION ALL SELECT 'hybrid', COUNT(*) FROM orders WHERE o_orderkey <= 100 "
                    "AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "stragglers": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' "
                  "AND ts <= TIMESTAMP '2024-01-15 00:00:00'",
    "iso_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events",
}
