"""Change records to lake tables, exactly once."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.keyed import row_digest
from tidemark.plans.store import Layout, TableState, TierStore, is_bulk
from tidemark.session import in_parallel
from tidemark.sources.feed import decode_each

REJECTS = "rejects"
RECORD_TIME = "record_timestamp"


@dataclass(frozen=True)
class Route:
    """Records of ``topic`` become rows of ``table``. With ``keys`` a record is stored only if it
    differs from the last one of its key, so that polls may emit everything again and again."""

    topic: str
    table: str
    schema: T.StructType
    keys: tuple[str, ...] = ()


def _table_schema(route: Route) -> T.StructType:
    return T.StructType(
        route.schema.fields + [T.StructField(RECORD_TIME, T.TimestampNTZType())])


def latest_table(table: str) -> str:
    """Where the time and the digest of each key's last record are kept."""
    return f"{table}_latest"


def _latest_schema(route: Route) -> T.StructType:
    keys = [route.schema[k] for k in route.keys]
    return T.StructType([*keys, T.StructField(RECORD_TIME, T.TimestampNTZType()),
                         T.StructField("_d1", T.LongType()), T.StructField("_d2", T.LongType())])


def changed_records(rows: DataFrame, latest: DataFrame, keys: Sequence[str],
                    columns: Sequence[str]) -> DataFrame:
    """The rows that differ from the one before them of their key, in order of time, beginning with
    the key's last row of earlier batches in ``latest``; ``_first`` marks a key that is new. A row
    older than that last one stays as well, since what came before it is not known any more."""
    d1, d2 = row_digest(columns)
    digests = [*keys, RECORD_TIME, "_d1", "_d2"]
    new = rows.select("*", d1.alias("_d1"), d2.alias("_d2"), F.lit(1).alias("_new"))
    both = new.unionByName(latest.select(*digests, F.lit(0).alias("_new")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(RECORD_TIME).asc_nulls_first(), "_new", "_d1", "_d2")
    before = F.lag(F.struct("_d1", "_d2")).over(order)
    known = F.max(F.col("_new") == 0).over(Window.partitionBy(*keys))
    marked = both.withColumn("_before", before).withColumn("_first", F.col("_before").isNull() & ~known)
    same = F.coalesce(F.col("_before") == F.struct("_d1", "_d2"), F.lit(False))
    return marked.where((F.col("_new") == 1) & ~same).drop("_new", "_before")


_REJECT_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was made."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def ingest(stream: DataFrame, store: TierStore, routes: Sequence[Route], checkpoint: str,
           every: str | None = None) -> StreamingQuery:
    """Start the stream: each micro-batch becomes one commit of ``store``.

    Without ``every`` all available records are taken and the query ends; with it a micro-batch
    starts at that interval. Give the stream a rate limit (files or offsets per trigger), as a
    micro-batch is held while it is stored. A commit notes the stream, by the id that its
    checkpoint keeps, and the number of the micro-batch: one that is run again after a failure is
    passed over if just it was published, whatever else has been committed since. Records that fit
    no route or do not parse go to the table ``rejects``.

    Of a route with ``keys``, records that say nothing new are left out, across micro-batches and
    restarts: the digest of each key's last record is a table of the store in buckets by key, read
    and written where a micro-batch has keys, and committed with its rows.
    """
    schemas = {r.table: _table_schema(r) for r in routes} | {REJECTS: _REJECT_SCHEMA}
    keyed = {r.table: r for r in routes if r.keys}
    for route in routes:
        if route.table in keyed and route.keys != keyed[route.table].keys:
            raise ValueError(f"routes to {route.table} have different keys")
    kept_digests = {latest_table(n): _latest_schema(r) for n, r in keyed.items()}
    spark = stream.sparkSession
    known = store.state()[1]
    if new := {n: spark.createDataFrame([], s) for n, s in (schemas | kept_digests).items()
               if n not in known}:
        store.load(new, layouts={latest_table(n): Layout(r.keys) for n, r in keyed.items()})

    def write(records: DataFrame, epoch: int) -> None:
        last, states = store.state()
        batch, source = last + 1, stream_id(spark, checkpoint)
        if (states[REJECTS].epochs or {}).get(source) == epoch:
            return
        # one read of the source for all routes, and one parse of each record
        held = decode_each(records, [(r.topic, r.schema) for r in routes]).persist()
        try:
            rejects = held.where(~F.col("_known")).select("value", "topic", "timestamp")
            written, of = {}, {}
            for i, route in enumerate(routes):
                rows = held.where(f"_fits_{i}").select(
                    *[F.col(f"_{i}_{f.name}").alias(f.name) for f in route.schema.fields],
                    F.col("timestamp").alias(RECORD_TIME))
                written[route.table] = (written[route.table].unionByName(rows)
                                        if route.table in written else rows)
                of.setdefault(route.table, []).append(F.count_if(f"_fits_{i}"))
                rejects = rejects.unionByName(held.where(f"NOT _fits_{i}").select("value", "topic", "timestamp"))
            of[REJECTS] = [F.count_if(~F.col("_known"))] + [
                F.count_if(~F.col(f"_fits_{i}")) for i in range(len(routes))]
            # fills the cache in one job, and tells which tables have no row in it
            due = held.agg(*[sum(parts, F.lit(0)).alias(n) for n, parts in of.items()]).first()

            def save(name: str, rows: DataFrame, rebalance: bool = True) -> TableState:
                state = states[name]
                count = store.add_cold(name, rows, batch, schemas[name], rebalance,
                                       state.generation) if due[name] else 0
                return state.after_batch(batch, count, epochs={**(state.epochs or {}), source: epoch})

            def save_changed(route: Route, rows: DataFrame) -> list[TableState]:
                if not due[route.table]:
                    return [save(route.table, rows)]
                latest = states[latest_table(route.table)]
                touched = store.touched(latest, rows)
                columns = route.schema.fieldNames()
                found = changed_records(rows, store.hot_version(latest, touched), route.keys, columns)
                path = f"{store.root}/changes/{latest.relname}/batch={batch}"
                found.write.mode("overwrite").parquet(path)
                found = spark.read.schema(found.schema).parquet(path)
                saved = save(route.table, found.select(*rows.columns),
                             not is_bulk(found.count(), due[route.table]))
                if not saved.moved:
                    return [saved]
                touched = store.touched(latest, found)
                digest = [RECORD_TIME, "_d1", "_d2"]
                last = store.hot_version(latest, touched).unionByName(
                    found.select(*route.keys, *digest)).groupBy(*route.keys).agg(
                    F.max(F.struct(*digest)).alias("_last")).select(
                    *route.keys, *[F.col(f"_last.{c}").alias(c) for c in digest])
                total = latest.hot_rows + found.where("_first").count()
                return [saved, store.rewrite(replace(latest, moved=0), last, batch, total, touched)]

            done = in_parallel(store.spark, [
                (lambda r=keyed[name], d=rows: save_changed(r, d)) if name in keyed else
                (lambda n=name, d=rows: [save(n, d)]) for name, rows in written.items()])
            done = [state for states_of in done for state in states_of] + [save(REJECTS, rejects)]
            store.commit(batch, done)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
