"""The tier store: versions of the hot tier, batches of the cold tier, and a commit log.

Layout under one folder::

    hot/<table>/v=<n>/...            a whole hot version, never changed once published
    cold/<table>/_batch_id=<n>/...   rows that batch <n> moved; ``<table>@<g>`` once compacted
    commits/batch_id=<n>/...         one file; batch <n> counts from the moment it exists
    checkpoints/upto=<n>/...         the state of every table as of commit <n>
    buckets/<table>/v=<n>/_bucket=<b>/...   instead of hot/<table>, for tables laid out by key

A batch writes its cold partitions and next hot versions, then its commit. Until then readers
use the earlier commit, so a row is never seen twice nor missed, and a retry of the same batch
overwrites what a failed attempt left behind. For each table a commit names the hot version and
the cold batches that count, as ranges: what a failed attempt left for a table that the next
attempt does not touch stays invisible.

A commit is a folder renamed into place unless it exists already: of two writers that chose the
same number one is refused. A store is meant for one writer at a time, since a refused one has
overwritten files of its number. The state is read from the last checkpoint and the commits after
it, so it opens a bounded number of files; :meth:`TierStore.compact` and :meth:`TierStore.expire`
bound what is listed and kept.

Moving a time window need not rewrite a hot version: the commit notes the window as gone, and
readers leave it out, with a filter that the scan prunes by. A version never changes, so the
window holds exactly the rows that were moved. It is rewritten once half of it is gone. Likewise a move
by key notes from which cold batch on keys have gone; readers leave them out with an anti-join.

A table with a :class:`Layout` keeps its hot rows in buckets by the hash of their key. The commit
names a version for each bucket, so a change writes the buckets of its keys and no others, and
readers choose by partitions alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import EPOCH, in_window, outside_window
from tidemark.operators.clustering import clustered
from tidemark.operators.keyed import CHANGE
from tidemark.operators.tiers import BATCH, hybrid
from tidemark.session import in_parallel, scratch_name
from tidemark.sources.files import try_read
from tidemark.sources.paths import names, publish, remove

COMMIT_SCHEMA = T.StructType([
    T.StructField("relname", T.StringType()),
    T.StructField("last_ts", T.TimestampNTZType()),
    T.StructField("hot_version", T.LongType()),
    T.StructField("moved", T.LongType()),
    T.StructField("cold", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("schema", T.StringType()),
    T.StructField("hot_rows", T.LongType()),
    T.StructField("gone_rows", T.LongType()),
    T.StructField("gone", T.StructType([
        T.StructField("column", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("after", T.TimestampNTZType()),
        T.StructField("until", T.TimestampNTZType()),
    ])),
    T.StructField("generation", T.LongType()),
    T.StructField("epochs", T.MapType(T.StringType(), T.LongType())),
    T.StructField("gone_keys", T.StructType([
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("since", T.LongType()),
    ])),
    T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("buckets", T.ArrayType(T.LongType())),
])

BUCKET, VERSION = "_bucket", "_version"

#: Commits between two checkpoints of the state.
CHECKPOINT_EVERY = 20


#: A move of at least one in this many of a table's hot rows keeps the tasks of its scan.
BULK = 8


def is_bulk(rows: int, among: int) -> bool:
    """Whether ``rows`` of ``among`` are so many that tasks which read all write files of a good size."""
    return rows * BULK >= among


class Gone(NamedTuple):
    """A time window whose rows have left the hot version."""

    column: str
    zone: str | None
    after: datetime
    until: datetime


class GoneKeys(NamedTuple):
    """Rows that have left the hot version by key: those whose key a cold batch has, from one on."""

    columns: tuple[str, ...]
    since: int


class Layout(NamedTuple):
    """Hot rows in ``buckets`` parts by the hash of their key. Choose so many that a part is a file
    or two: a change rewrites whole parts."""

    keys: tuple[str, ...]
    buckets: int = 64


@dataclass(frozen=True)
class TableState:
    """What the log says of one table as of some batch."""

    relname: str
    last_ts: datetime
    hot_version: int
    moved: int
    cold: tuple[tuple[int, int], ...]  # ranges of cold batches, first and last
    schema: str
    hot_rows: int  # in the hot version, those gone included
    gone_rows: int = 0
    gone: Gone | None = None
    generation: int = 0  # of the cold folder; compaction begins a new one
    epochs: dict[str, int] | None = None  # per stream, the last micro-batch that was stored
    gone_keys: GoneKeys | None = None
    keys: tuple[str, ...] = ()  # of a table laid out by key
    buckets: tuple[int, ...] = ()  # the version of each bucket

    def bucket_of(self) -> Column:
        return bucket_of(self.keys, len(self.buckets))

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def after_batch(self, batch: int, moved: int, **changes) -> TableState:
        """The state once ``batch`` has written its cold partition."""
        cold = self.cold
        if moved and cold and cold[-1][1] == batch - 1:
            cold = cold[:-1] + ((cold[-1][0], batch),)
        elif moved:
            cold += ((batch, batch),)
        return replace(self, moved=moved, cold=cold, **changes)

    def with_hot(self, version: int, rows: int, gone: int = 0,
                 touched: Sequence[int] | None = None) -> TableState:
        """The state once a new hot version has been written, whole or of the buckets ``touched``;
        ``gone`` of its ``rows`` are marked as deleted."""
        buckets = tuple(version if touched is None or b in touched else v
                        for b, v in enumerate(self.buckets))
        return replace(self, hot_version=version, hot_rows=rows, gone_rows=gone, gone=None,
                       gone_keys=None, buckets=buckets)

    def without_window(self, column: str, zone: str | None, after: datetime, until: datetime,
                       rows: int) -> TableState | None:
        """The state with a window noted as gone; None where a rewrite is due instead.

        A window that follows an earlier one extends it, for the same column only: between the
        two the version held no row, or it would have been moved.
        """
        if 2 * (self.gone_rows + rows) >= self.hot_rows:
            return None
        if self.gone is not None:
            if (self.gone.column, self.gone.zone) != (column, zone) or after < self.gone.until:
                return None
            after = self.gone.after
        return replace(self, gone_rows=self.gone_rows + rows,
                       gone=Gone(column, zone, after, until))

    def without_keys(self, columns: Sequence[str], batch: int, rows: int) -> TableState | None:
        """The state with the keys of a cold batch noted as gone; None where a rewrite is due instead.
        The columns are a true key of the table."""
        if 2 * (self.gone_rows + rows) >= self.hot_rows:
            return None
        if self.gone_keys is not None and self.gone_keys.columns != tuple(columns):
            return None
        since = batch if self.gone_keys is None else self.gone_keys.since
        return replace(self, gone_rows=self.gone_rows + rows, gone_keys=GoneKeys(tuple(columns), since))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class TierStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # The commit log

    def log(self) -> DataFrame | None:
        schema = T.StructType(COMMIT_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])
        return try_read(self.spark, f"{self.root}/commits", schema)

    def state(self, as_of: int | None = None) -> tuple[int, dict[str, TableState]]:
        """``(last batch, state per table)``; one row per table comes to the driver."""
        base = self._checkpoint(as_of)
        log = self.log()
        if log is None:
            return -1, {}
        log = log.where(F.col("batch_id") > (-1 if base is None else base))
        if as_of is not None:
            log = log.where(F.col("batch_id") <= as_of)
        columns = ["batch_id", "relname", *COMMIT_SCHEMA.fieldNames()[1:]]
        log = log.select(*columns)
        if base is not None:
            log = log.unionByName(self.spark.read.schema(COMMIT_SCHEMA).parquet(
                f"{self.root}/checkpoints/upto={base}").withColumn(
                "batch_id", F.lit(base).cast("long")).select(*columns))
        kept = [c for c in columns if c != "relname"]
        latest = log.groupBy("relname").agg(
            F.max_by(F.struct(*kept), "batch_id").alias("s")).select("relname", "s.*").collect()
        last = max((r.batch_id for r in latest), default=-1)
        return last, {r.relname: self._state_of(r) for r in latest}

    def _checkpoint(self, as_of: int | None) -> int | None:
        found = [int(n.partition("=")[2]) for n in names(self.spark, f"{self.root}/checkpoints")
                 if n.startswith("upto=")]
        return max((n for n in found if as_of is None or n <= as_of), default=None)

    @staticmethod
    def _state_of(row) -> TableState:
        values = {n: row[n] for n in COMMIT_SCHEMA.fieldNames()[1:]} | {
            "cold": tuple(tuple(c) for c in row.cold),
            "keys": tuple(row["keys"] or ()), "buckets": tuple(row.buckets or ()),
            "gone": None if row.gone is None else Gone(*row.gone),
            "gone_keys": None if row.gone_keys is None else GoneKeys(
                tuple(row.gone_keys.columns), row.gone_keys.since)}
        return TableState(relname=row.relname, **values)

    def _write_states(self, states: list[TableState], target: str) -> bool:
        """One file, renamed into place; False if the target exists."""
        rows = [(s.relname, s.last_ts, s.hot_version, s.moved, [list(c) for c in s.cold], s.schema,
                 s.hot_rows, s.gone_rows, s.gone, s.generation, s.epochs or {},
                 s.gone_keys and (list(s.gone_keys.columns), s.gone_keys.since), list(s.keys),
                 list(s.buckets)) for s in states]
        staged = f"{self.root}/staging/{scratch_name('commit')}"
        self.spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1).write.parquet(staged)
        return publish(self.spark, staged, target)

    def commit(self, batch: int, states: list[TableState]) -> None:
        """Publish a batch: one folder that appears at once. A batch that is already published,
        by this writer or another, is refused."""
        if not self._write_states(states, f"{self.root}/commits/batch_id={batch}"):
            raise RuntimeError(f"batch {batch} of {self.root} is already published")
        if batch % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            self._write_states(list(self.state(batch)[1].values()),
                               f"{self.root}/checkpoints/upto={batch}")

    # Upkeep

    def compact(self, name: str) -> int:
        """Rewrite the cold batches of a table as one, in files of the size Spark aims at. Earlier
        commits keep reading the old batches until they expire. The rows' ``_batch_id`` becomes
        that of the compaction."""
        batch, state = self._table(name, None)
        cold = self.cold_rows(state)
        if cold is None:
            return batch
        batch += 1
        state = replace(state, generation=batch, cold=((batch, batch),), moved=0)
        cold.drop(BATCH).hint("rebalance").write.mode("overwrite").parquet(
            f"{self.cold_path(name, batch)}/{BATCH}={batch}")
        self.commit(batch, [state])
        return batch

    def expire(self, keep: int = 1) -> None:
        """Keep the last ``keep`` commits readable and delete what only earlier ones need: commits,
        checkpoints, hot versions, compacted batches, staged changes."""
        last, now = self.state()
        oldest = max(0, last - keep + 1)
        held: dict[str, set[tuple[int, int]]] = {n: set() for n in now}
        for as_of in range(oldest, last + 1):
            for state in self.state(as_of)[1].values():
                held[state.relname].update(
                    (version, state.generation) for version in state.buckets or [state.hot_version])
        if self._checkpoint(oldest) != oldest:
            self._write_states(list(self.state(oldest)[1].values()),
                               f"{self.root}/checkpoints/upto={oldest}")
        number = lambda n: int(n.partition("=")[2])
        for folder, part in (("commits", "batch_id="), ("checkpoints", "upto=")):
            for n in names(self.spark, f"{self.root}/{folder}"):
                if n.startswith(part) and number(n) < oldest:
                    remove(self.spark, f"{self.root}/{folder}/{n}")
        for name, used in held.items():
            for folder, part in ((f"hot/{name}", "v="), (f"buckets/{name}", f"{VERSION}=")):
                for n in names(self.spark, f"{self.root}/{folder}"):
                    if n.startswith(part) and number(n) <= last and number(n) not in {h for h, _ in used}:
                        remove(self.spark, f"{self.root}/{folder}/{n}")
            for n in names(self.spark, f"{self.root}/cold"):
                table, _, generation = n.partition("@")
                if table == name and int(generation or 0) <= last and int(generation or 0) not in {
                        g for _, g in used}:
                    remove(self.spark, f"{self.root}/cold/{n}")
        for n in names(self.spark, f"{self.root}/changes"):
            for part in names(self.spark, f"{self.root}/changes/{n}"):
                if number(part) <= last:
                    remove(self.spark, f"{self.root}/changes/{n}/{part}")

    def watermarks(self) -> DataFrame:
        """``(relname, last_ts)`` of every table, as a DataFrame."""
        return self.spark.createDataFrame(
            [(s.relname, s.last_ts) for s in self.state()[1].values()],
            "relname string, last_ts timestamp_ntz")

    # Loading and writing

    def load(self, tables: dict[str, DataFrame], replace_existing: bool = False,
             layouts: dict[str, Layout] | None = None) -> int:
        """Publish new tables, all rows hot."""
        return self.load_tiers({name: (df, None) for name, df in tables.items()}, replace_existing,
                               layouts)

    def load_tiers(self, tables: dict[str, tuple[DataFrame, DataFrame | None]],
                   replace_existing: bool = False, layouts: dict[str, Layout] | None = None) -> int:
        """Publish new tables from ``(hot, cold)`` pairs; ``cold=None`` for hot alone.

        A table that the store has is refused, unless it is to be replaced, both tiers of it. Tables
        named in ``layouts`` are kept in buckets by key.
        """
        last, states = self.state()
        if (known := sorted(states.keys() & tables)) and not replace_existing:
            raise ValueError(f"{self.root} already has {', '.join(known)}")
        batch = last + 1

        def write(name: str, hot: DataFrame, cold: DataFrame | None) -> TableState:
            keys, buckets = (layouts or {}).get(name, ((), 0))
            state = TableState(name, EPOCH, batch, 0, (), hot.schema.json(), 0, keys=tuple(keys),
                               buckets=(batch,) * buckets)
            rows = self.write_state(state, hot, batch).count()
            state = replace(state, hot_rows=rows)
            if cold is None:
                return state
            return state.after_batch(batch, self.add_cold(name, cold, batch, hot.schema))

        self.commit(batch, in_parallel(self.spark, [
            lambda n=name, t=tiers: write(n, *t) for name, tiers in tables.items()]))
        return batch

    def write_hot(self, name: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self.hot_path(name, version))

    def write_state(self, state: TableState, df: DataFrame, version: int) -> DataFrame:
        """Write hot rows as ``state`` lays them out, and give back what was written. In buckets,
        those that ``df`` has no row of get no folder."""
        if not state.buckets:
            self.write_hot(state.relname, df, version)
            return self.spark.read.schema(df.schema).parquet(self.hot_path(state.relname, version))
        path = f"{self.bucket_path(state.relname)}/{VERSION}={version}"
        df.withColumn(BUCKET, state.bucket_of()).hint("rebalance", BUCKET).write.partitionBy(
            BUCKET).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def rewrite(self, state: TableState, df: DataFrame, version: int, rows: int,
                touched: Sequence[int] | None = None) -> TableState:
        """Write the hot rows that stay, of all buckets or those ``touched``; ``rows`` stay in all."""
        self.write_state(state, df, version)
        return state.with_hot(version, rows, touched=touched)

    def touched(self, state: TableState, rows: DataFrame) -> list[int] | None:
        """The buckets of some rows' keys, at most as many as there are; None for all, also where a
        window or keys are noted as gone, which a rewrite of all ends."""
        if not state.buckets or state.gone is not None or state.gone_keys is not None:
            return None
        return sorted(r[0] for r in rows.select(state.bucket_of()).distinct().collect())

    def write_cold(self, name: str, df: DataFrame, batch: int, rebalance: bool = False,
                   generation: int = 0) -> None:
        """Write one batch partition; a retry replaces it.

        ``rebalance`` is for a small share of a large hot table, which would else leave one tiny
        file per scan task: its rows are spread evenly over as few files as their size needs. A
        bulk move keeps the tasks of its scan and exchanges nothing.
        """
        if rebalance:
            df = df.hint("rebalance")
        df.write.mode("overwrite").parquet(f"{self.cold_path(name, generation)}/{BATCH}={batch}")

    def add_cold(self, name: str, df: DataFrame, batch: int, schema: T.StructType,
                 rebalance: bool = False, generation: int = 0, cluster: Sequence[str] = ()) -> int:
        """Write one batch partition and count what was written; an empty one leaves no folder.
        ``cluster`` names columns that readers filter by, see :meth:`append_cold`."""
        if cluster:
            df, rebalance = clustered(df, cluster), False
        self.write_cold(name, df, batch, rebalance, generation)
        rows = self.cold_batch(name, batch, schema, generation).count()
        if not rows:
            remove(self.spark, f"{self.cold_path(name, generation)}/{BATCH}={batch}")
        return rows

    def hot_path(self, name: str, version: int) -> str:
        return f"{self.root}/hot/{name}/v={version}"

    def bucket_path(self, name: str) -> str:
        return f"{self.root}/buckets/{name}"

    def cold_path(self, name: str, generation: int = 0) -> str:
        return f"{self.root}/cold/{name}@{generation}" if generation else f"{self.root}/cold/{name}"

    # Reading

    def hot(self, name: str, as_of: int | None = None) -> DataFrame:
        return self.hot_version(self._table(name, as_of)[1])

    def cold(self, name: str, as_of: int | None = None) -> DataFrame | None:
        """Committed cold rows with their ``_batch_id``; None if nothing was ever moved."""
        return self.cold_rows(self._table(name, as_of)[1])

    def read(self, name: str, as_of: int | None = None) -> DataFrame:
        """The table as of a commit, the last one by default: hot version and cold batches."""
        return self._read(self._table(name, as_of)[1])

    def tables(self, as_of: int | None = None) -> dict[str, DataFrame]:
        """Every table of the store, as of one commit: one look at the log for all."""
        return {name: self._read(s) for name, s in self.state(as_of)[1].items()}

    def tiers(self, *names: str) -> dict[str, tuple[DataFrame, DataFrame | None]]:
        """``name -> (hot, cold)`` of one commit, with one look at the log."""
        states = self.state()[1]
        return {n: (self.hot_version(states[n]), self.cold_rows(states[n])) for n in names}

    def cold_batch(self, name: str, batch: int, schema: T.StructType, generation: int = 0
                   ) -> DataFrame:
        return self.spark.read.schema(schema).parquet(
            f"{self.cold_path(name, generation)}/{BATCH}={batch}")

    def stragglers(self, name: str, ts_column: str, zone: str | None = None) -> DataFrame:
        """Rows that are still hot though their time is not after the table's watermark: they came
        too late for their window, and stay hot."""
        state = self._table(name, None)[1]
        return self.hot_version(state).where(in_window(F.col(ts_column), EPOCH, state.last_ts, zone))

    def snapshots(self, name: str) -> DataFrame:
        """Commits that touched a table: ``batch_id, hot_version, moved, last_ts``."""
        return self.log().where(F.col("relname") == name).select(
            "batch_id", "hot_version", "moved", "last_ts")

    def _table(self, name: str, as_of: int | None) -> tuple[int, TableState]:
        batch, states = self.state(as_of)
        if name not in states:
            raise KeyError(f"no table {name!r} in {self.root}")
        return batch, states[name]

    def hot_version(self, state: TableState, touched: Sequence[int] | None = None) -> DataFrame:
        """The hot rows a state names, without those marked as deleted or in a window gone; of the
        buckets ``touched`` alone, if given."""
        schema = T.StructType(state.struct.fields + [T.StructField(CHANGE, T.StringType())])
        if state.buckets:
            whole = T.StructType(schema.fields + [T.StructField(VERSION, T.LongType()),
                                                  T.StructField(BUCKET, T.IntegerType())])
            df = self.spark.read.schema(whole).parquet(self.bucket_path(state.relname))
            versions = F.array(*[F.lit(v) for v in state.buckets])
            df = df.where(F.get(versions, F.col(BUCKET)) == F.col(VERSION))
            if touched is not None:
                df = df.where(F.col(BUCKET).isin(*touched))
            df = df.drop(VERSION, BUCKET)
        else:
            df = self.spark.read.schema(schema).parquet(
                self.hot_path(state.relname, state.hot_version))
        df = df.where(F.col(CHANGE).isNull() | (F.col(CHANGE) != "delete")).drop(CHANGE)
        if state.gone is not None:
            column, zone, after, until = state.gone
            df = df.where(outside_window(F.col(column), after, until, zone))
        if state.gone_keys is not None:
            columns, since = state.gone_keys
            moved = self.cold_rows(state).where(F.col(BATCH) >= since).select(*columns)
            df = df.join(moved, list(columns), "left_anti").select(*df.columns)
        return df

    def cold_rows(self, state: TableState) -> DataFrame | None:
        """The cold batches a state names: a filter on partitions alone."""
        if not state.cold:
            return None
        schema = T.StructType(state.struct.fields + [T.StructField(BATCH, T.LongType())])
        return self.spark.read.schema(schema).parquet(
            self.cold_path(state.relname, state.generation)).where(self._counts(state))

    @staticmethod
    def _counts(state: TableState) -> Column:
        """Whether a row's batch counts: one flat predicate, however many ranges there are."""
        if len(state.cold) == 1:
            return F.col(BATCH).between(*state.cold[0])
        ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in state.cold])
        return F.exists(ranges, lambda r: F.col(BATCH).between(r["a"], r["b"]))

    def _read(self, state: TableState) -> DataFrame:
        return hybrid(self.hot_version(state), self.cold_rows(state))

    def add_column(self, name: str, column: str, ddl_type: str) -> int:
        """A new last column; rows written earlier read NULL. Nothing is rewritten."""
        batch, state = self._table(name, None)
        wide = T.StructType(state.struct.fields).add(column, T.DataType.fromDDL(ddl_type), True)
        self.commit(batch + 1, [replace(state, schema=wide.json(), moved=0)])
        return batch + 1

    def append_cold(self, name: str, df: DataFrame, cluster: Sequence[str] = ()) -> int:
        """Add rows straight to the cold tier as one published batch. ``cluster`` names columns that
        readers filter by: rows near in all of them are stored together, so that Parquet's own
        statistics rule out most of what a filter on any of them does not need."""
        batch, state = self._table(name, None)
        batch += 1
        df = df.select(*state.struct.fieldNames())
        moved = self.add_cold(name, df, batch, state.struct, generation=state.generation, cluster=cluster)
        self.commit(batch, [state.after_batch(batch, moved)])
        return batch
