"""Moving settled rows from hot to cold, by policy or by predicate."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import EPOCH, cutoff, in_window, local_bound
from tidemark.operators.extract import CATEGORIES, TablePolicy, extract, unsettled
from tidemark.operators.keyed import delete_using
from tidemark.operators.references import ForeignKey, dependents, divided, marked, parents_first
from tidemark.operators.tiers import BATCH, as_column, hybrid, split_tiers
from tidemark.plans.store import TableState, TierStore, is_bulk
from tidemark.session import in_parallel
from tidemark.sources.jdbc import JdbcHot


def run_batch(store: TierStore, policies: Sequence[TablePolicy], as_of: datetime,
              delay_minutes: int = 1, note: dict[str, int] | None = None) -> list[dict]:
    """One migration batch over the store; returns a report of one entry per policy. ``note`` goes
    into the commit: the micro-batch of a stream that the batch was run for.

    All tables are extracted from the same published state. Where a policy looks at the row
    alone, the rows that stay are its complement over the same immutable version: no keys are
    exchanged, tables without a true key are handled, and the window is only noted as gone until
    so much has gone that a rewrite pays. Where it depends on another table, the keys of the batch
    just written are noted as gone in the same way, if they are a true key, and readers leave them
    out; a rewrite removes them by anti-join.

    A table with nothing to move keeps its hot version. Every processed table advances its
    watermark; disabled, unknown or invalid policies are reported and left alone.
    """
    last_batch, states = store.state()
    batch, until = last_batch + 1, cutoff(as_of, delay_minutes)
    report, work = [], []
    for policy in policies:
        reason = _skip_reason(policy, states)
        if reason:
            report.append({"relname": policy.relname, "moved": 0, "skipped": reason})
        else:
            work.append(policy)

    hot = {name: store.hot_version(states[name]) for name in
           {p.relname for p in work} | {p.close_by.child for p in work if p.close_by}}

    def move(policy: TablePolicy) -> TableState:
        name, state = policy.relname, states[policy.relname]
        child = hot[policy.close_by.child] if policy.close_by else None
        rows = extract(policy, hot[name], state.last_ts, until, child)
        small = not is_bulk(*_share(policy, states, hot, until))
        moved = store.add_cold(name, rows, batch, state.struct, small, state.generation, policy.cluster)
        after = state.after_batch(batch, moved, last_ts=max(until, state.last_ts),
                                  epochs={**(state.epochs or {}), **(note or {})})
        if not moved:
            return after
        if policy.close_by is None:
            noted = after.without_window(policy.ts_column, policy.zone, state.last_ts, until, moved)
        else:
            noted = after.without_keys(policy.pk_columns, batch, moved) if policy.unique else None
        if noted is not None:
            return noted
        written = store.cold_batch(name, batch, state.struct, state.generation)
        touched = store.touched(state, written) if set(state.keys) <= set(policy.pk_columns) else None
        rest = _remaining(policy, store.hot_version(state, touched), written, state.last_ts, until)
        return store.rewrite(after, rest, batch, state.hot_rows - state.gone_rows - moved, touched)

    done = in_parallel(store.spark, [lambda p=p: move(p) for p in work])
    if done:
        store.commit(batch, done)
    return report + [{"relname": s.relname, "moved": s.moved, "skipped": None} for s in done]


def _share(policy: TablePolicy, states: dict[str, TableState], hot: dict[str, DataFrame],
           until: datetime) -> tuple[int, int]:
    """Rows of the window and hot rows, of the table whose time decides: a scan of one column. For closed
    parents, which only a join finds, their children tell about how large a share they are."""
    name, column = ((policy.close_by.child, policy.close_by.ts_column) if policy.close_by else
                    (policy.relname, policy.ts_column))
    window = in_window(F.col(column), states[policy.relname].last_ts, until, policy.zone)
    return hot[name].where(window).count(), states[name].hot_rows - states[name].gone_rows


def _skip_reason(policy: TablePolicy, states: dict) -> str | None:
    if not policy.enabled:
        return "disabled"
    if policy.category not in CATEGORIES:
        return f"unknown category {policy.category!r}"
    if policy.relname not in states:
        return "unknown table"
    if policy.close_by and policy.close_by.child not in states:
        return f"unknown table {policy.close_by.child!r}"
    return None


def _remaining(policy: TablePolicy, hot: DataFrame, moved: DataFrame, last: datetime,
               until: datetime) -> DataFrame:
    if policy.close_by is None:
        return hot.where(unsettled(policy, last, until))
    return delete_using(hot, moved.select(*policy.pk_columns), policy.pk_columns)


def run_rounds(store: TierStore, policies: Sequence[TablePolicy],
               as_of: Iterable[datetime], delay_minutes: int = 1) -> list[list[dict]]:
    """One batch per given moment."""
    return [run_batch(store, policies, moment, delay_minutes) for moment in as_of]


def run_for(batch: Callable[[], object], budget_sec: float, interval_sec: float,
            clock: Callable[[], float] = time.monotonic,
            sleep: Callable[[float], None] = time.sleep) -> int:
    """Repeat a batch until the time budget is used; errors end the run. Returns the rounds."""
    start, rounds = clock(), 0
    while clock() - start < budget_sec:
        batch()
        rounds += 1
        sleep(interval_sec)
    return rounds


def move_by_predicate(store: TierStore, predicates: dict[str, Column | str],
                      cluster: dict[str, Sequence[str]] | None = None) -> dict[str, object]:
    """Move the rows that satisfy a predicate, once; the rest, NULL included, stays hot.

    A failing table does not hold up the others: its entry in the report is the error. ``cluster``
    names, by table, columns that the moved rows are kept together by.
    """
    last_batch, states = store.state()
    batch = last_batch + 1

    def move(name: str, predicate: Column | str) -> TableState | Exception:
        try:
            state = states[name]
            stay, go = split_tiers(store.hot_version(state), as_column(predicate))
            moved = store.add_cold(name, go, batch, state.struct, generation=state.generation,
                                   cluster=(cluster or {}).get(name, ()))
            after = state.after_batch(batch, moved)
            if not moved:
                return after
            return store.rewrite(after, stay, batch, state.hot_rows - state.gone_rows - moved)
        except Exception as error:  # noqa: BLE001 - reported per table
            return error

    results = dict(zip(predicates, in_parallel(store.spark, [
        lambda n=name, p=predicate: move(n, p) for name, predicate in predicates.items()])))
    done = [r for r in results.values() if isinstance(r, TableState)]
    if done:
        store.commit(batch, done)
    return {n: r.moved if isinstance(r, TableState) else r for n, r in results.items()}


def move_with_children(store: TierStore, predicates: dict[str, Column | str],
                       references: Sequence[ForeignKey]) -> dict[str, int]:
    """Move the rows that satisfy a predicate, and all rows that refer to a row that moves, through
    however many tables: one commit, after which no row of the hot tier refers to a row outside it
    (unless it referred to none before). Rows whose reference is null stay.

    Tables go parents first. The keys that take children along are read back from what was written,
    so each table is decided once. A table that refers to itself is refused.
    """
    if own := sorted(r.child for r in references if r.child == r.parent):
        raise ValueError(f"{', '.join(own)} refers to itself")
    last_batch, states = store.state()
    batch = last_batch + 1
    names = [n for n in parents_first(references, predicates)
             if n in dependents(references, predicates)]
    written, done = {}, []
    for name in names:
        state = states[name]
        goes = as_column(predicates[name]) if name in predicates else F.lit(False)
        moving = [(r, written[r.parent]) for r in references
                  if r.child == name and r.parent in written]
        stay, go = divided(marked(store.hot_version(state), goes, moving))
        moved = store.add_cold(name, go, batch, state.struct, generation=state.generation)
        after = state.after_batch(batch, moved)
        if moved:
            written[name] = store.cold_batch(name, batch, state.struct, state.generation)
            after = store.rewrite(after, stay, batch, state.hot_rows - state.gone_rows - moved)
        done.append(after)
    store.commit(batch, done)
    return {s.relname: s.moved for s in done}


def tier_counts(store: TierStore, names: Sequence[str]) -> DataFrame:
    """``relname, tier, rows`` of the current state."""
    parts = []
    for name, (hot, cold) in store.tiers(*names).items():
        for tier, df in (("hot", hot), ("cold", cold)):
            if df is not None:
                parts.append(df.select(F.lit(name).alias("relname"), F.lit(tier).alias("tier")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("relname", "tier").agg(F.count(F.lit(1)).alias("rows"))


# A live database as the hot tier. The lake and the database cannot commit together, so the
# watermark and the number of the last finished batch live in the database, beside the deletes.

BATCH_DDL = ("CREATE TABLE sync_batch (relname VARCHAR(128) NOT NULL, batch_id BIGINT NOT NULL, "
             "PRIMARY KEY (relname, batch_id))")
WATERMARK_DDL = ("CREATE TABLE sync_watermark (relname VARCHAR(128) PRIMARY KEY, "
                 "last_ts TIMESTAMP NOT NULL, batch_id BIGINT NOT NULL)")


def jdbc_watermarks(hot: JdbcHot) -> dict[str, tuple[datetime, int]]:
    """``relname -> (last_ts, batch_id)``: one row per policy."""
    rows = hot.table("sync_watermark").select(
        F.col("relname").alias("r"), F.col("last_ts").cast("timestamp_ntz").alias("t"),
        F.col("batch_id").alias("b")).collect()
    return {r.r: (r.t, r.b) for r in rows}


def run_jdbc_batch(hot: JdbcHot, cold, policies: Sequence[TablePolicy], as_of: datetime,
                   delay_minutes: int = 1,
                   read: Callable[[str], DataFrame] | None = None,
                   references: Sequence[ForeignKey] = ()) -> list[dict]:
    """As :func:`run_batch`, deleting from a live database.

    Windows, and which parents have closed, are evaluated by the database, so that only settled rows
    travel; next to a clock change of the policy's zone Spark finds the closed parents instead.
    ``read`` gives the rows of a table, by default :meth:`~tidemark.sources.jdbc.JdbcHot.scan` over the
    first key column, side by side where the table is large; with a ``read`` Spark finds the closed parents.

    ``cold`` offers ``write_cold(name, df, batch)`` and ``cold_batch(name, batch, schema)``.
    Rows are read once, into the batch partition; the keys to delete are read back from it. A row
    with a new key that arrives meanwhile is neither lost nor deleted. Where the key is no true one
    (``unique=False``), rows of each key are counted in the transaction, and if any came or went
    since, all is rolled back and a retry moves them. Delete, watermark and the note that the batch
    counts are one database transaction. Until it commits, read with :func:`~tidemark.operators.tiers.hybrid`
    given the keys; a retry writes the same batch number again. With ``references`` rows are deleted
    children first, as a database that enforces them needs it.
    """
    first = {p.relname: p.pk_columns[0] for p in policies}
    scan = read or (lambda name: hot.scan(name, first.get(name)))
    marks = jdbc_watermarks(hot)
    batch = max((b for _, b in marks.values()), default=-1) + 1
    until = cutoff(as_of, delay_minutes)
    report, moved_tables, active = [], [], []
    for policy in policies:
        if not policy.enabled or policy.category not in CATEGORIES:
            report.append({"relname": policy.relname, "moved": 0, "skipped": "inactive"})
            continue
        last = marks.get(policy.relname, (EPOCH, -1))[0]
        rows = _zoneless(scan(policy.relname))
        settled = None if read else _closed_in_database(hot, policy, last, until)
        if settled is None:
            child = _zoneless(scan(policy.close_by.child)) if policy.close_by else None
            settled = extract(policy, rows, last, until, child)
        cold.write_cold(policy.relname, settled, batch)
        written = cold.cold_batch(policy.relname, batch, rows.schema)
        moved = written.count()
        if moved:
            hot.stage_keys(written, policy.pk_columns, _staging(policy))
            moved_tables.append(policy)
        active.append((policy, max(until, last)))
        report.append({"relname": policy.relname, "moved": moved, "skipped": None})

    if references:
        order = parents_first(references, [p.relname for p in moved_tables])
        moved_tables.sort(key=lambda p: -order.index(p.relname))
    with hot.transaction() as tx:
        for policy in moved_tables:
            if not policy.unique and tx.execute(hot.changed_statement(
                    policy.relname, _staging(policy), policy.pk_columns))[1]:
                raise RuntimeError(f"rows of staged keys of {policy.relname} have changed; run again")
            tx.execute(hot.delete_statement(policy.relname, _staging(policy), policy.pk_columns))
        for policy, mark in active:
            _advance(tx, policy.relname, mark, batch)
            tx.execute("INSERT INTO sync_batch VALUES (?, ?)", [policy.relname, batch])
    with hot.transaction() as tx:
        for policy in moved_tables:
            tx.execute(f"DROP TABLE {_staging(policy)}")
    return report


def _closed_in_database(hot: JdbcHot, policy: TablePolicy, last: datetime, until: datetime
                        ) -> DataFrame | None:
    """The closed parents of a policy; None where it has no children or the zone's offset changes."""
    bounds = [local_bound(t, policy.zone) for t in (last, until)]
    if policy.close_by is None or None in bounds:
        return None
    close = policy.close_by
    return _zoneless(hot.closed_parents(policy.relname, close.child, close.on, close.ts_column, *bounds))


def _staging(policy: TablePolicy) -> str:
    return "staging_delete_" + policy.relname.replace(".", "_")


def _zoneless(df: DataFrame) -> DataFrame:
    """Database timestamps without a zone, as such."""
    return df.select(*[
        F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n)
        for n, t in df.dtypes])


def _advance(tx, relname: str, mark: datetime, batch: int) -> None:
    text = mark.isoformat(sep=" ")
    _, changed = tx.execute(
        "UPDATE sync_watermark SET last_ts = CAST(? AS TIMESTAMP), batch_id = ? "
        "WHERE relname = ?", [text, batch, relname])
    if not changed:
        tx.execute("INSERT INTO sync_watermark VALUES (?, CAST(? AS TIMESTAMP), ?)",
                   [relname, text, batch])


def jdbc_hybrid(hot: JdbcHot, cold_table: DataFrame | None, name: str, keys: Sequence[str],
                read: Callable[[str], DataFrame] | None = None):
    """The table over a live database and the cold tier, right at every step of a batch.

    Batches that count are those the database has noted; what a failed attempt left of an earlier
    one is passed over, and rows of a batch in flight are dropped from hot. Make it anew for each
    query: Spark lists cold files when the frame is made, and a batch that begins and ends between
    that listing and the hot scan would hide its rows from both. ``read`` is as in
    :func:`run_jdbc_batch`.
    """
    live = _zoneless(read(name) if read else hot.scan(name, keys[0]))
    if cold_table is None:
        return live
    # the last batch of the database, whichever tables it had
    done = max((b for _, b in jdbc_watermarks(hot).values()), default=-1)
    # the noted batches meet the partitions in a join, however many there are
    noted = hot.table("sync_batch").where(F.col("relname") == name).select(
        F.col("batch_id").alias(BATCH))
    counts = cold_table.where(F.col(BATCH) <= done).join(noted, BATCH, "left_semi").select(
        *cold_table.columns)
    cold = counts.unionByName(cold_table.where(F.col(BATCH) > done))
    return hybrid(live, cold, committed=done, keys=keys)
