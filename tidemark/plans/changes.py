"""Change batches: validate, stage, publish; all or nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import CHANGE, change_images, net_changes, snapshot_diff
from tidemark.plans.store import TierStore

OPS = ("insert", "update", "delete")


def _stage(store: TierStore, name: str, batch: int, changes: DataFrame,
           columns: Sequence[str]) -> DataFrame:
    """Write the changes once and read them back: they are looked at several times, and must be
    the same each time; and a stored side lets the join split a heavy key of the other."""
    path = f"{store.root}/changes/{name}/batch={batch}"
    df = changes.select(*dict.fromkeys(columns))
    df.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


class ChangeError(ValueError):
    """The batch was refused; the table is as it was."""


def apply_batch(store: TierStore, name: str, changes: DataFrame, keys: Sequence[str],
                order: Sequence[str] = ()) -> dict[str, int]:
    """Apply row changes to the hot table and publish the result as its next version.

    ``changes`` has the columns of the table, ``op``, and the ``order`` columns; several changes
    to one key take effect in that order, and without ``order`` there may be only one.
    The next version is written once, with a mark of what became of each row; the affected rows
    are counted from that column alone. Of a table laid out in buckets by its key only the buckets
    of the changes are read and written. An unknown operation, a NULL or repeated key, or an
    insert onto an existing key refuses the whole batch before the commit, and the earlier
    version stays the published one.
    """
    last_batch, states = store.state()
    batch, state = last_batch + 1, states[name]
    changes = _stage(store, name, batch, changes, [*state.struct.fieldNames(), "op", *order])
    valid = F.col("op").isin(*OPS)
    for key in keys:
        valid = valid & F.col(key).isNotNull()
    if not changes.where(~F.coalesce(valid, F.lit(False))).isEmpty():
        raise ChangeError("unknown operation or missing key")
    if not changes.groupBy(*keys).count().where("count > 1").isEmpty():
        if not order:
            raise ChangeError("several changes to one key, and no order between them")
        changes = _stage(store, f"{name}-last", batch,
                         net_changes(changes, keys, order), changes.columns)
    changes = changes.select(*state.struct.fieldNames(), "op")
    # a table in buckets by just these keys: only the buckets of the changes are read and written
    touched = store.touched(state, changes) if set(state.keys) <= set(keys) else None
    images = change_images(store.hot_version(state, touched), changes, keys)
    staged = store.write_state(state, images, batch)
    counts = {r[CHANGE]: r["count"] for r in staged.groupBy(CHANGE).count().collect()}
    if counts.get("conflict"):
        raise ChangeError(f"{counts['conflict']} inserts onto existing keys")
    rows, gone = sum(counts.values()), counts.get("delete", 0)
    if touched is not None:  # the rows that other buckets have, and what changed in these
        rows, gone = state.hot_rows + counts.get("insert", 0), state.gone_rows + gone
    store.commit(batch, [replace(state, moved=0).with_hot(batch, rows, gone, touched)])
    return {op: counts.get(op, 0) for op in OPS}


def apply_poll(store: TierStore, name: str, poll: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Make the hot table what a bulk poll of its source says it is: what the poll adds, changes and
    no longer has becomes one change batch."""
    state = store.state()[1][name]
    hot = store.hot_version(state)
    return apply_batch(store, name, snapshot_diff(hot, poll.select(*hot.columns), keys), keys)
