"""Keyed operators: latest record, upsert, delete by keys, differences of polls, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "_change"


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key by ``order``; ties fall to the greatest remaining columns.

    An aggregate rather than a ranking window: each task first reduces its own rows to one per
    key, so a key that holds a third of the data sends one row per task through the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    record = F.max(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(record).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys; they stay distributed."""
    return df.select(*keys).distinct()


def delete_using(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not staged for deletion.

    Give the keys as they were stored, repeats and all: repeats do no harm here, whereas a
    preceding aggregation would share its exchange with the join, and a heavy key in ``df``
    could then not be split at run time.
    """
    return df.join(keys, list(on), "left_anti")


def keyed_upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows whose key occurs in ``changes`` and add the rest; keys there are unique."""
    kept = base.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes)


def net_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One change per key with the effect of all its changes in order.

    A key whose last insert or delete is a delete ends absent; one whose last is an insert ends
    with the latest row, as ``insert`` if it began with an insert, or as ``put`` (replace or add)
    if a delete came first; one that was only updated is updated to the latest row. Reduced
    within each task before the exchange, so a key with very many changes is no burden.
    """
    rest = [c for c in changes.columns if c not in keys and c not in order]
    mark = F.when(F.col("op") != "update", F.struct(*order, "op"))
    net = changes.groupBy(*keys).agg(
        F.max(F.struct(*order, *rest)).alias("_last"), F.min(mark).alias("_from"),
        F.max(mark).alias("_to"))
    op = (F.when(F.col("_to").isNull(), "update")
          .when(F.col("_to.op") == "delete", "delete")
          .when(F.col("_from.op") == "insert", "insert")
          .otherwise("put"))
    return net.select(*[
        F.col(c) if c in keys else op.alias("op") if c == "op" else F.col(f"_last.{c}").alias(c)
        for c in changes.columns])


def change_images(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` after a set of row changes, each row marked with what became of it.

    ``changes`` holds at most one row per key: the columns of ``base`` plus ``op`` (``insert``,
    ``update``, ``delete`` or ``put``). The mark in ``_change`` is ``same``, ``update``,
    ``delete`` (the old row), ``insert``, or ``conflict`` where an insert met an existing key. An
    update or delete without a row in ``base`` changes nothing. The base is joined once, as the left side,
    so a skewed base can be split at run time, if ``changes`` is a stored table (as in
    :func:`delete_using`).
    """
    values = [c for c in base.columns if c not in keys]
    new = changes.select(*keys, F.col("op").alias("_op"),
                         F.struct(*values).alias("_new") if values else F.lit(None).alias("_new"))
    joined = base.join(new, list(keys), "left")
    mark = (F.when(F.col("_op").isNull(), "same")
            .when(F.col("_op") == "insert", "conflict")
            .when(F.col("_op") == "put", "update")
            .otherwise(F.col("_op")))
    touched = joined.select(
        *[F.col(c) if c in keys
          else F.when(mark == "update", F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
          for c in base.columns],
        mark.alias(CHANGE))
    added = changes.where(F.col("op") == "insert")
    puts = changes.where(F.col("op") == "put")
    if not puts.isEmpty():
        added = added.unionByName(puts.join(base.select(*keys), list(keys), "left_anti"))
    return touched.unionByName(added.select(*base.columns, F.lit("insert").alias(CHANGE)))


def row_digest(columns: Sequence[str]) -> tuple[Column, Column]:
    """128 bits of a row, in two halves. The hash passes over nulls, so which values are null goes in
    as well."""
    nulls = [F.col(f"`{c}`").isNull() for c in columns]
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*values, *nulls), F.xxhash64(F.lit(1), *nulls, *values)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What happened between two polls of one query, as change rows: the columns and ``op``.

    A row of the later poll is an ``insert`` or an ``update``; a row that no longer comes is a
    ``delete``, with its last values. Keys and digests alone are compared; the other columns move for
    rows that changed. Keys are unique in each poll; a null key is one like any other.
    """
    columns = after.columns

    def digests(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{side}_{i}") for i, k in enumerate(keys)],
                         F.struct(*row_digest(columns)).alias(f"{side}_row"))

    same = None
    for i in range(len(keys)):
        match = F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}"))
        same = match if same is None else same & match
    both = digests(before, "_old").join(digests(after, "_new"), same, "full_outer")
    op = (F.when(F.col("_old_row").isNull(), "insert").when(F.col("_new_row").isNull(), "delete")
          .when(F.col("_old_row") != F.col("_new_row"), "update"))
    changed = both.select(*[
        F.when(F.col("_new_row").isNull(), F.col(f"_old_{i}")).otherwise(F.col(f"_new_{i}")).alias(f"_key_{i}")
        for i in range(len(keys))], op.alias("op")).where("op IS NOT NULL")

    def rows(df: DataFrame, which: Column) -> DataFrame:
        on = None
        for i, key in enumerate(keys):
            match = df[key].eqNullSafe(F.col(f"_key_{i}"))
            on = match if on is None else on & match
        return df.join(changed.where(which), on).select(*[df[c] for c in columns], "op")

    return rows(after, F.col("op") != "delete").unionByName(rows(before, F.col("op") == "delete"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str],
            parent_key: str | Sequence[str]) -> DataFrame:
    """Child rows without a parent, by one column or several. A child that has a null among them
    refers to nothing, but is listed as well."""
    own = [child_key] if isinstance(child_key, str) else list(child_key)
    other = [parent_key] if isinstance(parent_key, str) else list(parent_key)
    return child.join(parent.select(*[F.col(p).alias(c) for c, p in zip(own, other, strict=True)]),
                      own, "left_anti")
