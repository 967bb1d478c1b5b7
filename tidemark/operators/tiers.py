"""Splitting a table into tiers and reading the tiers as one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import row_digest

BATCH = "_batch_id"


def as_column(predicate: Column | str) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def split_tiers(df: DataFrame, cold: Column | str) -> tuple[DataFrame, DataFrame]:
    """``(hot, cold)``: rows for which the predicate is not true, NULL included, stay hot.

    The complement is written so that, for comparisons, the scan can prune by it too.
    """
    condition = as_column(cold)
    return df.where(~condition | condition.isNull()), df.where(condition)


def hybrid(hot: DataFrame, cold: DataFrame | None = None, committed: int | None = None,
           keys: Sequence[str] = ()) -> DataFrame:
    """One table over both tiers; filters, columns and limits pass through to each scan.

    A move appends to cold before it deletes from hot, so in between a row is in both tiers.
    With ``committed`` each row is still read once, in one of two ways:

    * without ``keys``, cold batches after ``committed`` are skipped (a partition filter): right
      where ``hot`` is the version published with that batch;
    * with ``keys``, all of cold is read and hot rows already present in a later batch are
      dropped. Right at any moment for a live hot store. Only the batches in flight are compared,
      so the anti-join does not grow with cold.

    ``cold=None`` means that the table has never been moved: hot is all there is.
    """
    if cold is None:
        return hot
    if committed is not None and not keys:
        cold = cold.where(F.col(BATCH) <= committed)
    elif committed is not None:
        in_flight = cold.where(F.col(BATCH) > committed).select(*keys)
        hot = hot.join(in_flight, list(keys), "left_anti")
    if BATCH in cold.columns and BATCH not in hot.columns:
        cold = cold.drop(BATCH)
    return hot.unionByName(cold, allowMissingColumns=True)


#: Keys of a selective side that are sent to a scan as a filter.
FEW_KEYS = 10_000


def few_keys(rows: DataFrame, on: Sequence[str], limit: int = FEW_KEYS) -> list | None:
    """The distinct keys of some rows, none with a null, if there are at most ``limit``."""
    keys = rows.select(*on).na.drop().distinct().limit(limit + 1).collect()
    return keys if len(keys) <= limit else None


def reduced(df: DataFrame, rows: DataFrame, on: Sequence[str], limit: int = FEW_KEYS) -> DataFrame:
    """The part of ``df`` that can meet ``rows`` in an equi-join on ``on``.

    The distinct keys of the selective side are counted first: up to ``limit`` they become a filter
    that the scan of ``df`` sees, beyond that ``df`` stays whole and the join decides. Use it for the
    tier that is dear to read; the join itself still follows.
    """
    keys = few_keys(rows, on, limit)
    if keys is None:
        return df
    if len(on) == 1:
        return df.where(F.col(on[0]).isin([k[0] for k in keys]))
    listed = df.sparkSession.createDataFrame(keys, df.select(*on).schema)
    return df.join(F.broadcast(listed), list(on), "left_semi").select(*df.columns)


def tier_concat(query: Callable[[DataFrame], DataFrame], hot: DataFrame,
                cold: DataFrame) -> DataFrame:
    """Run the query on each tier and concatenate the two results.

    Equal to querying the hybrid table only for row-wise queries (filter, projection); an
    aggregate returns one row per tier.
    """
    return query(hot).unionAll(query(cold))


def register_hybrid(tables: dict[str, DataFrame]) -> None:
    """Name each hybrid table, so that any Spark SQL over the names runs unchanged."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: how many rows ``actual`` misses and how many it has too many.

    Both sides are signed and summed in one aggregation, so each row is shuffled at most once
    and equal rows collapse before the shuffle.
    """
    columns = expected.columns
    signed = expected.withColumn("_sign", F.lit(1)).unionAll(
        actual.select(*columns).withColumn("_sign", F.lit(-1)))
    balance = signed.groupBy(*columns).agg(F.sum("_sign").alias("_n"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("extra"),
    )


def bucket_digests(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """``bucket, rows`` and the digest of the multiset of rows of each bucket: the sums of the four
    32-bit quarters of its rows' 128 bits, which tell repeated rows too. A bucket may have 2^31 rows."""
    a, b = row_digest(columns)
    hashed = df.select(F.pmod(a, F.lit(buckets)).cast("int").alias("bucket"), a.alias("a"), b.alias("b"))
    low = F.lit(0xFFFFFFFF)
    sums = [F.sum(part).alias(f"s{i}") for i, part in enumerate((
        F.col("a").bitwiseAND(low), F.shiftrightunsigned("a", 32),
        F.col("b").bitwiseAND(low), F.shiftrightunsigned("b", 32)))]
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *sums)


def differing_buckets(expected: DataFrame, actual: DataFrame, buckets: int) -> list[int]:
    """Buckets whose rows are not the same on both sides; at most ``buckets`` numbers."""
    columns = expected.columns
    sides = [bucket_digests(df, columns, buckets).select(
        "bucket", F.struct("rows", "s0", "s1", "s2", "s3").alias(name))
        for df, name in ((expected, "x"), (actual, "y"))]
    unequal = sides[0].join(sides[1], "bucket", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return sorted(r.bucket for r in unequal.select("bucket").collect())


def tier_diff(expected: DataFrame, actual: DataFrame, buckets: int = 1024) -> DataFrame:
    """As :func:`multiset_diff`, moving whole rows only where there is a difference: both sides are
    digested by bucket, and rows are compared in the buckets that differ."""
    columns = expected.columns
    types = dict(expected.dtypes)
    if any(types[c] != t for c, t in actual.select(*columns).dtypes):
        return multiset_diff(expected, actual)  # equal values of unlike types hash unlike
    differ = differing_buckets(expected, actual, buckets)
    own = F.pmod(row_digest(columns)[0], F.lit(buckets)).isin(*differ) if differ else F.lit(False)
    return multiset_diff(expected.where(own), actual.where(own))
