"""Rows in an order that keeps neighbours in several columns together, so that Parquet's own statistics
rule out most of a file for a filter on any of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each column is cut into two to the power of this many parts of equally many rows.
BITS = 6


def rank_among(column: str, points: Sequence, low: int = 0) -> Column:
    """How many of the sorted points are not above the value, by halving; null ranks lowest."""
    if not points:
        return F.lit(low)
    middle = len(points) // 2
    return F.when(F.col(column) >= F.lit(points[middle]), rank_among(column, points[middle + 1:], low + middle + 1)) \
        .otherwise(rank_among(column, points[:middle], low))


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of all ranks, the highest of each first: a place on the Z-order curve."""
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for i, rank in enumerate(ranks):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(ranks) + i))
    return place


def z_place(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of each row on the curve. Parts are cut at quantiles, from one sketch of all rows, so
    a value that very many rows have does not crowd the others into one part."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(c, shares, 1 << (bits + 5)).alias(f"p{i}")
                     for i, c in enumerate(columns)]).first()
    return interleaved([rank_among(c, sorted(set(found[i] or []))) for i, c in enumerate(columns)], bits)


def clustered(df: DataFrame, columns: Sequence[str], parts: int | None = None, bits: int = BITS) -> DataFrame:
    """The rows in ranges of the curve, sorted within each: one shuffle. Columns are numbers, dates or
    timestamps; ``parts`` is the number of ranges, by default what Spark makes of the size."""
    placed = df.withColumn("_z", z_place(df, columns, bits))
    ranged = placed.repartitionByRange(parts, "_z") if parts else placed.repartitionByRange("_z")
    return ranged.sortWithinPartitions("_z", *columns).drop("_z")
