"""What several operators share: tables, ASCII text rules, written tables, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.session import scratch

#: The white space of the contracts, ``[\x20\x09-\x0D]``, and the A-Z they lower.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters beyond ASCII that ``lower`` would change too.
OTHER_CASED = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^\x00-\x7F]]"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, if they find it there."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only. ``lower`` is much the faster and right unless other capitals occur."""
    return F.when(text.rlike(OTHER_CASED), F.translate(text, UPPER, UPPER.lower())) \
        .otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; the rule that holds rows out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def with_column(df: DataFrame, make: Callable[[list], list], results: dict[str, str],
                column: str, rows: int = 256, done: Callable[[], None] = lambda: None,
                size: int | None = None) -> DataFrame:
    """``df`` with columns that ``make`` computes from lists of values of ``column``, on the
    executors: it returns one list for each of ``results`` (name -> type). All other columns pass
    through as they are; those with a result's name are replaced. ``done`` is called when a task's
    rows end, to give up what was remembered: workers outlive their tasks. With ``size`` slices of a text
    column are bounded in bytes as well."""
    df = df.drop(*[c for c in results if c != column])
    schema = StructType(list(df.schema.fields))
    for name, kind in results.items():
        schema = schema.add(name, kind)
    at = df.columns.index(column)
    kinds = [to_arrow_type(schema[name].dataType) for name in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                slices = by_size(batch, at, rows, size) if size else (
                    batch.slice(start, rows) for start in range(0, batch.num_rows, rows))
                for part in slices:
                    made = make(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))],
                        names=schema.names)
        finally:
            done()

    return df.mapInArrow(run, schema)


def by_size(batch: pa.RecordBatch, column: int, rows: int = 2048, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and of so many bytes of a text column but for a longer
    text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


#: Spark's setting by which a query's shuffle files go when it ends. Without it they stay until the driver
#: happens to collect its garbage in full, and those of all steps so far lie on the disks at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the shuffle files that
    the write needed go with it."""
    spark = df.sparkSession
    path = scratch(spark, f"llm-{name}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, at most one for each node it saw; batch by batch."""
    for batch in batches:
        forest = Forest()
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(u, v)
        nodes = [x for x in forest.parent if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())],
            names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` has two long columns.

    The component is the smallest node. Large-star and small-star steps alternate until nothing
    changes; the number of rounds grows with the logarithm of the diameter. All steps are minima
    and joins, so a hub with a third of all edges is one row after map-side aggregation.
    """
    u, v = edges.columns
    state = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
                   .mapInArrow(_contract, "u long, v long"), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                state.select("v", "v").distinct())
        seen = mark
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.union(least.select("u", "m")).distinct(), "stars")
