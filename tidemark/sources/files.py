"""File sources: explicit paths, a report of data files, objects, change-record folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_paths(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None,
               base: str | None = None) -> DataFrame:
    """Parquet from an explicit list of files; ``base`` keeps partition columns."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if base is not None:
        reader = reader.option("basePath", base)
    return reader.parquet(*paths)


def try_read(spark: SparkSession, path: str, schema: T.StructType | None = None):
    """The Parquet folder, or None where it does not exist; any other failure is raised."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def has_rows(df: DataFrame) -> bool:
    """Whether there is any row; stops at the first."""
    return not df.isEmpty()


def file_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and value range of each data file: ``file, rows, min_<c>, max_<c>``.

    Only the named columns are read. Files are reduced inside each task first, so what is
    exchanged is one row per file and task.
    """
    ranges = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), *ranges)


def object_report(spark: SparkSession, root: str, expected: DataFrame, key: Column) -> DataFrame:
    """Read every object under ``root`` whole and compare with the expected keys.

    ``key`` turns ``path`` into the value of ``expected.key``; an object in several files, and an
    expected key given twice, count once. Tasks read objects side by side; only sizes leave a task.
    """
    read = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(key.alias("key"), F.length("content").cast("long").alias("bytes"))
        .groupBy("key").agg(F.sum("bytes").alias("bytes"))
    )
    return expected.select("key").distinct().join(read, "key", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("bytes").alias("success"),
        F.sum(F.when(F.col("bytes").isNull(), 1).otherwise(0)).alias("missing"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
