"""Folders of a store: publish, list and remove, on whatever file system Spark's paths name."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a folder unless the target exists: of two writers one wins, and the other is told."""
    fs, conf = _hadoop(spark)
    context = fs.FileContext.getFileContext(fs.Path(target).toUri(), conf)
    context.mkdir(fs.Path(target).getParent(), None, True)
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(fs.Path(staged), fs.Path(target), options)
    except (Py4JJavaError, PySparkException) as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    fs, conf = _hadoop(spark)
    at = fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent. One listing, nothing is opened."""
    fs, conf = _hadoop(spark)
    at = fs.Path(path)
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at))

