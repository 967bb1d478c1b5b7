"""Change feeds: records in the shape of Kafka's source, as JSON text in ``value``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import ntz

# The columns Kafka's source gives that are used here.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])
JSON_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
_CORRUPT = "_corrupt_record"


def kafka_stream(spark: SparkSession, servers: str, topics: str,
                 max_offsets: int | None = None) -> DataFrame:
    """A Kafka subscription, from the earliest offset; its package must be on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        "key", "value", "topic", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def folder_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same records from a folder of Parquet files."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def row_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), JSON_OPTIONS)


def poll_records(df: DataFrame, topic: str, key: str, at: datetime) -> DataFrame:
    """One bulk poll: every row as a JSON record. Each poll repeats the whole query."""
    return df.select(
        F.col(key).cast("string").cast("binary").alias("key"),
        row_json(df).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        ntz(at).alias("timestamp"),
    )


def decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records with their decoded value in ``_row``, for :func:`rows_of` and :func:`rejects_of`.

    The value passes through a generator of one row, because a filter on a plain expression
    would be merged with it and parse every record again.
    """
    wide = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    options = dict(JSON_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    parsed = F.from_json(F.col("value").cast("string"), wide, options)
    return records.select("*", F.explode(F.array(parsed)).alias("_row"))


def fits() -> Column:
    """Of decoded records: whether the value fits the schema."""
    return F.col("_row").isNotNull() & F.col(f"_row.{_CORRUPT}").isNull()


def rows_of(decoded: DataFrame, schema: T.StructType) -> DataFrame:
    """Decoded values; other record columns stay beside them under a ``record_`` prefix."""
    rest = [c for c in decoded.columns if c not in ("key", "value", "_row")]
    return decoded.where(fits()).select(
        *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields],
        *[F.col(c).alias(f"record_{c}") for c in rest])


def rejects_of(decoded: DataFrame) -> DataFrame:
    """Records that do not fit the schema, as text."""
    rest = [c for c in decoded.columns if c not in ("key", "value", "_row")]
    return decoded.where(~fits()).select(F.col("value").cast("string").alias("value"), *rest)


def decode_each(records: DataFrame, routes: Sequence[tuple[str, T.StructType]]) -> DataFrame:
    """Records decoded for every ``(topic, schema)``, in one pass over them: for the route ``i`` whether
    its value fits in ``_fits_<i>``, null on other topics, and the fields in ``_<i>_<name>``. The text
    stays, as a string, where a route of the topic cannot take it or the topic has none.

    Values are flat columns and the text of what fits is left out, so the frame is small to hold.
    """
    rows = []
    for i, (topic, schema) in enumerate(routes):
        wide = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
        options = dict(JSON_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
        parsed = F.from_json(F.col("value").cast("string"), wide, options)
        rows.append(F.when(F.col("topic") == topic, parsed).alias(f"_{i}"))
    decoded = records.select("value", "topic", "timestamp", F.explode(F.array(F.struct(*rows))).alias("_rows"))
    kept, taken, known = [], F.lit(True), F.lit(False)
    for i, (topic, schema) in enumerate(routes):
        row, own = f"_rows._{i}", F.coalesce(F.col("topic") == topic, F.lit(False))
        fit = F.col(row).isNotNull() & F.col(f"{row}.{_CORRUPT}").isNull()
        kept += [F.when(own, fit).alias(f"_fits_{i}")] + [
            F.when(fit, F.col(f"{row}.{f.name}")).alias(f"_{i}_{f.name}") for f in schema.fields]
        taken, known = taken & (~own | fit), known | own
    text = F.when(~(taken & known), F.col("value").cast("string"))
    return decoded.select(text.alias("value"), "topic", "timestamp", known.alias("_known"), *kept)


def parse_records(records: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of one record schema."""
    decoded = decode(records, schema)
    return rows_of(decoded, schema), rejects_of(decoded)
