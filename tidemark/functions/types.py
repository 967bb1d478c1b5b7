"""Source column types and the Spark types they become."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type name, Spark SQL type. Anything else becomes a string.
SOURCE_TYPES = {
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "real": "float",
    "double precision": "double",
    "numeric": "decimal(18,4)",
    "decimal": "decimal(18,4)",
    "money": "decimal(18,2)",
    "varchar": "string",
    "character varying": "string",
    "char": "string",
    "character": "string",
    "text": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "date": "date",
    "time": "string",
    "uuid": "string",
    "bytea": "binary",
}
DEFAULT_TYPE = "string"

_SIZED = re.compile(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)")


def spark_type(source_type: str) -> str:
    """The Spark SQL type for a source type, any case, with its own precision if it has one."""
    name = source_type.strip().lower()
    sized = _SIZED.search(name)
    base = " ".join(_SIZED.sub(" ", name).split())
    if base in ("numeric", "decimal") and sized:
        return f"decimal({sized.group(1)},{sized.group(2) or 0})"
    return SOURCE_TYPES.get(base, DEFAULT_TYPE)


def spark_type_column(source_type: Column) -> Column:
    """:func:`spark_type` as an expression, for a catalogue that is itself a DataFrame."""
    name = F.lower(F.trim(source_type))
    base = F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+", " "))
    size = F.regexp_extract(name, _SIZED.pattern, 1)
    scale = F.regexp_extract(name, _SIZED.pattern, 2)
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return (
        F.when(base.isin("numeric", "decimal") & (size != ""),
               F.concat(F.lit("decimal("), size, F.lit(","),
                        F.when(scale == "", "0").otherwise(scale), F.lit(")")))
        .otherwise(F.coalesce(F.try_element_at(known, base), F.lit(DEFAULT_TYPE)))
    )


def table_schema(columns: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema from ordered ``(column, source type)`` pairs."""
    schema = T.StructType()
    for name, source_type in columns:
        schema.add(name, T.DataType.fromDDL(spark_type(source_type)), True)
    return schema
