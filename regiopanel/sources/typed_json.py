"""Typed document dumps (IO6, IO10).

Dumps wrap typed values in one-key objects: ``{"$oid": "..."}`` for ids, ``{"$date": "...Z"}``
for UTC instants and ``{"$numberDouble": "NaN"}`` / ``$numberLong`` / ``$numberInt`` for numbers
JSON cannot spell. ``read_document_dump`` loads a dump and unwraps every such field with plain
Column expressions. A one-array-per-file dump needs ``multi_line=True`` and is read one file per
task; JSON-lines dumps are split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The one-key wrapper names of typed JSON and the Spark type each decodes to.
WRAPPERS = {
    "$oid": "string",
    "$date": "timestamp_ntz",
    "$numberDouble": "double",
    "$numberLong": "bigint",
    "$numberInt": "int",
    "$numberDecimal": "double",
}


def _utc_text_to_ntz(text: Column) -> Column:
    """ISO-8601 UTC text ('2026-01-09T12:59:11.483Z') -> naive UTC timestamp."""
    return F.to_timestamp_ntz(F.regexp_replace(text, r"(Z|\+00:?00)$", ""))


def _decode(c: Column, dtype: T.DataType) -> Column | None:
    if not isinstance(dtype, T.StructType) or len(dtype.fields) != 1:
        return None
    inner = dtype.fields[0]
    if inner.name not in WRAPPERS:
        return None
    value = c.getField(inner.name)
    if inner.name == "$date":
        if isinstance(inner.dataType, T.StructType):  # {"$date": {"$numberLong": "<ms>"}}
            millis = value.getField("$numberLong").cast("bigint")
            # epoch milliseconds -> naive UTC, with no detour through the session time zone
            return F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return _utc_text_to_ntz(value.cast("string"))
    return value.cast(WRAPPERS[inner.name])


def decode_typed_json(df: DataFrame) -> DataFrame:
    """IO10: unwrap every top-level ``{"$oid"|"$date"|"$number*": v}`` field; ids become text (IO6)."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        decoded = _decode(c, field.dataType)
        cols.append((decoded if decoded is not None else c).alias(field.name))
    return df.select(*cols)


def read_document_dump(spark: SparkSession, path, multi_line: bool = True, schema=None) -> DataFrame:
    """Load a typed dump (one JSON array per file, or JSON lines) and decode it."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return decode_typed_json(reader.json(path))
