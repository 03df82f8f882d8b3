"""Documents whose fields have conflicting types, kept as they are (IO7, IO10).

A document is one VARIANT value: a field that is a number here, text there and an object elsewhere keeps each type, and is stored so
in Parquet. Typed columns come out by path; a value of another type is null there, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mixed_documents(spark: SparkSession, path, column: str = "doc") -> DataFrame:
    """JSON lines as one VARIANT column; malformed lines are null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(column))


def kind_of(doc, field: str) -> Column:
    """The type of a field as Spark writes it (``BIGINT``, ``DOUBLE``, ``DECIMAL(..)``, ``STRING``, ``OBJECT<..>``, ``VOID`` for JSON's null); null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))


def typed_field(doc, field: str, kind: str) -> Column:
    """A field as ``kind`` (``double``, ``string``, ``bigint``, ...) where its value is of that sort: numbers for numeric kinds, text for
    ``string``, truth values for ``boolean``. Null elsewhere: text is not read as a number, and a number is not written as text."""
    sort = {"string": "STRING", "boolean": "BOOLEAN"}.get(kind)
    here = kind_of(doc, field)
    fits = here == sort if sort else here.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(fits, F.try_variant_get(doc, f"$.{field}", kind))


def field_schema(df: DataFrame, column: str = "doc") -> str:
    """One schema for all documents: fields of conflicting types are ``VARIANT`` in it. One aggregate, combined in each task."""
    return df.agg(F.schema_of_variant_agg(column)).first()[0]
