"""Column-array payloads -> rows (IO3, R4, P11).

A payload is a document ``{"hourly": {"time": [...], "<variable>": [...], ...}, <keys>...}``.
Each document is exploded into one row per array position. Documents are independent, so the
work is a narrow map over the scanned files: no shuffle unless time order is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.functions.recode import parse_timestamp


def payload_schema(variables: dict[str, str], keys: dict[str, str] | None = None,
                   array_field: str = "hourly", time_field: str = "time") -> T.StructType:
    """Schema of a payload document: ``keys`` at top level, arrays of ``variables`` under ``array_field``."""
    inner = [T.StructField(time_field, T.ArrayType(T.StringType()))]
    inner += [T.StructField(k, T.ArrayType(T._parse_datatype_string(v))) for k, v in variables.items()]
    fields = [T.StructField(k, T._parse_datatype_string(v)) for k, v in (keys or {}).items()]
    fields.append(T.StructField(array_field, T.StructType(inner)))
    return T.StructType(fields)


def read_payloads(spark: SparkSession, path, schema: T.StructType | None = None,
                  multi_line: bool = False) -> DataFrame:
    """Landed payload JSON files. Give ``schema`` to skip the inference pass over the files."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def payload_rows(df: DataFrame, array_field: str = "hourly", time_field: str = "time",
                 keep: list[str] | None = None, order_by_time: bool = True) -> DataFrame:
    """IO3: one row per array position; ``time`` parsed and first, other arrays as columns.

    Arrays of unequal length raise (T15) instead of being padded with nulls; a variable that a
    document doesn't have is a null column for its rows. ``keep`` carries
    top-level document fields onto every row. A frame without ``array_field`` gives an empty
    frame with only ``time``. ``order_by_time`` sorts the result (a range-partitioned sort);
    turn it off for streams or when the consumer does not need the order.
    """
    keep = list(keep or [])
    if array_field not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([], T.StructType([T.StructField(time_field, T.TimestampNTZType())]))
    inner = df.schema[array_field].dataType
    names = inner.fieldNames()
    if time_field not in names:
        raise ValueError(f"payload has no '{time_field}' array")
    others = [n for n in names if n != time_field]
    ordered = [time_field] + others
    staged = df.select(*[F.col(f"`{k}`") for k in keep],
                       *[F.col(f"`{array_field}`.`{n}`").alias(f"__arr{i}") for i, n in enumerate(ordered)])
    arrays = [F.col(f"__arr{i}") for i in range(len(ordered))]
    rows = F.coalesce(F.size(arrays[0]), F.lit(-1))  # a document with values but no times fails the check
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (a.isNull() | (F.size(a) == rows))
    full = [arrays[0]] + [F.coalesce(a, F.array_repeat(F.lit(None).cast(inner[n].dataType.elementType), F.greatest(rows, F.lit(0))))
                          for a, n in zip(arrays[1:], others)]
    checked = F.when(same, F.arrays_zip(*full)).otherwise(
        F.raise_error(F.lit(f"payload arrays under '{array_field}' differ in length")))
    exploded = staged.select(*[F.col(f"`{k}`") for k in keep], F.inline(checked))
    renamed = exploded.toDF(*keep, *ordered)
    out = renamed.select(parse_timestamp(F.col(f"`{time_field}`")).alias(time_field),
                         *[F.col(f"`{n}`") for n in others], *[F.col(f"`{k}`") for k in keep])
    if order_by_time:
        # the row hash last lets range boundaries split a timestamp shared by very many rows
        ties = F.xxhash64(*[F.col(f"`{c}`") for c in out.columns])
        out = out.orderBy(*[F.col(f"`{k}`") for k in keep], F.col(f"`{time_field}`"), ties)
    return out


def payload_dict_rows(spark: SparkSession, payload: dict, array_field: str = "hourly",
                      time_field: str = "time", order_by_time: bool = True) -> DataFrame:
    """IO3 for one payload already in memory (a fetched response): the same rows as
    :func:`payload_rows` on a landed file. The JSON text is parsed by ``from_json`` in the JVM.

    Meant for a single response; bulk payloads should land as files and go through
    :func:`read_payloads`, which splits them across tasks.
    """
    import json

    from regiopanel.session import small_frame

    text = json.dumps(payload)
    doc = small_frame(spark, [(text,)], "doc string")
    schema = spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first()["s"]
    parsed = doc.select(F.from_json("doc", schema).alias("d")).select("d.*")
    return payload_rows(parsed, array_field, time_field, order_by_time=order_by_time)
