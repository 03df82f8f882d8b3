"""Document collections on Parquet (IO4-IO7).

A collection is a folder with one subfolder (*group*) for each layout that was appended: a schema, the columns it is
partitioned by, and whether a stream writes it. Documents with other keys, or with other types for a key (a file whose numbers happen to be
whole, say), are therefore always readable: a scan reads each group with its own schema, widens
columns whose types differ and unions the groups by name, with null where a key is missing
(IO7). The groups and their schemas are named in the subfolder ``schemas``, written before a group's first rows, so no
folder is listed and no footer opened to find them, and partition columns keep their types. Filters and
projections are plain Columns and reach each group's Parquet scan as pushed filters and a pruned read
schema. A folder without ``schemas`` is plain Parquet.
"""

from __future__ import annotations

import functools
import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.session import path_exists, small_frame

#: Numeric types from narrow to wide; any other mixture of types becomes text.
_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def fingerprint(schema: T.StructType) -> str:
    """The name of a schema: equal for equal keys and types, in any order."""
    parts = sorted(f"{f.name}\x00{f.dataType.simpleString()}" for f in schema.fields)
    return hashlib.md5("\x01".join(parts).encode()).hexdigest()[:12]


def group_name(schema: T.StructType, partition_by=(), stream: bool = False) -> str:
    """The folder of a layout. Files of different layouts never share one."""
    name = f"types={fingerprint(schema)}"
    if partition_by:
        name += "-by-" + hashlib.md5("\x01".join(partition_by).encode()).hexdigest()[:8]
    return name + "-stream" * stream


def registered(spark: SparkSession, path: str) -> list[dict]:
    """What the collection's ``schemas`` folder says; nothing if there is none."""
    place = f"{path.rstrip('/')}/schemas"
    if not path_exists(spark, place):
        return []
    return [json.loads(r["value"]) for r in spark.read.text(place).distinct().collect()]


def register(spark: SparkSession, path: str, entry: dict) -> None:
    """Name something of the collection in its ``schemas`` folder."""
    small_frame(spark, [(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{path.rstrip('/')}/schemas")


def register_group(spark: SparkSession, path: str, schema: T.StructType, partition_by=(), stream: bool = False) -> str:
    """The folder for rows of this layout, named in the collection before its first rows are written."""
    name = group_name(schema, partition_by, stream)
    if name not in {e.get("group") for e in registered(spark, path)}:
        register(spark, path, {"group": name, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]).jsonValue()})
    return f"{path.rstrip('/')}/{name}"


def with_import_stamp(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """``_imported_at`` as ONE naive-UTC literal."""
    ts = (now or datetime.now(timezone.utc)).replace(tzinfo=None)
    return df.withColumn("_imported_at", F.to_timestamp_ntz(F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f"))))


def append_to_collection(df: DataFrame, path: str, batch_size: int | None = None, add_meta: bool = True,
                         now: datetime | None = None, partition_by=None, cluster_by=None, bloom=()) -> int:
    """IO4 + A9: append ``df`` to the collection and return the number of rows written.

    ``_imported_at`` is one stamp for the whole call, ``_id`` a generated
    uuid unless the frame has one. ``batch_size`` caps the rows per output file on request. The count comes
    from an ``Observation`` on the write itself, so no second job re-reads the data. The write
    goes through Spark's commit protocol: a lost executor's task is re-run and only committed
    attempts become visible. ``partition_by`` (e.g. the region) lays the files out by key, so a
    later scan filtering on it reads only the matching folders (partition pruning); an empty text in a
    partition column comes back as null. ``cluster_by`` deals the rows to files by ranges of these columns and sorts them, so
    that few row groups hold a value; ``bloom`` names columns whose row groups get a Bloom filter, for finds of single
    values that the ranges can't tell apart.
    """
    spark = df.sparkSession
    out = with_import_stamp(df, now) if add_meta else df
    if "_id" not in df.columns:
        out = out.withColumn("_id", F.expr("uuid()"))
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
    group = register_group(spark, path, out.schema, by)
    if cluster_by is not None:
        keys = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by)
        # The row hash as the last key splits a value that very many rows share.
        out = out.repartitionByRange(*[F.col(f"`{k}`") for k in keys], F.xxhash64("_id")).sortWithinPartitions(*[f"`{k}`" for k in keys])
    obs = Observation("collection_append")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer = out.write.mode("append")
    for name in [bloom] if isinstance(bloom, str) else bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    if batch_size:
        writer = writer.option("maxRecordsPerFile", str(int(batch_size)))
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(group)
    return int(obs.get["rows"])


# ---------------------------------------------------------------------------------------------
# Queries: a document lacking a field is like one whose field is null
# ---------------------------------------------------------------------------------------------

def _sure(c: Column) -> Column:
    """A condition that is false, not null, where a field is missing (needed under a negation)."""
    return F.coalesce(c, F.lit(False))


def _within(c: Column, values) -> Column:
    values = list(values)
    found = c.isin([v for v in values if v is not None])
    return found | c.isNull() if None in values else found


_OPS = {
    "$eq": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "$ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": _within,
    "$nin": lambda c, v: ~_sure(_within(c, v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v: c.rlike(v),
}


def _conditions(c: Column, cond) -> list[Column]:
    if not isinstance(cond, dict):
        return [_OPS["$eq"](c, cond)]
    out = []
    for op, v in cond.items():
        if op == "$not":
            out.append(~_sure(functools.reduce(lambda a, b: a & b, _conditions(c, v))))
        elif op in _OPS:
            out.append(_OPS[op](c, v))
        else:
            raise ValueError(f"unsupported operator {op}")
    return out


def query_to_column(query, columns=None) -> Column | None:
    """A filter given as a Column, or as a document query.

    Fields take a value or operators (``$eq $ne $gt $gte $lt $lte $in $nin $exists $regex $not``); ``$and``, ``$or`` and
    ``$nor`` take lists of queries. A missing field equals null, differs from any value and fails
    every comparison. A field that is in none of ``columns`` (if given) is missing everywhere.
    """
    if query is None:
        return None
    if isinstance(query, Column):
        return query
    preds = []
    for field, cond in query.items():
        if field in ("$and", "$or", "$nor"):
            parts = [p for p in (query_to_column(q, columns) for q in cond) if p is not None]
            if not parts:
                continue
            if field == "$and":
                preds.append(functools.reduce(lambda a, b: a & b, parts))
            elif field == "$or":
                preds.append(functools.reduce(lambda a, b: a | b, parts))
            else:
                preds.append(~functools.reduce(lambda a, b: a | b, map(_sure, parts)))
        elif field.startswith("$"):
            raise ValueError(f"unsupported operator {field}")
        else:
            known = columns is None or field in columns
            preds += _conditions(F.col(f"`{field}`") if known else F.lit(None).cast("string"), cond)
    return functools.reduce(lambda a, b: a & b, preds) if preds else None


def apply_projection(df: DataFrame, projection: dict | None) -> DataFrame:
    """Inclusion (``{f: 1}``, keeps ``_id`` unless ``_id: 0``; ``{"_id": 1}`` keeps the id alone) or
    exclusion (``{f: 0}``) projection."""
    if not projection:
        return df
    include = [f for f, v in projection.items() if v and f != "_id"]
    if include or projection.get("_id"):
        keep = include
        if projection.get("_id", 1) and "_id" in df.columns:
            keep = ["_id"] + include
        return df.select(*[F.col(f"`{f}`") for f in keep if f in df.columns])
    drop = [f for f, v in projection.items() if not v]
    return df.drop(*drop)


def stringify_id(df: DataFrame, column: str = "_id") -> DataFrame:
    """IO6: the document id as text (struct ids from dumps are decoded by ``decode_typed_json``)."""
    if column in df.columns:
        return df.withColumn(column, F.col(f"`{column}`").cast("string"))
    return df


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider of two numeric types (integral and fractional: double), else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WIDTH) and isinstance(b, _WIDTH):
        wide = max(a, b, key=lambda t: _WIDTH.index(type(t)))
        return T.DoubleType() if isinstance(wide, T.FloatType) and type(a) is not type(b) else wide
    if isinstance(a, (*_WIDTH, T.DecimalType)) and isinstance(b, (*_WIDTH, T.DecimalType)):
        return T.DoubleType()
    return T.StringType()


def _read_group(spark: SparkSession, path: str, entry: dict) -> DataFrame | None:
    schema, place = T.StructType.fromJson(entry["schema"]), f"{path.rstrip('/')}/{entry['group']}"
    if not path_exists(spark, place):  # named, but its first rows were never committed
        return None
    return spark.read.schema(schema).parquet(place).select(*[f"`{f.name}`" for f in schema.fields])


def read_collection(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """IO5 + IO7: all documents of a collection in one frame. ``merge_schema`` reads every footer of a plain
    Parquet folder whose files differ; groups of a collection don't need it."""
    named = {e["group"]: e for e in registered(spark, path) if "group" in e}  # two first appends at once may name a group twice
    entries = [named[g] for g in sorted(named)]
    if not entries:
        return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    groups = [df for df in (_read_group(spark, path, e) for e in entries) if df is not None]
    if not groups:
        return small_frame(spark, [], T.StructType.fromJson(entries[0]["schema"]))
    return widening_union(groups)


def collection_scan(spark: SparkSession, path: str, query=None, projection: dict | None = None,
                    limit: int | None = None, order_by=None, merge_schema: bool = False) -> DataFrame:
    """IO5: read a collection with an optional filter, projection and limit.

    ``order_by`` makes a limited scan deterministic (top-n of the order); without it a limit
    returns whichever documents the scan meets first, as a cursor limit does.
    """
    df = read_collection(spark, path, merge_schema)
    cond = query_to_column(query, df.columns)
    if cond is not None:
        df = df.filter(cond)
    df = stringify_id(apply_projection(df, projection))
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, (str, Column)) else order_by))
    if limit is not None:
        df = df.limit(int(limit))
    return df


def widening_union(frames) -> DataFrame:
    """:func:`ragged_union` of frames whose columns may differ in type; see :func:`widest`."""
    frames = list(frames)
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            types[f.name] = widest(types[f.name], f.dataType) if f.name in types else f.dataType
    return ragged_union([df.select(*[
        F.col(f"`{f.name}`") if f.dataType == types[f.name] else F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name)
        for f in df.schema.fields]) for df in frames])


def ragged_union(frames) -> DataFrame:
    """IO7: rows with different keys in one table; a key missing from a frame becomes null."""
    frames = list(frames)
    if not frames:
        raise ValueError("no frames")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
