"""Appending documents whose ids are unique in a collection (IO4): a document with a known id is refused.

The ids of a collection are kept apart from its documents, in a table bucketed by a hash of the id and sorted in each bucket
(``ids`` in the collection's folder). A batch is dealt to the same buckets and anti-joined with them: only the batch is shuffled, and the old
ids are read where they lie. Documents are written first and their ids after them. Should an application be lost in between,
:func:`rebuild_ids` makes the table anew from the documents.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel.session import materialize
from regiopanel.sources.collection import append_to_collection, read_collection, register, registered

#: Buckets of a new collection's ids. A collection keeps its number.
BUCKETS = 64


class Appended(NamedTuple):
    """Documents that were inserted, and those refused because their id was there (or came twice in the batch)."""

    inserted: int
    refused: int


def _buckets(spark: SparkSession, path: str, wanted: int) -> int:
    """The collection's number of buckets, set by its first unique append."""
    known = [e["ids"] for e in registered(spark, path) if "ids" in e]
    if not known:
        register(spark, path, {"ids": wanted})
    return min(known, default=wanted)


def id_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The name, in this session's catalog, of the collection's table of ids."""
    base = path.rstrip("/")
    n = _buckets(spark, base, buckets)
    name = "ids_" + hashlib.md5(base.encode()).hexdigest()[:16]
    place = f"{base}/ids".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (_id STRING) USING parquet "
              f"CLUSTERED BY (_id) SORTED BY (_id) INTO {n} BUCKETS LOCATION '{place}'")
    return name


def _remember(ids: DataFrame, table: str) -> None:
    spark = ids.sparkSession
    n = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])
    # A task for each bucket: a file for each of them, not for each pair of a task and a bucket.
    ids.repartition(n, "_id").write.insertInto(table)
    spark.catalog.refreshTable(table)


def refuse_known(batch: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The documents of ``batch`` whose ``_id`` the collection doesn't hold, one for each id."""
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c != "_id"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    # Of equal ids one stays, whatever the partitioning; each task passes on one for an id that very many rows share.
    once = batch.groupBy("_id").agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    once = once.select(*["_id" if c == "_id" else F.col(f"row.`{c}`") for c in batch.columns])
    return once.join(spark.table(id_table(spark, path, buckets)), "_id", "left_anti").select(*[F.col(f"`{c}`") for c in batch.columns])


def append_unique(df: DataFrame, path: str, buckets: int = BUCKETS, **options) -> Appended:
    """Append the documents of ``df`` whose ``_id`` is new, as :func:`append_to_collection` does.

    A document without an id (or a frame without the column) gets a generated one. Ids are compared as text. Of several documents with one
    id in ``df`` one is inserted. ``options`` are those of :func:`append_to_collection`.
    """
    spark = df.sparkSession
    known = F.col("_id").cast("string") if "_id" in df.columns else F.lit(None).cast("string")
    batch = materialize(df.withColumn("_id", F.coalesce(known, F.expr("uuid()"))), "unique-batch")
    fresh = materialize(refuse_known(batch, path, buckets), "unique-fresh")
    inserted = append_to_collection(fresh, path, **options)
    _remember(fresh.select("_id"), id_table(spark, path, buckets))
    return Appended(inserted, batch.count() - inserted)


def rebuild_ids(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Add the ids of documents that the table of ids lacks: after a lost application, or for a collection that
    was appended to without it."""
    table = id_table(spark, path, buckets)
    ids = read_collection(spark, path).select(F.col("_id").cast("string").alias("_id")).where("_id is not null").distinct()
    _remember(materialize(ids.join(spark.table(table), "_id", "left_anti"), "missing-ids"), table)
