"""Landed payload files as a stream (IO3 + IO4 with Structured Streaming).

The reference fetches one payload and flattens it in memory. Here payload documents land as JSON
files in a folder; a file stream picks up new files, flattens them with the same ``payload_rows``
expression (a narrow map, so it runs unchanged on a stream), and each micro-batch is appended to
a collection with its own import stamp.

Exactly-once effect: ``foreachBatch`` may replay a micro-batch after a failure, so every batch
writes (overwrite mode) to its own folder, named by its stream and its epoch. A replay replaces that
folder instead of appending the rows twice; another stream has another folder. A stream is its
checkpoint: the offsets live there, so it has no default, and so does the stream's id, which Spark draws when it
makes the checkpoint. A new checkpoint at an old path is a new stream: it reads all files again, and overwrites nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from regiopanel.sources.collection import register_group, with_import_stamp
from regiopanel.sources.payload import payload_rows


def payload_stream(spark: SparkSession, landing_dir: str, schema: T.StructType, keep=None,
                   multi_line: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame of payload rows (time first) from JSON files landing in ``landing_dir``."""
    reader = spark.readStream.schema(schema).option("multiLine", str(multi_line).lower())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(int(max_files_per_trigger)))
    return payload_rows(reader.json(landing_dir), keep=keep, order_by_time=False)


def land_payloads(spark: SparkSession, landing_dir: str, schema: T.StructType, collection_path: str,
                  checkpoint_location: str, keep=None, batch_size: int | None = None,
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the stream landing -> rows -> collection. ``available_now`` processes what is there
    and stops (a scheduled batch job with stream bookkeeping); otherwise it runs continuously.

    ``checkpoint_location`` names the stream: give the same folder to go on where it stopped, another one for
    another stream into the same collection.
    """
    rows = payload_stream(spark, landing_dir, schema, keep=keep)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the stream's id is not known here: rows could overwrite those of another stream")
        out = with_import_stamp(batch).withColumn("_id", F.expr("uuid()"))
        schema = T.StructType([*out.schema.fields, T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType())])
        group = register_group(session, collection_path, schema, stream=True)
        writer = out.write.mode("overwrite")
        if batch_size:
            writer = writer.option("maxRecordsPerFile", str(int(batch_size)))
        writer.parquet(f"{group}/stream={stream}/epoch={int(epoch_id)}")

    writer = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
