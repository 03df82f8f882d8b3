"""Delimited text with line breaks in quoted fields, read by several tasks a file (IO1, IO2).

A split of a file may begin inside a quoted field, which only what stands before it can tell. So the text is read by lines, in Spark's
ordinary splits, and

1. quotes are counted for each split (an aggregate of a row a split); the running sum over a file's splits says by its parity which
   splits begin inside quotes;
2. each task goes through its lines with that parity, puts lines of one record together and passes the others on as they are. Of a record that
   crosses a border of splits each task gives its part;
3. these parts, at most two a split, are put together by file and position;
4. records are parsed by Spark's own CSV expression.

Quotes must be balanced in every record, as when a quote inside a quoted field is doubled and other fields hold none. Lines end with ``\\n`` or
``\\r\\n``; breaks inside quotes stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiopanel.shipping import ship

_KIND = "file string, block long, part boolean, opens boolean, first boolean, text string"
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.bool_()), ("opens", pa.bool_()), ("first", pa.bool_()), ("text", pa.string())])


class _Split:
    """Lines of one split, in order: whole records, and the parts of those that cross its borders."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.begun = not inside  # whether the lines held belong to a record that began in this split
        self.held: list[str] = []
        self.first = block == 0

    def rows(self, texts, part: bool, opens: bool, first) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(self.file), n), pa.repeat(pa.scalar(self.block, pa.int64()), n), pa.repeat(pa.scalar(part), n),
            pa.repeat(pa.scalar(opens), n), pa.array(first, pa.bool_()), texts], schema=_SCHEMA)

    def add(self, lines: pa.Array):
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (int(self.inside) + np.cumsum(quotes)) % 2 == 1
        before = np.concatenate([[self.inside], after[:-1]])
        whole = ~before & ~after
        done, done_first = [], []
        for i in np.flatnonzero(~whole).tolist():
            if not before[i]:
                self.begun, self.opened_first = True, self.first and i == 0
            self.held.append(lines[i].as_py())
            if not after[i]:
                text = "\n".join(self.held)
                self.held = []
                if self.begun:
                    done.append(text)
                    done_first.append(self.opened_first)
                else:
                    yield self.rows(pa.array([text], pa.string()), True, False, [False])
                self.begun = True
        if done:
            yield self.rows(pa.array(done, pa.string()), False, True, done_first)
        first = np.zeros(int(whole.sum()), bool)
        if self.first and len(whole) and whole[0]:
            first[0] = True
        if len(first):
            yield self.rows(lines.filter(pa.array(whole)), False, True, first)
        self.inside, self.first = bool(after[-1]), False

    def close(self):
        if self.held:
            yield self.rows(pa.array(["\n".join(self.held)], pa.string()), True, self.begun, [self.begun and self.opened_first])


def read_records(spark: SparkSession, path) -> DataFrame:
    """``first, text``: the records of delimited files, and whether a record is its file's first."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One entry for each split that begins inside quotes: at most one for each maxPartitionBytes of input.
    inside = counts.withColumn("before", before).where("before % 2 = 1").select("file", "block").collect()
    shared = spark.sparkContext.broadcast({(r["file"], r["block"]) for r in inside})

    def run(batches):
        split = None
        for batch in batches:
            file, block, value = (batch.column(i) for i in range(3))
            blocks, codes = block.to_numpy(), file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if a == b:
                    continue
                name, start = file[a].as_py(), int(blocks[a])
                if split is None or (split.file, split.block) != (name, start):
                    if split is not None:
                        yield from split.close()
                    split = _Split(name, start, (name, start) in shared.value)
                yield from split.add(value.slice(a, b - a))
        if split is not None:
            yield from split.close()

    found = lines.mapInArrow(run, _KIND)
    # A file's records come from its splits; parts of a record follow each other by split, the one that opens it first.
    parts = found.where("part").withColumn("record", F.sum(F.col("opens").cast("long")).over(Window.partitionBy("file").orderBy("block", "opens")))
    joined = parts.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    records = found.where("not part").select("first", "text").unionByName(joined.select("first", "text"))
    return records.withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_quoted(spark: SparkSession, path, names, sep: str = ";", header: bool = True, surplus: str = "__surplus") -> DataFrame:
    """The records as text columns ``names``, and the first field beyond them as ``surplus``."""
    records = read_records(spark, path)
    if header:
        records = records.where("not first")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, surplus])
    options = {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
    return records.where("text <> ''").select(F.from_csv("text", schema, options).alias("r")).select("r.*")
