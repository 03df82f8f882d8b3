"""Positions in a total order, without one task that sees all rows (O1, M8, V1).

Rows are dealt to ranges of the order and sorted in each; each range's rows are numbered by its task, counted, and the sums of the
counts before a range are added. The driver gets one count a range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiopanel.session import materialize


def with_positions(df: DataFrame, *order, name: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` with a last column ``name``: each row's place, from 1, by ``order`` (names or Columns such as ``F.desc("x")``).

    Rows that the order doesn't tell apart are numbered by their other columns' hash, so the numbers don't depend on partitioning, and a value that
    very many rows share is dealt to several ranges.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys: list[Column] = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order] + [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # The id of a row holds its place in the task's range in its lower 33 bits.
    dealt = dealt.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = materialize(dealt, "positions")
    counts = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    size = max(counts, default=0) + 1
    before = list(accumulate((counts.get(i, 0) for i in range(size)), initial=0))[:size]
    base = F.array(*[F.lit(b).cast("long") for b in before])[F.col("__range")]
    return dealt.withColumn(name, base + F.col("__at") + 1).drop("__range", "__at")
