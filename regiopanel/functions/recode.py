"""Dictionary recoding with fallback (P9) and timestamp parsing."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiopanel.functions._col import as_col

# The region spelling map of the traffic table (source spelling -> pollutant-table spelling).
REGION_MAP = {
    "Niederoesterreich": "Niederoestereich",
    "Oberoesterreich": "Oberoestereich",
    "OESTERREICH": "AT",
}

# Entries up to which a dict goes into the plan as literals; a larger one travels as a table.
# The result is the same either way.
LITERAL_ENTRIES = 1000


def recode(c, mapping: dict) -> Column:
    """Exact, case-sensitive lookup; unmatched values pass through unchanged.

    The map is part of the expression and searched for every row, whatever its size: for a large
    dict :func:`recode_values` does the same with a join.
    """
    c = as_col(c)
    if not mapping:
        return c
    lookup = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(mapping.items())])
    return F.coalesce(lookup[c], c)


def recode_values(df: DataFrame, column: str, mapping: dict, out: str | None = None) -> DataFrame:
    """P9 on a frame: :func:`recode` for a small dict, :func:`recode_join` for a large one."""
    if len(mapping) <= LITERAL_ENTRIES:
        return df.withColumn(out or column, recode(F.col(f"`{column}`"), mapping))
    return recode_join(df, column, mapping_frame(df.sparkSession, mapping), out=out, unique=True)


def recode_join(df: DataFrame, column: str, table: DataFrame, src: str = "src", dst: str = "dst",
                out: str | None = None, unique: bool = False) -> DataFrame:
    """P9 for large maps: left join to a (src, dst) table, then coalesce with the original value.

    No broadcast hint: a recode table of unknown size must not be forced into every executor.
    Catalyst broadcasts it when its statistics are under ``autoBroadcastJoinThreshold`` and AQE
    converts the join at run time once the real size is known. The table must have unique
    ``src`` keys, otherwise the join would multiply rows; unless ``unique=True`` (a table built
    from a dict) duplicates are collapsed to one row (``min(dst)``) by a grouped pre-aggregation.
    """
    out = out or column
    if unique:
        keyed = table.select(F.col(src).alias("__rc_src"), F.col(dst).alias("__rc_dst"))
    else:
        keyed = (table.groupBy(F.col(src).alias("__rc_src"))
                 .agg(F.min(F.col(dst)).alias("__rc_dst")))
    joined = df.join(keyed, df[column] == keyed["__rc_src"], "left")
    return (joined.withColumn(out, F.coalesce(F.col("__rc_dst"), df[column]))
            .drop("__rc_src", "__rc_dst"))


def mapping_frame(spark, mapping: dict, src: str = "src", dst: str = "dst") -> DataFrame:
    """A (src, dst) DataFrame from a Python dict, for :func:`recode_join`.

    A small dict is literals in the plan, a large one local rows. No hint: the optimizer and
    adaptive execution know the bytes of either.
    """
    from regiopanel.session import small_frame

    schema = f"{src} string, {dst} string"
    if len(mapping) <= LITERAL_ENTRIES:
        return small_frame(spark, list(mapping.items()), schema)
    return spark.createDataFrame(list(mapping.items()), schema)


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """ISO text (``2025-12-05T00:00``, with or without seconds) -> timestamp without zone."""
    c = as_col(c)
    return F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
