"""Schema operators (SC1-SC7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNNAMED = re.compile(r"^(_c\d+|Unnamed: \d+)$")


def trim_names(df: DataFrame) -> DataFrame:
    """SC1: strip surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def safe_names(df: DataFrame, pattern: str = r"\.", repl: str = "_") -> DataFrame:
    """SC2: replace characters Spark paths trip over (dots by default: ``PM2.5`` -> ``PM2_5``).

    Pass ``pattern=r"[^0-9A-Za-z_]"`` to make any discovered category value a plain name.
    """
    rx = re.compile(pattern)
    new = [rx.sub(repl, c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"renaming would create duplicate columns: {new}")
    return df.toDF(*new)


def digit_columns(df: DataFrame) -> list[str]:
    """SC3: columns whose name is all digits (see :func:`trim_names` for padded ones), ordered as integers; error when none."""
    cols = [c for c in df.columns if c.isdigit()]
    if not cols:
        raise ValueError("no digit-named (year/period) columns found")
    return sorted(cols, key=int)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """SC7: drop ``_c<n>`` / ``Unnamed: <n>`` columns that hold no value in any row.

    One aggregate pass counts present values (null and NaN are absent) of the candidate columns
    only; the counters are partial-aggregated per task, so the pass is a plain distributed scan.
    """
    candidates = [c for c in df.columns if UNNAMED.match(c)]
    if not candidates:
        return df
    counts = []
    for i, name in enumerate(candidates):
        c = F.col(f"`{name}`")
        dtype = df.schema[name].dataType
        present = c.isNotNull()
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            present = present & ~F.isnan(c)
        elif isinstance(dtype, T.StringType):
            present = present & (F.trim(c) != F.lit(""))
        counts.append(F.count(F.when(present, F.lit(1))).alias(f"n{i}"))
    row = df.agg(*counts).first()
    empty = [name for i, name in enumerate(candidates) if row[f"n{i}"] == 0]
    return df.drop(*empty)


def profile_shape(df: DataFrame) -> DataFrame:
    """SC5: one-row frame ``(n_rows, n_cols)``; the row count is a distributed count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def preview(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """SC6: the first ``n`` rows; with ``order_by`` the result is deterministic (top-n sort)."""
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.limit(int(n))
