"""Null handling."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    """Per-column fill; for float columns NaN is filled too (T17: missing traffic -> 0.0)."""
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.na.fill(present) if present else df


def drop_incomplete(df: DataFrame, subset) -> DataFrame:
    """Drop rows with null (or NaN) in any of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))
