"""Joins and set operations (J1, J2, U1, SC4, P10).

No join carries a broadcast hint: the optimizer broadcasts a side whose files are under
``autoBroadcastJoinThreshold``, and adaptive execution one whose measured shuffle output is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def left_join_keys(left: DataFrame, right: DataFrame, left_keys, right_keys=None,
                   how: str = "left") -> DataFrame:
    """J1 + SC4: equi-join on a composite key; the right key columns are renamed to the left
    names so a single copy survives (no ``YEAR_join`` left behind)."""
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = left_keys if right_keys is None else (
        [right_keys] if isinstance(right_keys, str) else list(right_keys))
    renamed = right
    for lk, rk in zip(left_keys, right_keys):
        if lk != rk:
            renamed = renamed.withColumnRenamed(rk, lk)
    return left.join(renamed, left_keys, how)


def keep_common(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` also occurs in ``other`` (left semi join).

    The other side is reduced to its distinct keys first (partial aggregation), so only the key
    set is shuffled; a semi join never multiplies rows.
    """
    other_key = other_key or key
    keys = other.select(F.col(other_key).alias(key)).distinct()
    return df.join(keys, key, "left_semi")


def intersect_values(a: DataFrame, b: DataFrame, column: str, b_column: str | None = None) -> DataFrame:
    """U1 + O4: the sorted distinct values of ``column`` present in both frames."""
    left = a.select(F.col(column))
    right = b.select(F.col(b_column or column).alias(column))
    return left.intersect(right).orderBy(column)
