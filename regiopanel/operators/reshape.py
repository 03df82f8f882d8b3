"""Reshape operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.operators.order import with_positions
from regiopanel.operators.schema import digit_columns, safe_names
from regiopanel.session import materialize


def unpivot_digit_columns(df: DataFrame, ids, name_col: str = "YEAR", value_col: str = "value",
                          name_type: str | None = "int") -> DataFrame:
    """R1 + SC3: wide year/period columns -> (ids..., name, value); null values are KEPT.

    The value columns are unified to string first (the wide table is text), so ``unpivot`` has
    a common type. A narrow, per-row expand: no shuffle.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    cols = digit_columns(df)
    types = dict(df.dtypes)
    if all(types[c] == "string" for c in cols):  # already text: no re-projection of the wide plan
        staged = df
    else:
        staged = df.select(*[F.col(f"`{i}`") for i in ids],
                           *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = staged.unpivot(ids, cols, name_col, value_col)
    if name_type:
        long = long.withColumn(name_col, F.col(name_col).cast(name_type))
    return long


def pivot_categories(df: DataFrame, keys, category: str, value: str, values=None,
                     agg: str = "avg", safe: str | None = None) -> DataFrame:
    """R2 (+A2, A3): one column per category holding ``agg(value)`` per key.

    Give ``values`` (the label list) to skip the extra distinct job that discovers them and to
    keep the columns stable when a category is absent; with values, avg/sum/min/max are one
    grouped aggregate of conditional values, partial per task (map-side) and one shuffle on
    ``keys``. ``safe`` is a regex of characters to replace in
    the new column names (see ``safe_names``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    fn = getattr(F, agg)
    if values is not None and agg in ("avg", "sum", "min", "max"):
        # One grouped aggregate of conditional values: a single partial aggregation and shuffle
        # (pivot plans a second aggregation by key). A cell with no rows stays null, as in pivot.
        cat = F.col(category)
        out = df.groupBy(*keys).agg(*[fn(F.when(cat == F.lit(v), F.col(value))).alias(str(v)) for v in values])
    else:
        grouped = df.groupBy(*keys)
        pivoted = (grouped.pivot(category, list(values)) if values is not None else grouped.pivot(category))
        out = pivoted.agg(fn(F.col(value)))
    return safe_names(out, safe) if safe else out


def metric_matrix(metrics: DataFrame, row: str = "region", col: str = "pollutant", value: str = "r2",
                  values=None, safe: str | None = r"[^0-9A-Za-z_]") -> DataFrame:
    """``row`` x ``col`` grid of ``value`` (one metric per cell), rows sorted.

    With ``values`` the grid is one grouped aggregate of conditional values (``max`` of the single
    value per cell); without, ``pivot`` discovers the columns first.
    """
    if values is not None:
        c = F.col(col)
        out = metrics.groupBy(row).agg(*[F.max(F.when(c == F.lit(v), F.col(value))).alias(str(v))
                                         for v in values]).orderBy(row)
    else:
        out = metrics.groupBy(row).pivot(col).agg(F.first(F.col(value))).orderBy(row)
    return safe_names(out, safe) if safe else out


#: Categories of a block of a pivot in blocks.
PIVOT_BLOCK = 4096


def pivot_blocks(df: DataFrame, keys, category: str, value, block: int = PIVOT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """R2 for unknown and very many categories: a matrix in blocks of columns, and the dictionary of its columns.

    ``value`` is an aggregate Column such as ``F.sum("x")``. Returns ``(cells, columns)``: ``cells`` has the keys, ``block`` and ``cells``, a map
    from column number to value for the at most ``block`` columns of that block that the row has; ``columns`` has ``column`` (from 0, in the
    order of the categories) and ``category`` (null included, first). No row grows with the number of categories, and
    none is looked at by the driver.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = with_positions(df.select(F.col(f"`{category}`").alias("category")).distinct(), "category", name="column")
    names = materialize(names.select((F.col("column") - 1).alias("column"), "category"), "pivot-columns")
    found = df.groupBy(*keys, F.col(f"`{category}`").alias("category")).agg(value.alias("__value"))
    found = found.join(names, found["category"].eqNullSafe(names["category"]))
    cell = F.struct(F.col("column"), F.col("__value"))
    cells = found.groupBy(*keys, F.floor(F.col("column") / block).cast("long").alias("block")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(cell))).alias("cells"))
    return cells, names
