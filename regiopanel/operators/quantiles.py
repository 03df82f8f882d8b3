"""Exact order statistics of all groups at once, without a buffer per group.

Radix selection over values. The first digit of a value is its sign and binary exponent; further digits halve the range that is left
into ``BINS`` equal parts. A pass counts values per (group, range, digit), combined in each task, and a running sum over the digits
of a range says in which one a wanted rank lies. The range becomes that digit's least and largest value, so it shrinks in every pass, and
the search ends when both are equal. All groups and ranks share the passes: about four to seven for measured values, whatever the
number of groups; only a "go on" flag reaches the driver. A group that a third of the rows share is as good as any other.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import materialize

#: Parts of a range in a pass.
BINS = 1024


def _first_digit(x: Column) -> Column:
    """Sign and exponent as a number that never falls as ``x`` grows."""
    size = F.when(F.abs(x) == F.lit(float("inf")), 3000).otherwise(F.floor(F.log2(F.abs(x))).cast("int") + 1200)
    return F.when(x == 0, 0).when(x < 0, -size).otherwise(size)


def _find(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks with the range of the cell they lie in; ``rest`` is the rank within the cell."""
    side = Window.partitionBy(*keys).orderBy("digit")
    cells = cells.withColumn("upto", F.sum("n").over(side.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.select(*keys, F.col("n").alias("cell_n"), F.col("upto").alias("cell_upto"), F.col("least").alias("cell_lo"), F.col("most").alias("cell_hi"))
    inside = (F.col("rest") < F.col("cell_upto")) & (F.col("rest") >= F.col("cell_upto") - F.col("cell_n"))
    return cells.join(wanted, keys).where(inside).select(
        "g", "rank", (F.col("rest") - (F.col("cell_upto") - F.col("cell_n"))).alias("rest"), F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"))


def order_statistics(rows: DataFrame, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """``g, rank, value, rest``: the value at each wanted rank (from 0) of ``rows`` (``g, x``: group and double, no null or NaN);
    ``rest`` is its place, from 0, among the group's equal values.

    ``ranks`` has ``g`` and ``rank`` (each below the group's number of rows). Rows are read once for each pass.
    """
    summary = [F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")]
    cells = materialize(rows.groupBy("g", _first_digit(F.col("x")).alias("digit")).agg(*summary), "order-cells")
    open_ = materialize(_find(cells, ranks.select("g", "rank", F.col("rank").alias("rest")), ["g"]), "order-ranges")
    done = [open_.where("lo = hi")]
    while True:
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.select("g", "lo", "hi").distinct()
        own = rows.join(ranges, "g").where("x between lo and hi")
        digit = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
        cells = materialize(own.groupBy("g", "lo", "hi", digit.alias("digit")).agg(*summary), "order-cells")
        open_ = materialize(_find(cells, open_, ["g", "lo", "hi"]), "order-ranges")
        done.append(open_.where("lo = hi"))
    return functools.reduce(DataFrame.unionByName, done).select("g", "rank", F.col("lo").alias("value"), "rest")


def keyed(df: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """``df`` with a text column ``g`` for its keys, and the table of keys by ``g`` (null apart from any value)."""
    g = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys]))
    df = df.withColumn("g", g)
    return df, df.groupBy("g").agg(*[F.first(f"`{k}`").alias(k) for k in keys])


def group_quantiles(df: DataFrame, keys, column: str, probs=(0.25, 0.5, 0.75), bins: int = BINS) -> DataFrame:
    """The keys, ``n`` (values that are neither null nor NaN) and one column ``p<percent>`` for each of ``probs``, interpolated
    linearly as ``percentile`` does. Groups without a value have nulls. ``df`` may not have a column ``g``."""
    keys, probs = ([keys] if isinstance(keys, str) else list(keys)), list(probs)
    x = F.col(f"`{column}`").cast("double")
    rows, names = keyed(df.select(*[f"`{k}`" for k in keys], F.when(~F.isnan(x), x).alias("x")), keys)
    rows = materialize(rows, "quantile-rows")
    sizes = materialize(rows.groupBy("g").agg(*[F.first(f"`{k}`").alias(k) for k in keys], F.count("x").alias("n")), "quantile-sizes")
    place = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])
    place = sizes.where("n > 0").select("g", "n", F.explode(place).alias("p")).select(
        "g", F.col("p.i").alias("i"), F.floor("p.h").alias("lower"), F.least(F.floor("p.h") + 1, F.col("n") - 1).alias("upper"),
        (F.col("p.h") - F.floor("p.h")).alias("part"))
    ranks = place.select("g", F.explode(F.array("lower", "upper")).alias("rank")).distinct()
    found = order_statistics(rows.where("x is not null").select("g", "x"), ranks, bins)
    at = lambda side, name: found.select("g", F.col("rank").alias(side), F.col("value").alias(name))
    place = place.join(at("lower", "a"), ["g", "lower"]).join(at("upper", "b"), ["g", "upper"])
    value = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    wide = place.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, value)).alias(f"p{100 * p:g}".replace(".", "_")) for i, p in enumerate(probs)])
    return sizes.join(wide, "g", "left").drop("g")
