"""Derived frames over the driver's test tables.

The regional panel of the reference maps onto the star schema as:
  measure   (region, period, category, value)   ~ pollutant values per region and year
  exposure  (region, period, exposure)          ~ road traffic per region and year
  scored    (region, pollutant, period, actual, predicted) ~ model predictions
Periods are ``year * 100 + month`` (bigint), because the data spans only seven calendar years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel.session import materialize

# The order priorities of the test data, used as the category (label) list.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def period_of(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("bigint")


def round_to(c: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value: ``round(x * 10^d) / 10^d``.

    The same formula in the DuckDB oracle gives bit-identical results (``F.round(x, d)`` rounds
    the shortest decimal text instead, which differs on exact ties).
    """
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)


# The fact tables meet their dimensions one after another (a left-deep star): each dimension is a
# scan whose size the optimizer knows, so it is broadcast under ``autoBroadcastJoinThreshold`` and
# joined by a shuffle beyond it, where AQE splits a hot key's partition.

def with_region(df: DataFrame, spark: SparkSession, sf_dir: str, nation_key: str) -> DataFrame:
    """``df`` with ``n_name`` and ``r_name`` of its nation key."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (df.join(nation, F.col(nation_key) == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey))


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, n_name, r_name): customers with their nation and region."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return with_region(customer, spark, sf_dir, "c_nationkey").select("c_custkey", "n_name", "r_name")


def lines_with_regions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem columns with ``n_name`` and ``r_name`` of the line's supplier."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_suppkey", *columns)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
    return with_region(lines, spark, sf_dir, "s_nationkey").select(*columns, "n_name", "r_name")


def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation x region -> (region, period, category, value).

    A star join: orders are not shuffled where customer is small enough to be broadcast.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return (with_region(joined, spark, sf_dir, "c_nationkey")
            .select(F.col("r_name").alias("region"), period_of(F.col("o_orderdate")).alias("period"),
                    F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("value")))


def exposure_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of ``l_extendedprice`` per supplier region and ship month.

    lineitem meets its small dimensions and is summed
    per (region, month) with map-side partial aggregation: the only shuffle then carries at most
    regions x months rows per task. (Summing per supplier first would not shrink the data, as a
    supplier's lines are spread over all files, and would force a shuffle of lineitem.)
    """
    return (lines_with_regions(spark, sf_dir, "l_shipdate", "l_extendedprice")
            .groupBy(F.col("r_name").alias("region"), period_of(F.col("l_shipdate")).alias("period"))
            .agg(F.sum("l_extendedprice").alias("exposure")))


def german_number(c: Column) -> Column:
    """Two-decimal German text: '1.234.567,89' (dot thousands, comma decimals)."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def exposure_text(c: Column, period: Column) -> Column:
    """Exposure as it arrives in the wide export: German text, padded for even months, and a
    missing marker when ``period % 11 = 0``."""
    text = german_number(c)
    padded = F.when(period % 2 == 0, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)
    return (F.when(period % 22 == 0, F.lit(" NA "))
            .when(period % 11 == 0, F.lit("-"))
            .otherwise(padded))


def exposure_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region, one digit-named text column per period (the wide traffic export).

    The long aggregate has one row per (region, month), so it is small at any scale; it is
    written once under the checkpoint folder so the pivot's value discovery and the pivot itself
    read that small table instead of aggregating lineitem twice.
    """
    long = materialize(exposure_long(spark, sf_dir), "exposure-long")
    texts = long.select("region", F.col("period").cast("string").alias("period"),
                        exposure_text(F.col("exposure"), F.col("period")).alias("text"))
    return texts.groupBy("region").pivot("period").agg(F.first("text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x supplier x nation -> (region, pollutant, period, actual, predicted): a fixed
    prediction frame so the metric and report operators are checked without a model."""
    return (lines_with_regions(spark, sf_dir, "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
            .select(F.col("n_name").alias("region"),
                    F.concat_ws("-", "l_returnflag", "l_linestatus").alias("pollutant"),
                    period_of(F.col("l_shipdate")).alias("period"),
                    F.col("l_extendedprice").alias("actual"),
                    (F.col("l_quantity") * F.lit(3000.0)).alias("predicted")))


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, raw): ``o_totalprice`` as German text in ten shapes chosen by ``o_orderkey % 10``:
    padded, plain, the missing markers, a unit suffix and a malformed number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    g = german_number(F.col("o_totalprice"))
    k = F.col("o_orderkey") % 10
    raw = (F.when(k == 0, F.concat(F.lit(" "), g, F.lit(" ")))
           .when(k == 1, g)
           .when(k == 2, F.lit(" NA "))
           .when(k == 3, F.lit(""))
           .when(k == 4, F.lit("n/a"))
           .when(k == 5, F.lit("-"))
           .when(k == 6, F.lit("—"))
           .when(k == 7, F.lit("None"))
           .when(k == 8, F.concat(g, F.lit(" t")))
           .otherwise(F.lit("1,2,3")))
    return orders.select("o_orderkey", raw.alias("raw"))
