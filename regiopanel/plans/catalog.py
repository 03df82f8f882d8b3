"""The checked queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of SURVEY §2.

Each query reads the driver's tables (or frames Spark derives from them) in full. Queries that
exercise a writer write to a fresh folder under the checkpoint root and read it back. Computed
doubles are rounded with ``round_to`` (the oracle uses the same formula) and every computed
column is aliased to the name its oracle uses (see ``regiopanel.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel.functions.locale import (
    format_decimal,
    locale_number,
    null_markers,
    separator_swap,
    trim_spaces,
    try_double,
    year_int,
)
from regiopanel.functions.recode import mapping_frame, recode, recode_join
from regiopanel.operators.aggregate import describe, distinct_values, mean_by, min_sample_gate
from regiopanel.operators.evaluate import hash_split, quota_split, regression_metrics
from regiopanel.operators.joins import intersect_values, keep_common
from regiopanel.operators.model import ForestParams, fit_group_forests
from regiopanel.operators.nulls import drop_incomplete, fill_nulls
from regiopanel.operators.order import with_positions
from regiopanel.operators.panel import build_panel
from regiopanel.operators.panel import panel_features as build_long_features
from regiopanel.operators.quantiles import group_quantiles
from regiopanel.operators.report import (
    error_bars,
    metric_summary,
    metrics_by_region,
    scatter_bounds,
    sort_frame,
    top_k_per_group,
)
from regiopanel.operators.reshape import metric_matrix, pivot_blocks, pivot_categories, unpivot_digit_columns
from regiopanel.operators.schema import drop_unnamed, preview, profile_shape, safe_names, trim_names
from regiopanel.plans import frames
from regiopanel.plans.frames import PRIORITIES, round_to, table
from regiopanel.sources.collection import append_to_collection, collection_scan, ragged_union
from regiopanel.sources.delimited import (
    export_csv,
    load_locale_csv,
    read_delimited,
    read_export,
    save_decimal_csv,
)
from regiopanel.sources.payload import payload_rows, payload_schema, read_payloads
from regiopanel.sources.typed_json import read_document_dump
from regiopanel.session import materialize, scratch_path
from regiopanel.sources.unique import append_unique
from regiopanel.sources.variant import kind_of, read_mixed_documents, typed_field
from regiopanel.streaming.landing import land_payloads

# The recode map applied to region names in the recode checks (3 of the 5 names).
REGION_CODES = {"EUROPE": "EU", "AMERICA": "AM", "ASIA": "AS"}

# Characters replaced when a category value becomes a column name.
NAME_UNSAFE = r"[^0-9A-Za-z_]"

# Return flag and line status of the test data, used as pollutants of the scored frame.
POLLUTANTS = ("A-F", "A-O", "N-F", "N-O", "R-F", "R-O")

# Rows per payload document when events are packed into column arrays.
PAYLOAD_CHUNK = 512


# ---------------------------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------------------------

def _write_text_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    (df.write.mode("overwrite").option("sep", sep).option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("emptyValue", "").csv(path))


def io_delimited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """IO1: supplier as ';' text, read back as all-string columns."""
    path = scratch_path(spark, "supplier-text")
    _write_text_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return read_delimited(spark, path, sep=";")


def io_locale_typed_load(spark: SparkSession, sf: str) -> DataFrame:
    """IO2: part with German-formatted prices, codes such as ``12D`` (text) and truth values; the load types
    each column from the data."""
    part = table(spark, sf, "part")
    price = frames.german_number(F.col("p_retailprice"))
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.lit("D")).when(F.col("p_partkey") % 3 == 1, F.lit("F")).otherwise(F.lit(""))
    text = part.select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand",
        F.concat(F.col("p_partkey").cast("string"), suffix).alias("p_code"),
        F.when(F.col("p_size") > 25, F.lit("True")).otherwise(F.lit("False")).alias("p_large"),
        F.col("p_size").cast("string").alias("p_size"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), price, F.lit(" "))).otherwise(price)
        .alias("p_retailprice"))
    path = scratch_path(spark, "part-text")
    _write_text_csv(text, path)
    typed = load_locale_csv(spark, path, sep=";", decimal=",", thousands=".")
    return typed.withColumn("p_retailprice", round_to(F.col("p_retailprice"), 2))


def _event_payloads(spark: SparkSession, sf: str, ragged: bool = False) -> str:
    """Pack events into column-array documents, one per (day, block of event ids), as JSON lines. ``ragged``: every
    other block has another list of variables."""
    events = table(spark, sf, "events")
    packed = (events.groupBy(F.to_date("ts").alias("day"),
                             F.floor(F.col("event_id") / F.lit(PAYLOAD_CHUNK)).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "user_id", "event_type", "value")))
                   .alias("rows")))
    even = F.col("block") % 2 == 0
    value = F.when(even, F.col("rows.value")) if ragged else F.col("rows.value")
    kind = F.when(~even, F.col("rows.event_type")) if ragged else F.col("rows.event_type")
    doc = F.struct(
        F.col("day").cast("string").alias("day"), F.col("block").alias("block"),
        F.struct(F.transform("rows.ts", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
                 .alias("time"),
                 F.col("rows.event_id").alias("event_id"), F.col("rows.user_id").alias("user_id"),
                 kind.alias("event_type"), value.alias("value"))
        .alias("hourly"))
    path = scratch_path(spark, "event-payloads")
    packed.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)
    return path


def io_payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """IO3 + R4 + P11: column-array payloads with two variable lists back to one row per event."""
    path = _event_payloads(spark, sf, ragged=True)
    schema = payload_schema({"event_id": "bigint", "user_id": "bigint", "event_type": "string",
                             "value": "double"}, keys={"day": "string", "block": "bigint"})
    rows = payload_rows(read_payloads(spark, path, schema), order_by_time=True)
    return rows.select("event_id", "time", "user_id", "event_type", "value")


def stream_payload_landing(spark: SparkSession, sf: str) -> DataFrame:
    """IO3 + IO4 as a stream: payload files land in a folder, a file stream flattens them and
    appends each micro-batch to a collection (one epoch folder per batch); the collection is read back."""
    landing = _event_payloads(spark, sf)
    collection = scratch_path(spark, "landed-events")
    schema = payload_schema({"event_id": "bigint", "user_id": "bigint", "event_type": "string",
                             "value": "double"}, keys={"day": "string", "block": "bigint"})
    land_payloads(spark, landing, schema, collection, scratch_path(spark, "landing-stream"), keep=None).awaitTermination()
    return collection_scan(spark, collection).select("event_id", "time", "user_id", "event_type", "value")


def io_collection_append(spark: SparkSession, sf: str) -> DataFrame:
    """IO4 + A9: orders appended twice; every key twice, two ids per key, rows counted on write."""
    path = scratch_path(spark, "collection-orders")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    inserted = append_to_collection(orders, path) + append_to_collection(orders, path)
    stored = collection_scan(spark, path)
    return (stored.groupBy("o_orderkey")
            .agg(F.count(F.lit(1)).alias("n_copies"), F.countDistinct("_id").alias("n_ids"))
            .withColumn("inserted", F.lit(inserted).cast("bigint")))


def io_collection_widening(spark: SparkSession, sf: str) -> DataFrame:
    """IO4 + IO5 + IO7: orders appended once with whole and once with fractional prices, and with another column; the
    collection reads as one table with the wider type."""
    path = scratch_path(spark, "collection-widening")
    orders = table(spark, sf, "orders")
    append_to_collection(orders.select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("price"), "o_orderstatus"), path)
    append_to_collection(orders.select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderpriority"), path)
    return collection_scan(spark, path, projection={
        "o_orderkey": 1, "price": 1, "o_orderstatus": 1, "o_orderpriority": 1, "_id": 0})


def io_collection_find(spark: SparkSession, sf: str) -> DataFrame:
    """IO5 query semantics over documents with and without labels: inequality keeps documents lacking the field, null
    equals a missing field."""
    path = scratch_path(spark, "collection-labels")
    append_to_collection(_documents_labels(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), path)
    return collection_scan(spark, path, query={
        "toxic": {"$ne": 1}, "$or": [{"quality": None}, {"lang": {"$in": ["de", "fr"]}}, {"no_such_field": 3}],
        "doc_id": {"$exists": True, "$not": {"$lt": 10}}}, projection={"doc_id": 1, "quality": 1, "toxic": 1, "lang": 1, "_id": 0})


def io_collection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """IO5 + O3: filter, projection and ordered limit pushed into the Parquet scan of customer."""
    return collection_scan(
        spark, f"{sf.rstrip('/')}/customer.parquet",
        query={"c_mktsegment": "BUILDING"},
        projection={"c_custkey": 1, "c_name": 1, "c_acctbal": 1},
        order_by=[F.col("c_acctbal").desc(), F.col("c_custkey")], limit=100)


def io_collection_partitioned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """IO4 + IO5 with partition pruning: customer appended partitioned by segment, then a segment
    query reads only that segment's folder."""
    path = scratch_path(spark, "collection-customer")
    append_to_collection(table(spark, sf, "customer"), path, partition_by="c_mktsegment")
    return collection_scan(spark, path, query={"c_mktsegment": "AUTOMOBILE"},
                           projection={"c_custkey": 1, "c_name": 1, "c_nationkey": 1, "c_acctbal": 1, "_id": 0})


def io_collection_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """IO4 + IO5: orders of one schema appended plain, partitioned by priority (twice, by other columns) and by a stream; each
    order comes back once from each, with its values and types."""
    path = scratch_path(spark, "collection-layouts")
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    append_to_collection(orders, path)
    append_to_collection(orders, path, partition_by="o_orderpriority")
    append_to_collection(orders, path, partition_by=["o_orderstatus", "o_orderpriority"])
    block = F.floor(F.col("o_orderkey") / F.lit(PAYLOAD_CHUNK))
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", *[c for c in orders.columns if c != "o_orderkey"])))
    packed = orders.groupBy(block.alias("block")).agg(rows.alias("rows"))
    arrays = [F.col(f"rows.{c}").alias(c) for c in orders.columns[1:]]
    time = F.transform("rows.time", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time")
    landing = scratch_path(spark, "order-payloads")
    packed.select(F.to_json(F.struct("block", F.struct(time, *arrays).alias("hourly"))).alias("value")).write.mode("overwrite").text(landing)
    schema = payload_schema({"o_orderkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string", "o_totalprice": "double"},
                            keys={"block": "bigint"})
    land_payloads(spark, landing, schema, path, scratch_path(spark, "order-stream")).awaitTermination()
    return collection_scan(spark, path).groupBy("time", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").agg(
        F.count("*").alias("n_copies"), F.countDistinct("_imported_at").alias("n_stamps"))


def io_collection_unique(spark: SparkSession, sf: str) -> DataFrame:
    """IO4 + A9 with unique ids: two of three orders appended, then all of them, some twice; a known id is refused, and each order is
    stored once, by the append that brought it first."""
    path = scratch_path(spark, "collection-unique")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey", "o_totalprice")
    first = append_unique(orders.where("o_orderkey % 3 <> 0").withColumn("batch", F.lit(1)), path)
    again = orders.unionByName(orders.where("o_orderkey % 5 = 0"))
    second = append_unique(again.withColumn("batch", F.lit(2)), path)
    return collection_scan(spark, path).groupBy("o_orderkey").agg(
        F.count("*").alias("n_copies"), F.max("batch").alias("batch"), F.max("o_totalprice").alias("o_totalprice")).select(
        "*", F.lit(first.inserted).cast("long").alias("first_inserted"), F.lit(second.inserted).cast("long").alias("second_inserted"),
        F.lit(second.refused).cast("long").alias("second_refused"))


def io_collection_find_id(spark: SparkSession, sf: str) -> DataFrame:
    """IO5 as a point query: customers appended in ranges of their key, with Bloom filters on the name; one is found by both."""
    path = scratch_path(spark, "collection-points")
    append_to_collection(table(spark, sf, "customer"), path, cluster_by="c_custkey", bloom="c_name")
    name = F.lit("Customer#000000077")
    return collection_scan(spark, path, projection={"c_custkey": 1, "c_name": 1, "c_acctbal": 1, "c_mktsegment": 1, "_id": 0}).where(
        (F.col("c_custkey") == 77) | (F.col("c_name") == name))


def io_ragged_union(spark: SparkSession, sf: str) -> DataFrame:
    """IO7: customers and orders in one table; missing keys are null."""
    return ragged_union([table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")])


def io_decimal_comma_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """IO8 + P12 + P1: line prices, also very large and very small, written with decimal commas, read back and parsed.
    Every double comes back as it was."""
    path = scratch_path(spark, "lineitem-decimal")
    price = F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", price, (price * F.lit(1e9)).alias("large"),
                                                (price * F.lit(1e-40)).alias("small"))
    save_decimal_csv(lines, path, sep=";", decimal=",")
    back = read_delimited(spark, path, sep=";")
    return back.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
                       *[locale_number(F.col(c)).alias(c) for c in ("l_extendedprice", "large", "small")])


def io_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """IO8 with text: every document, padded, with quotes, separators and line breaks, written and read back as it was."""
    path = scratch_path(spark, "documents-csv")
    text = F.concat(F.lit("  "), F.col("text"), F.lit(' "said"; "'), F.col("lang"), F.lit('"  '))
    save_decimal_csv(table(spark, sf, "documents").select("doc_id", text.alias("text"), "source"), path, sep=";")
    back = read_delimited(spark, path, sep=";", multi_line=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source")


def io_result_export(spark: SparkSession, sf: str) -> DataFrame:
    """IO9: the metric summary written as CSV (one folder per pollutant) and read back."""
    summary = _summary(spark, sf)
    path = scratch_path(spark, "summary-export")
    export_csv(summary, path, partition_by="pollutant")
    back = read_export(spark, path, summary.schema)
    return _round_cols(back, {"r2_mean": 4, "r2_median": 4, "r2_std": 4,
                              "rmse_mean": 4, "rmse_median": 4, "rmse_std": 4})


def io_doc_dump_decode(spark: SparkSession, sf: str) -> DataFrame:
    """IO6 + IO10: events as typed documents ($oid / $date / $numberLong / $numberDouble), decoded."""
    events = table(spark, sf, "events")
    docs = events.select(
        F.struct(F.lpad(F.lower(F.hex("event_id")), 24, "0").alias("$oid")).alias("_id"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("$date")).alias("ts"),
        F.struct(F.col("user_id").cast("string").alias("$numberLong")).alias("user_id"),
        "event_type",
        F.struct(F.col("value").cast("string").alias("$numberDouble")).alias("value"))
    path = scratch_path(spark, "event-dump")
    docs.write.mode("overwrite").json(path)
    decoded = read_document_dump(spark, path, multi_line=False, schema=docs.schema)
    return decoded.select(F.conv("_id", 16, 10).cast("bigint").alias("event_id"), "ts", "user_id",
                          "event_type", "value")


def io_mixed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """IO7 + IO10 with conflicting types: events as JSON documents whose ``value`` is a number, text, an object or absent, stored as
    VARIANT and read back; numbers stay numbers."""
    events = table(spark, sf, "events")
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(
        k == 2, F.concat(F.lit('{"of": '), F.col("user_id").cast("string"), F.lit(', "unit": "u"}')))
    json = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"),
                    F.coalesce(F.concat(F.lit(', "value": '), value), F.lit("")), F.lit("}"))
    path = scratch_path(spark, "mixed-events")
    events.select(json.alias("value")).write.mode("overwrite").text(path)
    docs = materialize(read_mixed_documents(spark, path), "mixed-documents")
    kind = F.regexp_extract(kind_of("doc", "value"), "^[A-Z]+", 0)
    return docs.select(
        typed_field("doc", "event_id", "bigint").alias("event_id"),
        F.when(kind.isin("DECIMAL", "DOUBLE", "BIGINT"), "number").otherwise(F.lower(kind)).alias("kind"),
        round_to(typed_field("doc", "value", "double"), 6).alias("number"), typed_field("doc", "value", "string").alias("text"),
        typed_field("doc", "value.of", "bigint").alias("of"))


# ---------------------------------------------------------------------------------------------
# Schema operators
# ---------------------------------------------------------------------------------------------

def _orders_with_header(spark: SparkSession, sf: str, names, trailing_empty: bool = False) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_custkey").cast("string"))
    if trailing_empty:
        orders = orders.withColumn("__empty", F.lit(None).cast("string"))
        names = list(names) + [""]
    path = scratch_path(spark, "orders-header")
    _write_text_csv(orders.toDF(*names), path)
    return read_delimited(spark, path, sep=";")


def schema_trim_names(spark: SparkSession, sf: str) -> DataFrame:
    """SC1: padded header names trimmed."""
    raw = _orders_with_header(spark, sf, [" o_orderkey ", "o_orderpriority  ", " o_custkey"])
    return trim_names(raw)


def schema_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """SC2: dotted header names made safe."""
    raw = _orders_with_header(spark, sf, ["o.orderkey", "o.orderpriority", "o.custkey"])
    return safe_names(raw)


def schema_drop_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """SC7: the empty column behind a trailing separator is dropped."""
    raw = _orders_with_header(spark, sf, ["o_orderkey", "o_orderpriority", "o_custkey"], trailing_empty=True)
    return drop_unnamed(raw)


def profile_shape_q(spark: SparkSession, sf: str) -> DataFrame:
    """SC5: row and column count of customer."""
    return profile_shape(table(spark, sf, "customer"))


def preview_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """SC6: first 20 customers by key."""
    return preview(table(spark, sf, "customer"), 20, order_by="c_custkey")


# ---------------------------------------------------------------------------------------------
# Scalar functions, filters, nulls
# ---------------------------------------------------------------------------------------------

def scalar_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed order-price text."""
    t = frames.orders_text(spark, sf)
    return t.select("o_orderkey", trim_spaces(F.col("raw")).alias("trimmed"))


def scalar_null_markers(spark: SparkSession, sf: str) -> DataFrame:
    """P3 + P4: missing markers (case-insensitive) become null."""
    t = frames.orders_text(spark, sf)
    return t.select("o_orderkey", null_markers(trim_spaces(F.col("raw"))).alias("cleaned"))


def scalar_separator_swap(spark: SparkSession, sf: str) -> DataFrame:
    """P5: thousands dots removed, decimal comma to point."""
    t = frames.orders_text(spark, sf)
    return t.select("o_orderkey", separator_swap(trim_spaces(F.col("raw"))).alias("swapped"))


def scalar_try_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Safe cast of the swapped text (markers and malformed text become null)."""
    t = frames.orders_text(spark, sf)
    value = try_double(separator_swap(trim_spaces(F.col("raw"))))
    return t.select("o_orderkey", round_to(value, 2).alias("value"))


def scalar_locale_number(spark: SparkSession, sf: str) -> DataFrame:
    """The whole locale number chain as one Column expression."""
    t = frames.orders_text(spark, sf)
    return t.select("o_orderkey", round_to(locale_number(F.col("raw")), 2).alias("value"))


def scalar_year_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Padded year text -> int (strict cast)."""
    orders = table(spark, sf, "orders")
    text = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" "))
    return orders.select("o_orderkey", year_int(text).alias("year"))


def _customer_regions(spark: SparkSession, sf: str) -> DataFrame:
    return frames.customer_regions(spark, sf).select("c_custkey", "r_name")


def scalar_recode_map(spark: SparkSession, sf: str) -> DataFrame:
    """P9 with a literal map compiled into the plan."""
    rows = _customer_regions(spark, sf)
    return rows.select("c_custkey", recode(F.col("r_name"), REGION_CODES).alias("region"))


def join_recode_table(spark: SparkSession, sf: str) -> DataFrame:
    """P9 with the map as a table (left join + coalesce)."""
    rows = _customer_regions(spark, sf)
    out = recode_join(rows, "r_name", mapping_frame(spark, REGION_CODES), out="region", unique=True)
    return out.select("c_custkey", "region")


def scalar_format_decimal_comma(spark: SparkSession, sf: str) -> DataFrame:
    """Discount and tax as decimal-comma text."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", format_decimal(F.col("l_discount")).alias("discount_text"),
                     format_decimal(F.col("l_tax")).alias("tax_text"))


def filter_trimmed_eq(spark: SparkSession, sf: str) -> DataFrame:
    """Equality on trimmed text (segments padded in three ways)."""
    customer = table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    padded = (F.when(k == 0, F.concat(F.lit(" "), F.col("c_mktsegment")))
              .when(k == 1, F.concat(F.col("c_mktsegment"), F.lit("  ")))
              .otherwise(F.col("c_mktsegment")))
    return (customer.select("c_custkey", "c_name", padded.alias("segment"))
            .filter(F.trim(F.col("segment")) == F.lit("BUILDING"))
            .select("c_custkey", "c_name"))


def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    """Plain equality, pushed into the Parquet scan."""
    customer = table(spark, sf, "customer")
    return customer.filter(F.col("c_mktsegment") == F.lit("MACHINERY")).select("c_custkey", "c_name", "c_acctbal")


def _documents_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def null_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Labels missing for a document become 0."""
    return fill_nulls(_documents_labels(spark, sf), {"quality": 0, "toxic": 0})


def null_drop_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without labels dropped."""
    return drop_incomplete(_documents_labels(spark, sf), ["quality", "toxic"])


# ---------------------------------------------------------------------------------------------
# Reshape, joins, aggregates: the regional panel
# ---------------------------------------------------------------------------------------------

def traffic_long(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + SC3 + P1: the wide text export unpivoted and parsed -> (region, period, traffic)."""
    wide = frames.exposure_wide(spark, sf)
    long = unpivot_digit_columns(wide, ["region"], name_col="period", value_col="text", name_type="bigint")
    return long.select("region", "period", locale_number(F.col("text")).alias("traffic"))


def reshape_unpivot_years(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + SC3 + P1: every region x period of the wide export, nulls kept."""
    t = traffic_long(spark, sf)
    return t.select("region", "period", round_to(F.col("traffic"), 2).alias("exposure"))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """R2 then J1: measure pivoted to one column per category, joined to mean traffic (A1)."""
    return build_panel(frames.measure(spark, sf), traffic_long(spark, sf), PRIORITIES, safe=NAME_UNSAFE)


def _label_names():
    import re

    return [re.sub(NAME_UNSAFE, "_", p) for p in PRIORITIES]


def _round_cols(df: DataFrame, digits: dict) -> DataFrame:
    return df.select(*[round_to(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`")
                       for c in df.columns])


def reshape_pivot_categories(spark: SparkSession, sf: str) -> DataFrame:
    """R2 + A2 + A3: mean value per region and period, one column per priority."""
    measure = frames.measure(spark, sf)
    pivot = pivot_categories(measure, ["region", "period"], "category", "value", values=PRIORITIES,
                             agg="avg", safe=NAME_UNSAFE)
    return _round_cols(pivot, {c: 4 for c in _label_names()})


def reshape_pivot_many(spark: SparkSession, sf: str) -> DataFrame:
    """R2 with as many columns as there are customers: total price by priority and customer, in blocks of columns; each block with its number
    of cells, its first and last customer and their prices."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    cells, columns = pivot_blocks(orders, "o_orderpriority", "o_custkey", F.max("o_totalprice"))
    numbers = F.map_keys("cells")
    ends = cells.select("o_orderpriority", "block", F.size("cells").cast("long").alias("n_cells"),
                        numbers[0].alias("first"), F.element_at(numbers, -1).alias("last"), "cells")
    name = lambda side: columns.select(F.col("column").alias(side), F.col("category").alias(f"{side}_customer"))
    return ends.join(name("first"), "first").join(name("last"), "last").select(
        "o_orderpriority", "block", "n_cells", "first_customer", "last_customer", F.element_at("cells", F.col("first")).alias("first_price"),
        F.element_at("cells", F.col("last")).alias("last_price"),
        F.array_max(F.map_values("cells")).alias("highest"))


def panel_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + SC4 + P10: the wide panel, traffic left-joined (null where a month has none)."""
    panel = _panel(spark, sf)
    return _round_cols(panel, {**{c: 4 for c in _label_names()}, "traffic": 2})


def panel_features_frame(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + P16 + P8 + P17: the long modelling frame (region, pollutant, period, label, traffic, year_feature)."""
    return build_long_features(_panel(spark, sf), _label_names())


def panel_features(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + P8 + P16 + P17: the long modelling frame."""
    return _round_cols(panel_features_frame(spark, sf), {"label": 4, "traffic": 2})


def join_common_regions_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose nation also has suppliers."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cust = (table(spark, sf, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .select("c_custkey", F.col("n_name").alias("nation")))
    supp = (table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
            .select(F.col("n_name").alias("nation")))
    return keep_common(cust, supp, "nation")


def set_intersect_regions(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + O4: sorted nations present on both sides."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
    supp = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
    return intersect_values(cust.select(F.col("n_name").alias("nation")),
                            supp.select(F.col("n_name").alias("nation")), "nation")


def agg_mean_traffic(spark: SparkSession, sf: str) -> DataFrame:
    """A1: mean line price per supplier region and ship year (star join, partial aggregation)."""
    out = mean_by(frames.lines_with_regions(spark, sf, "l_shipdate", "l_extendedprice")
                  .select(F.col("r_name").alias("region"), F.year("l_shipdate").cast("bigint").alias("year"),
                          "l_extendedprice"),
                  ["region", "year"], "l_extendedprice", "traffic_avg")
    return _round_cols(out, {"traffic_avg": 4})


def agg_mean_measure(spark: SparkSession, sf: str) -> DataFrame:
    """A2: mean value per region, period and category."""
    out = mean_by(frames.measure(spark, sf), ["region", "period", "category"], "value", "value_avg")
    return _round_cols(out, {"value_avg": 4})


def agg_distinct_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the distinct regions of the measure frame."""
    return distinct_values(frames.measure(spark, sf), "region")


def agg_min_sample_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A5: complete panel rows per (region, pollutant) against the reference's threshold of 10."""
    return min_sample_gate(panel_features_frame(spark, sf), ["region", "pollutant"],
                           ["label", "traffic", "year_feature"], threshold=ForestParams().min_rows)


# ---------------------------------------------------------------------------------------------
# Models and evaluation
# ---------------------------------------------------------------------------------------------

def ml_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """M2: deterministic 80/20 split flag of every panel row."""
    keys = panel_features_frame(spark, sf).select("region", "pollutant", "period")
    return hash_split(keys, ["region", "pollutant", "period"], 0.8)


def ml_quota_split(spark: SparkSession, sf: str) -> DataFrame:
    """M2 with exact quotas: orders in groups of very different sizes (one holds a third), 20 % of each held out to the row, one row at
    least."""
    group = F.when(F.col("o_orderkey") % 3 == 0, F.lit("hot")).otherwise(F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 97).cast("string")))
    orders = table(spark, sf, "orders").select(group.alias("group"), "o_orderkey")
    split = quota_split(orders, "group", "o_orderkey", 0.2)
    return split.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"),
                                      F.count(F.when(F.col("is_train"), 1)).alias("n_train"))


def _forests(spark: SparkSession, sf: str):
    return fit_group_forests(panel_features_frame(spark, sf), keys=("region", "pollutant"), label="label",
                             features=("traffic", "year_feature"), order="period", params=ForestParams())


def ml_group_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M3-M5 (+M6, M7): one forest per (region, pollutant). Split sizes of every model, and whether its metrics are
    those of its predictions (``rmse`` and ``r2`` by their formulas, written out here)."""
    forests = _forests(spark, sf)
    error = F.col("actual") - F.col("predicted")
    by_hand = forests.predictions.groupBy("region", "pollutant").agg(
        F.sum(error * error).alias("sse"), F.count("*").alias("n"),
        (F.sum(F.col("actual") * F.col("actual")) - F.sum("actual") * F.avg("actual")).alias("sst"))
    near = lambda a, b: F.abs(a - b) <= F.lit(1e-6) * (1 + F.abs(b))
    rmse, r2 = F.sqrt(F.col("sse") / F.col("n")), 1 - F.try_divide("sse", "sst")
    same = near(F.col("rmse"), rmse) & (near(F.col("r2"), r2) | (F.col("n") < 2))
    return forests.metrics.join(by_hand, ["region", "pollutant"], "left").select(
        "region", "pollutant", "n_train", "n_test", ((F.col("n_test") == F.coalesce("n", F.lit(0))) &
                                                     (F.coalesce(same, F.lit(False)) | (F.col("n_test") == 0))).alias("metrics_hold"))


def ml_predictions_long(spark: SparkSession, sf: str) -> DataFrame:
    """The test predictions of every group's forest in one long frame: each test row with its label, and whether the
    prediction lies within the labels its forest was trained on, as averages of labels must."""
    features = materialize(panel_features_frame(spark, sf), "forest-features")
    forests = fit_group_forests(features, keys=("region", "pollutant"), label="label", features=("traffic", "year_feature"),
                                order="period", params=ForestParams())
    train = hash_split(features, ["region", "pollutant", "period"], ForestParams().train_share).where("is_train")
    bounds = train.groupBy("region", "pollutant").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    slack = F.lit(1e-9) * F.col("hi")
    return forests.predictions.join(bounds, ["region", "pollutant"]).select(
        "region", "pollutant", "period", round_to(F.col("actual"), 4).alias("actual"),
        F.col("predicted").between(F.col("lo") - slack, F.col("hi") + slack).alias("within_labels"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return regression_metrics(frames.scored(spark, sf), ["region", "pollutant"])


def ml_eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """M6 + M7: n, RMSE and R² of every (region, pollutant) group in one aggregate."""
    return _round_cols(_metrics(spark, sf), {"rmse": 4, "r2": 4})


def report_metrics_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """M8 / V3: each region's metric table, pollutant-sorted, with positions."""
    return _round_cols(metrics_by_region(_metrics(spark, sf)), {"rmse": 4, "r2": 4})


def sort_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """O1: the full metric table by region and pollutant."""
    return _round_cols(sort_frame(_metrics(spark, sf), "region", "pollutant"), {"rmse": 4, "r2": 4})


def sort_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """O1 / V1: predictions ordered by region, pollutant and period."""
    return sort_frame(frames.scored(spark, sf), "region", "pollutant", "period")


def sort_positions(spark: SparkSession, sf: str) -> DataFrame:
    """O1 / V1 with positions: the place of every prediction in the order of region, pollutant, period and values."""
    return with_positions(frames.scored(spark, sf), "region", "pollutant", "period", "actual", "predicted")


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return metric_summary(_metrics(spark, sf), by="pollutant", group="region")


_SUMMARY_DIGITS = {f"{m}_{s}": 4 for m in ("r2", "rmse") for s in ("mean", "median", "std", "lo", "hi")}


def report_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and std of R² and RMSE per pollutant, with the number of regions."""
    return _round_cols(_summary(spark, sf), _SUMMARY_DIGITS)


def report_error_bars(spark: SparkSession, sf: str) -> DataFrame:
    """V4: the summary with mean ± std."""
    return _round_cols(error_bars(_summary(spark, sf)), _SUMMARY_DIGITS)


def report_metric_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Region x pollutant matrix of R²."""
    matrix = metric_matrix(_metrics(spark, sf), "region", "pollutant", "r2", values=POLLUTANTS)
    return _round_cols(matrix, {c: 4 for c in matrix.columns if c != "region"})


def report_scatter_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The scatter diagonal's ends per group."""
    return scatter_bounds(frames.scored(spark, sf), ["region", "pollutant"])


def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """O2 / V6: the five best regions by R² for each pollutant."""
    top = top_k_per_group(_metrics(spark, sf), "pollutant", "r2", k=5, tie="region")
    return _round_cols(top.select("pollutant", F.col("rank").cast("bigint").alias("rank"), "region", "r2", "rmse"),
                       {"r2": 4, "rmse": 4})


def profile_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max of the numeric event variables (shared passes)."""
    events = table(spark, sf, "events").withColumn(  # NaN is no value
        "gaps", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    d = describe(events, ["value", "user_id", "gaps"]).withColumnRenamed("column", "variable")
    return _round_cols(d, {c: 4 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


def agg_group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A6 at scale: exact quartiles of the line price for each group; one group holds a third of all lines."""
    group = F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot")).otherwise(F.concat_ws("-", "l_returnflag", "l_linestatus"))
    lines = table(spark, sf, "lineitem").select(group.alias("line_group"), "l_extendedprice")
    return _round_cols(group_quantiles(lines, "line_group", "l_extendedprice"), {"p25": 4, "p50": 4, "p75": 4})


def regional_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: wide traffic text -> unpivot -> parse -> mean; measure -> pivot; left join ->
    fill -> features, for every region and label at once."""
    return panel_features(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "io_delimited_scan": io_delimited_scan,
    "io_locale_typed_load": io_locale_typed_load,
    "io_payload_rows": io_payload_rows,
    "io_collection_append": io_collection_append,
    "stream_payload_landing": stream_payload_landing,
    "io_collection_scan": io_collection_scan,
    "io_collection_partitioned_scan": io_collection_partitioned_scan,
    "io_collection_widening": io_collection_widening,
    "io_collection_layouts": io_collection_layouts,
    "io_collection_unique": io_collection_unique,
    "io_collection_find_id": io_collection_find_id,
    "io_collection_find": io_collection_find,
    "io_text_roundtrip": io_text_roundtrip,
    "io_ragged_union": io_ragged_union,
    "io_decimal_comma_roundtrip": io_decimal_comma_roundtrip,
    "io_result_export": io_result_export,
    "io_doc_dump_decode": io_doc_dump_decode,
    "io_mixed_documents": io_mixed_documents,
    "schema_trim_names": schema_trim_names,
    "schema_safe_names": schema_safe_names,
    "schema_drop_unnamed": schema_drop_unnamed,
    "profile_shape": profile_shape_q,
    "preview_first_n": preview_first_n,
    "scalar_locale_number": scalar_locale_number,
    "scalar_null_markers": scalar_null_markers,
    "scalar_separator_swap": scalar_separator_swap,
    "scalar_try_cast": scalar_try_cast,
    "scalar_trim": scalar_trim,
    "scalar_year_cast": scalar_year_cast,
    "scalar_recode_map": scalar_recode_map,
    "join_recode_table": join_recode_table,
    "scalar_format_decimal_comma": scalar_format_decimal_comma,
    "filter_trimmed_eq": filter_trimmed_eq,
    "filter_eq": filter_eq,
    "null_fill": null_fill,
    "null_drop_subset": null_drop_subset,
    "reshape_unpivot_years": reshape_unpivot_years,
    "reshape_pivot_categories": reshape_pivot_categories,
    "reshape_pivot_many": reshape_pivot_many,
    "panel_left_join": panel_left_join,
    "join_common_regions_semi": join_common_regions_semi,
    "set_intersect_regions": set_intersect_regions,
    "agg_mean_traffic": agg_mean_traffic,
    "agg_mean_measure": agg_mean_measure,
    "agg_distinct_regions": agg_distinct_regions,
    "agg_group_quantiles": agg_group_quantiles,
    "agg_min_sample_gate": agg_min_sample_gate,
    "panel_features": panel_features,
    "ml_hash_split": ml_hash_split,
    "ml_quota_split": ml_quota_split,
    "ml_group_forest": ml_group_forest,
    "ml_predictions_long": ml_predictions_long,
    "ml_eval_metrics": ml_eval_metrics,
    "report_metrics_by_region": report_metrics_by_region,
    "sort_metrics": sort_metrics,
    "sort_predictions": sort_predictions,
    "sort_positions": sort_positions,
    "report_metric_summary": report_metric_summary,
    "report_error_bars": report_error_bars,
    "report_metric_matrix": report_metric_matrix,
    "report_scatter_bounds": report_scatter_bounds,
    "topk_per_group": topk_per_group,
    "profile_describe": profile_describe,
}
