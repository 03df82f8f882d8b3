"""Delimited text sources and sinks (IO1, IO2, IO8, IO9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.functions.locale import format_decimal, separator_swap
from regiopanel.sources.quoted import read_quoted

# Text that a typed load treats as missing (pandas' documented default NA strings,
# matched exactly, without trimming).
DEFAULT_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# The shapes of numbers with a decimal point, and of truth values, that a typed load takes.
NUMBER_SHAPE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
INTEGER_SHAPE = r"^[+-]?[0-9]+$"
TRUE_VALUES, FALSE_VALUES = ("True", "TRUE", "true"), ("False", "FALSE", "false")


#: The column that surplus fields are read into until they are reported.
SURPLUS = "__surplus"


def read_delimited(spark: SparkSession, path, sep: str = ";", header: bool = True,
                   encoding: str = "utf-8", multi_line: bool = False, surplus: str | None = "raise") -> DataFrame:
    """IO1: delimited text, every column a string, no inference pass.

    A trailing separator yields an all-empty column named ``_c<i>`` (see ``drop_unnamed``).
    Files are split by Spark into ``maxPartitionBytes`` ranges, so large inputs scan in parallel.
    Spaces around a field belong to it, and a quote inside a quoted field is doubled.
    ``multi_line`` accepts line breaks in quoted fields; UTF-8 files are split then too (:mod:`regiopanel.sources.quoted`), in
    other encodings each file is read by one task. Missing fields at a row's end are null. A row with more fields than the header is
    an error (``surplus="raise"``), has its first further field in a column of the given name, or loses them (None). An empty field doesn't count.
    """
    reader = (spark.read.option("header", str(header).lower())
              .option("sep", sep)
              .option("escape", '"')
              .option("ignoreLeadingWhiteSpace", "false")
              .option("ignoreTrailingWhiteSpace", "false")
              .option("inferSchema", "false")
              .option("encoding", encoding))
    in_parts = multi_line and encoding.lower().replace("-", "") == "utf8"
    reader = reader.option("multiLine", str(multi_line and not in_parts).lower())
    names = reader.csv(path).columns
    if not names:
        return reader.csv(path)
    if in_parts:
        df = read_quoted(spark, path, names, sep, header, SURPLUS)
    else:
        df = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])).csv(path)
    if surplus == "raise":
        df = df.where(F.assert_true(F.col(SURPLUS).isNull(), F.concat(
            F.lit(f"a row has more fields than the {len(names)} of the header: "), F.col(SURPLUS))).isNull())
    elif surplus:
        return df.withColumnRenamed(SURPLUS, surplus)
    return df.drop(SURPLUS)


def infer_locale_types(df: DataFrame, thousands: str | None = ".", decimal: str = ",",
                       na_values=DEFAULT_NA_VALUES) -> dict[str, str]:
    """Per-column type of a string frame under the locale, from ONE aggregate pass.

    A column is ``bigint`` if every value is present and parses as an integer, ``double`` if every
    present value has the shape of a number (missing values allowed, they become null), ``boolean``
    if every present value is a truth value (and there is one), else ``string``. Shapes are matched,
    not tried by a cast, as a cast also takes suffixes: codes such as ``12D`` stay text.
    The pass is a global aggregate of counters: each task emits one partial row, so nothing but
    4 x n_columns longs reaches the driver, whatever the table size.
    """
    if not df.columns:
        return {}
    aggs = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        if not isinstance(df.schema[name].dataType, T.StringType):
            continue
        v = F.trim(c)
        present = c.isNotNull() & ~c.isin(*na_values)  # markers match exactly, numbers may be padded
        swapped = separator_swap(v, thousands, decimal)
        aggs += [
            F.count(F.when(present, F.lit(1))).alias(f"p{i}"),
            F.count_if(present & swapped.rlike(NUMBER_SHAPE)).alias(f"d{i}"),
            F.count(F.when(present & swapped.rlike(INTEGER_SHAPE), swapped.try_cast("bigint"))).alias(f"b{i}"),
            F.count_if(present & c.isin(*TRUE_VALUES, *FALSE_VALUES)).alias(f"t{i}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("n"))
    row = df.agg(*aggs).first()
    types = {}
    for i, name in enumerate(df.columns):
        if not isinstance(df.schema[name].dataType, T.StringType):
            types[name] = df.schema[name].dataType.simpleString()
            continue
        present, dbl, big, truth = row[f"p{i}"], row[f"d{i}"], row[f"b{i}"], row[f"t{i}"]
        if present == row["n"] and big == present and present > 0:
            types[name] = "bigint"
        elif dbl == present:
            types[name] = "double"
        elif truth == present:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def apply_locale_types(df: DataFrame, types: dict[str, str], thousands: str | None = ".",
                       decimal: str = ",", na_values=DEFAULT_NA_VALUES) -> DataFrame:
    """Cast each string column to its inferred type; missing markers become null everywhere."""
    cols = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        kind = types.get(name, "string")
        if not isinstance(df.schema[name].dataType, T.StringType):
            cols.append(c.alias(name))
            continue
        v = F.trim(c)
        missing = c.isNull() | c.isin(*na_values)
        if kind in ("bigint", "double"):
            value = separator_swap(v, thousands, decimal).try_cast(kind)
        elif kind == "boolean":
            value = c.isin(*TRUE_VALUES)
        else:
            value = c
        cols.append(F.when(missing, F.lit(None).cast(kind)).otherwise(value).alias(name))
    return df.select(*cols)


def load_locale_csv(spark: SparkSession, path, sep: str = ";", decimal: str = ",",
                    thousands: str | None = ".", encoding: str = "utf-8",
                    na_values=DEFAULT_NA_VALUES, multi_line: bool = False, surplus: str | None = "raise") -> DataFrame:
    """IO2: delimited text with local number format, typed per column (all-or-nothing rule).

    ``' 1.344,17 '`` in a column where every value parses gives 1344.17, while a column holding
    ``'1.000 t'`` stays text. Two scans: the typing pass and the consumer's own.
    """
    raw = read_delimited(spark, path, sep=sep, header=True, encoding=encoding, multi_line=multi_line, surplus=surplus)
    types = infer_locale_types(raw, thousands, decimal, na_values)
    return apply_locale_types(raw, types, thousands, decimal, na_values)


def _write_options(writer, sep: str, header: bool, encoding: str):
    return (writer.option("sep", sep)
            .option("header", str(header).lower())
            .option("encoding", encoding)
            .option("emptyValue", "")
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))


def save_decimal_csv(df: DataFrame, path: str, sep: str = ";", decimal: str = ",",
                     encoding: str = "utf-8", mode: str = "overwrite") -> None:
    """IO8: CSV with header and no index; only float/double columns get the decimal comma.

    Null and NaN are written as empty fields. Text is written as it is: spaces at its ends stay, quotes
    are doubled, and a field with a line break is quoted (read it back with ``multi_line``). The output
    is a folder of part files written in parallel by the executors; Spark creates the folder.
    """
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = format_decimal(c, decimal, single=isinstance(field.dataType, T.FloatType))
        cols.append(c.alias(field.name))
    _write_options(df.select(*cols).write.mode(mode), sep, True, encoding).csv(path)


def export_csv(df: DataFrame, path: str, partition_by=None, sep: str = ",", mode: str = "overwrite",
               max_records_per_file: int | None = None) -> None:
    """IO9: plain CSV export of a result frame (header, no index).

    Per-key files (one per region, one per pollutant) come from ``partitionBy`` in a single
    distributed write instead of a driver loop over keys.
    """
    writer = _write_options(df.write.mode(mode), sep, True, "utf-8")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(max_records_per_file))
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.csv(path)


def read_export(spark: SparkSession, path: str, schema, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Read an :func:`export_csv` folder back with a known schema (no inference pass)."""
    return (spark.read.schema(schema).option("header", "true").option("sep", sep)
            .option("escape", '"').option("multiLine", str(multi_line).lower())
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
            .csv(path))
