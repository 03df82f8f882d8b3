"""Scalar functions: the number-parser edge table of FIXTURES §3 and traps T1-T3, T5, T10."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiopanel.functions import (
    format_decimal,
    locale_number,
    null_markers,
    parse_timestamp,
    recode,
    separator_swap,
    trim_spaces,
    year_int,
)
from regiopanel.functions.recode import REGION_MAP

EDGES = [
    (" 215.855,04 ", 215855.04),
    (" NA ", None), ("n/a", None), ("NULL", None), ("None", None),
    ("", None), ("-", None), ("—", None), (None, None),
    ("1.2.3,4", 123.4),
    ("1,2,3", None),
    ("-1,5", -1.5),
    ("+7", 7.0),
    ("(3)", None),
    ("Infinity", math.inf), ("inf", math.inf),
    ("1e3", 1000.0),
    ("\t5,5", 5.5),
    ("\u00a05,5", None),  # no-break space: not trimmed, fails the cast
    ("2162.23", 216223.0),  # T1: every dot goes, also a decimal point
    ("1.000 t", None),
    ("1d", 1.0), ("1f", 1.0),  # Spark's cast accepts Java float suffixes (kept out of oracle data)
]


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_locale_number_edge_table(spark):
    got = _eval(spark, [e[0] for e in EDGES], locale_number)
    for (text, want), value in zip(EDGES, got):
        if want is None:
            assert value is None, text
        else:
            assert value == pytest.approx(want), text


def test_nan_is_not_a_marker(spark):
    got = _eval(spark, ["NaN", "nan"], locale_number)
    assert all(math.isnan(v) for v in got)  # T2: NaN passes the marker test and the cast


def test_trim_strips_spaces_only(spark):
    assert _eval(spark, ["  a  ", "\ta\t"], trim_spaces) == ["a", "\ta\t"]  # T3


def test_null_markers_keep_other_text(spark):
    assert _eval(spark, ["na", "NA", "x", "", None], null_markers) == [None, None, "x", None, None]


def test_separator_swap_one_pass(spark):
    assert _eval(spark, ["1.234.567,89"], separator_swap) == ["1234567.89"]
    assert _eval(spark, ["1,234.5"], lambda c: separator_swap(c, ",", ".")) == ["1234.5"]


def test_year_cast_strict_and_lenient(spark):
    assert _eval(spark, [" 1990 "], year_int) == [1990]
    with pytest.raises(Exception):
        _eval(spark, ["abc"], year_int)
    with pytest.raises(Exception):
        _eval(spark, ["1990.0"], year_int)
    assert _eval(spark, ["abc", "1990"], lambda c: year_int(c, "null")) == [None, 1990]


def test_format_decimal_plain_notation(spark):
    values = [1234.5, 3.0, 1e7, 12345678.9, 0.0001, -0.5, None, float("nan"), float("inf"), 0.0]
    got = _eval(spark, values, format_decimal, dtype="double")
    assert got == ["1234,5", "3,0", "10000000,0", "12345678,9", "0,0001", "-0,5", None, None, "inf", "0,0"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=20))
def test_format_then_parse_is_identity(spark, cents):
    values = [c / 100.0 for c in cents]
    got = _eval(spark, values, lambda c: locale_number(format_decimal(c)), dtype="double")
    assert got == values


def test_recode_exact_and_fallback(spark):
    got = _eval(spark, ["OESTERREICH", "Wien", "oesterreich", None], lambda c: recode(c, REGION_MAP))
    assert got == ["AT", "Wien", "oesterreich", None]


def test_parse_timestamp_minutes(spark):
    got = _eval(spark, ["2025-12-05T00:00", "2025-12-05T13:45:10"], parse_timestamp)
    assert [g.isoformat() for g in got] == ["2025-12-05T00:00:00", "2025-12-05T13:45:10"]


def test_year_cast_fails_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception):
            _eval(spark, ["abc"], year_int)
        assert _eval(spark, [" 2001 ", None], year_int) == [2001, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def _python_locale_number(text):
    """Brute-force reference of P1 in plain Python (spaces-only trim, exact marker list)."""
    if text is None:
        return None
    t = text.strip(" ")
    if t == "" or t.lower() in ("na", "n/a", "null", "none", "-", "—"):
        return None
    t = t.replace(".", "").replace(",", ".")
    try:
        return float(t)
    except ValueError:
        return None


TEXT = st.lists(st.sampled_from(list("0123456789.,- +") + ["NA", "n/a", "e"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_locale_number_matches_brute_force(spark, texts):
    got = _eval(spark, texts, locale_number)
    for text, value in zip(texts, got):
        want = _python_locale_number(text)
        if want is None or value is None:
            assert want is None and value is None, repr(text)
        else:
            assert value == pytest.approx(want), repr(text)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=40, max_size=60))
def test_every_finite_double_survives_export(spark, values):
    values = values + [1.5e-31, 4.9e-324, 1.7976931348623157e308, 12345678.123456789, 1e29, -1e-3, -0.0, 123456789012345680.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    back = df.select("v", locale_number(format_decimal("v")).alias("w")).collect()
    assert [r["v"] for r in back] == [r["w"] for r in back]


def test_recode_of_any_size(spark):
    from regiopanel.functions import recode_values

    mapping = {f"k{i}": f"v{i}" for i in range(3000)}
    df = spark.createDataFrame([("k5",), ("k2999",), ("other",), (None,)], "c string")
    assert [r["c"] for r in df.select(recode("c", mapping).alias("c")).collect()] == ["v5", "v2999", "other", None]
    assert sorted(str(r["c"]) for r in recode_values(df, "c", mapping).collect()) == ["None", "other", "v2999", "v5"]
    assert [r["d"] for r in recode_values(df, "c", {"k5": "x"}, out="d").collect()] == ["x", "k2999", "other", None]
