"""Locale-aware number handling as Column expressions.

All of these are built-in Spark expressions, so they stay inside whole-stage codegen and
never leave the JVM. Each takes and returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiopanel.functions._col import as_col

# The text markers that mean "no value" (compared after trim, lower-cased).
NULL_MARKERS = ("na", "n/a", "null", "none", "-", "—")


def trim_spaces(c) -> Column:
    """Strip leading and trailing spaces (0x20 only; a tab survives, as in Spark's ``trim``)."""
    return F.trim(as_col(c).cast("string"))


def null_markers(c, markers=NULL_MARKERS) -> Column:
    """Null, empty text or a marker (case-insensitive) becomes null; other text is kept.

    The input is compared as given; call :func:`trim_spaces` first for padded text.
    """
    c = as_col(c)
    markers = [m.lower() for m in markers]
    is_missing = c.isNull() | (c == F.lit(""))
    if markers:
        is_missing = is_missing | F.lower(c).isin(*markers)
    return F.when(is_missing, F.lit(None).cast("string")).otherwise(c)


def separator_swap(c, thousands: str | None = ".", decimal: str = ",") -> Column:
    """P5: remove every thousands separator and turn the decimal separator into a point.

    One ``translate`` pass: the decimal char maps to '.', the thousands char maps to nothing.
    Note (T1): every thousands char goes, so an already point-decimal '2162.23' becomes '216223'.
    """
    c = as_col(c)
    if thousands:
        if decimal == ".":
            return F.translate(c, thousands, "")
        return F.translate(c, decimal + thousands, ".")
    if decimal == ".":
        return c
    return F.translate(c, decimal, ".")


def try_double(c) -> Column:
    """Cast text to double; malformed text becomes null instead of failing the job."""
    return as_col(c).try_cast("double")


def locale_number(c, thousands: str | None = ".", decimal: str = ",", markers=NULL_MARKERS) -> Column:
    """Locale text -> double. trim -> null markers -> separator swap -> safe cast.

    ``' 215.855,04 '`` -> 215855.04, ``' NA '`` -> null, ``'1,2,3'`` -> null.
    Must not be applied to a column that already holds point-decimal numbers (T1).
    """
    cleaned = null_markers(trim_spaces(c), markers)
    return try_double(separator_swap(cleaned, thousands, decimal))


def year_int(c, on_error: str = "fail") -> Column:
    """Text year -> int. ``on_error='fail'`` fails the job on text that is not an integer
    (T5), whatever the session's ANSI setting; ``on_error='null'`` turns it into null.
    Surrounding spaces are accepted."""
    c = as_col(c)
    if on_error == "fail":
        parsed = c.try_cast("int")
        return F.when(c.isNotNull() & parsed.isNull(),
                      F.raise_error(F.concat(F.lit("not a year: "), c.cast("string")))).otherwise(parsed)
    if on_error == "null":
        return c.try_cast("int")
    raise ValueError("on_error must be 'fail' or 'null'")


def format_decimal(c, decimal: str = ",", single: bool = False) -> Column:
    """Double -> text in plain notation with ``decimal`` as the decimal mark.

    Shortest round-trip digits as for a Python float repr, so ``1234.5 -> '1234,5'`` and
    ``3.0 -> '3,0'``. Where Spark prints an exponent (>= 1e7 or < 1e-3) its digits are written out, up to 30 before
    the mark or 30 behind it; beyond that the exponent stays (``4.9E-324 -> '4,9E-324'``). No digit is computed anew, so no finite
    double changes. ``single`` keeps the digits of a float column (``0.1``, not ``0.10000000149011612``).
    NaN and null become null (written as an empty field); infinities become 'inf' / '-inf'.
    """
    c = as_col(c) if single else as_col(c).cast("double")
    text = c.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    mantissa, power = F.substring_index(F.ltrim(text, F.lit("-")), "E", 1), F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^(.)0$", "$1")  # 1.0E7 has one digit
    n = F.length(digits)
    large = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."),
                     F.when(n > power + 1, F.substring(digits, power + 2, n)).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when((power > 0) & (power < 30), large).when((power < 0) & (n - power - 1 <= 30), small).otherwise(text)
    out = (F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
           .when(F.abs(c) == F.lit(float("inf")), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
           .when(F.contains(text, F.lit("E")), plain)
           .otherwise(text))
    return out if decimal == "." else F.translate(out, ".", decimal)
