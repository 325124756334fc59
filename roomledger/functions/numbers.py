"""Numeric expressions: coercion, safe ratios and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(col: Column) -> Column:
    """Coerce to double; text that is no number, and NaN, become null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def integer_or_zero(col: Column) -> Column:
    """Coerce to a whole number, truncating; anything else is 0."""
    return F.coalesce(clean_number(col), F.lit(0.0)).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    return F.try_divide(numerator, denominator)


def money(col: Column) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(col, 2)


def plain_money(col: Column) -> Column:
    """Two decimals without separators."""
    return F.replace(F.format_number(col, 2), F.lit(","), F.lit(""))


def _trim_decimal(text: Column) -> Column:
    bare = F.regexp_replace(text, "0+$", "")
    return F.when(bare.endswith("."), F.concat(bare, F.lit("0"))).otherwise(bare)


def _exponent_text(col: Column) -> Column:
    text, size = col.cast("string"), F.abs(col)
    exponent = F.regexp_extract(text, r"E-?(\d+)$", 1)
    mantissa = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.0$", "")
    scientific = F.concat(
        mantissa,
        F.when(text.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent),
    )
    return (
        F.when((size >= 1e7) & (size < 1e16), _trim_decimal(text.try_cast("decimal(38,17)").cast("string")))
        .when((size >= 1e-4) & (size < 1), _trim_decimal(text.try_cast("decimal(38,24)").cast("string")))
        .otherwise(scientific)
    )


def python_float(col: Column) -> Column:
    """Text of a double with the exponent form only below 1e-4 and from 1e16 on.

    Spark turns to ``1.2E7`` style at 1e7 and below 1e-3, so values between the
    two limits are written out through an exact decimal of the shortest text.
    Few values need that; as a lambda it stays out of the generated code, which
    would otherwise grow too long for the JVM to compile.
    """
    text = col.cast("string")
    rare = F.transform(F.array(col), _exponent_text)[0]
    return F.when(~text.contains("E"), text).otherwise(rare)
