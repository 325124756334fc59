"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTHS


def month_number(name: Column) -> Column:
    """English month name to 1..12, null for any other text."""
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.nullif(position, F.lit(0)).cast("int")


def month_name(date: Column) -> Column:
    """English month name of a date."""
    return F.date_format(date, "MMMM")


def month_year(date: Column) -> Column:
    """Month of a date as ``yyyy-MM``."""
    return F.date_format(date, "yyyy-MM")


def quarter_label(date: Column) -> Column:
    """Quarter of a date as ``yyyyQn``."""
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def arrival_date(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts; parts that form no date give null."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero).cast("date")


def two_digits(number: Column) -> Column:
    """A whole number as text with at least two digits, ``07``."""
    return F.when(number.isNotNull(), F.format_string("%02d", number))
