"""Columns and shapes the reports start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_name, month_year, quarter_label
from .clean import add_revenue, add_total_nights
from .joins import lookup_dimension


def add_calendar(df: DataFrame, date: str = "arrival_date") -> DataFrame:
    """``month_year``, ``year``, ``quarter`` and ``arrival_month_name`` of a date."""
    day = F.col(date)
    return df.withColumns(
        {
            "month_year": month_year(day),
            "year": F.year(day),
            "quarter": quarter_label(day),
            "arrival_month_name": month_name(day),
        }
    )


def add_total_guests(df: DataFrame) -> DataFrame:
    """Adults, children and babies; missing children and babies count as 0."""
    minors = F.coalesce("children", F.lit(0)) + F.coalesce("babies", F.lit(0))
    return df.withColumn("total_guests", F.col("adults") + minors)


def add_revenue_per(df: DataFrame) -> DataFrame:
    """Revenue per booking and per guest, where no guests count as one."""
    guests = F.when(F.col("total_guests") == 0, F.lit(1)).otherwise(F.col("total_guests"))
    return df.withColumns(
        {
            "revenue_per_booking": F.col("revenue"),
            "revenue_per_guest": F.col("revenue") / guests,
        }
    )


def report_frame(df: DataFrame) -> DataFrame:
    """A booking table with every column the reports use.

    All added columns are expressions, so a report computes only those it reads.
    """
    df = add_revenue(add_total_nights(df))
    return add_revenue_per(add_total_guests(add_calendar(df)))


def normalize_country(df: DataFrame, countries: DataFrame, col: str = "country") -> DataFrame:
    """Add ``country_name``: the mapped name, else the code, else ``unknown``."""
    return lookup_dimension(
        df, countries, key=col, dim_key="code", value="name", output="country_name", default="unknown"
    )


def unpivot_nights(df: DataFrame) -> DataFrame:
    """One row per booking and stay type: ``(hotel, stay_type, nights)``."""
    return df.unpivot(
        "hotel", ["stays_in_weekend_nights", "stays_in_week_nights"], "stay_type", "nights"
    )


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Some ``n`` rows."""
    return df.limit(n)
