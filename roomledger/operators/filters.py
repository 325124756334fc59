"""Row filters. All are plain predicates.

On stored booking tables they reach the Parquet scan. On the star schema only the
date range does: hotel and customer type are computed there from other columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_number


def filter_date_range(
    df: DataFrame, start: dt.date | str, end: dt.date | str, col: str = "arrival_date"
) -> DataFrame:
    """Rows whose date lies in ``[start, end]``; rows without a date drop out."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_in(df: DataFrame, col: str, values: Sequence[object] | None) -> DataFrame:
    """Rows whose value is listed; an empty list means no filter."""
    return df.where(F.col(col).isin(*values)) if values else df


def dashboard_filter(
    df: DataFrame,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    hotels: Sequence[str] | None = None,
    customer_types: Sequence[str] | None = None,
) -> DataFrame:
    """Date range, hotels and customer types together; a half-open range is no range."""
    if start is not None and end is not None:
        df = filter_date_range(df, start, end)
    return filter_in(filter_in(df, "hotel", hotels), "customer_type", customer_types)


def positive_nights(df: DataFrame) -> DataFrame:
    """Stays of at least one night."""
    return df.where(F.col("total_nights") > 0)


def adr_below(df: DataFrame, limit: float = 500) -> DataFrame:
    """Daily rates strictly below a limit; negative rates stay, null rates go."""
    return df.where(F.col("adr") < limit)


def adr_open_range(df: DataFrame, low: float = 0, high: float = 500) -> DataFrame:
    """Numeric daily rates strictly between two limits."""
    df = df.withColumn("adr", clean_number(F.col("adr")))
    return df.where((F.col("adr") > low) & (F.col("adr") < high))


def canceled_only(df: DataFrame) -> DataFrame:
    """Canceled bookings, no-shows among them."""
    return df.where(F.col("is_canceled") == 1)


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in every listed column."""
    return df.dropna(subset=list(cols))


def known_country(df: DataFrame, col: str = "country") -> DataFrame:
    """Rows with a country other than ``unknown`` in any letter case."""
    return df.where(F.lower(col) != "unknown")


def date_bounds(df: DataFrame, col: str = "arrival_date") -> DataFrame:
    """First and last date as one row."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The different values of a column."""
    return df.select(col).distinct()
