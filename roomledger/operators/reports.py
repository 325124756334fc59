"""Report aggregates.

Group-bys here drop rows without a key unless ``null_keys='keep'``; means skip
nulls, and a sum over nothing is 0. Rates are percentages unless the name says
``fraction``. Every report is one partial-then-final hash aggregate, so a key
that holds a large share of the rows arrives at the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_number, month_name, month_year, quarter_label
from ..schema import LEAD_TIME_EDGES, LEAD_TIME_LABELS
from .features import normalize_country
from .filters import known_country
from .joins import fill_bins, fill_months, semi_join_top_k
from .stats import cut_bins, quantile_bins


# ---- building blocks --------------------------------------------------------


def total(col: str) -> Column:
    """Sum, 0 when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def percent(flag: str = "is_canceled") -> Column:
    """Share of set flags in percent."""
    return F.avg(flag) * 100


def grouped(df: DataFrame, keys: Sequence[str | Column], aggs: Sequence[Column], null_keys: str = "drop") -> DataFrame:
    """Aggregate per key, with or without the rows that have no key."""
    if null_keys == "drop":
        for key in keys:
            df = df.where((F.col(key) if isinstance(key, str) else key).isNotNull())
    return df.groupBy(*keys).agg(*aggs)


def by_month(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregate per arrival month: ``(month_year, ...)``.

    Rows are grouped on the truncated date; only the results are formatted.
    """
    result = grouped(df, [F.trunc("arrival_date", "month").alias("_month")], aggs)
    return result.select(month_year(F.col("_month")).alias("month_year"), *result.columns[1:])


def count_by(df: DataFrame, *keys: str, name: str = "bookings", null_keys: str = "drop") -> DataFrame:
    """Rows per key."""
    return grouped(df, keys, [F.count("*").alias(name)], null_keys)


def mean_by(df: DataFrame, key: str, measure: str, null_keys: str = "drop") -> DataFrame:
    """Mean of a measure per key."""
    return grouped(df, [key], [F.avg(measure).alias(measure)], null_keys)


def means_by_columns(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Means of several measures by several columns, in one pass: ``(column_name, measure, value, mean)``."""
    keys, measures = dict.fromkeys(k for k, _ in pairs), dict.fromkeys(m for _, m in pairs)
    wide = per_column(df, list(keys), *[F.avg(m).alias(m) for m in measures])
    wanted = [F.struct(F.lit(k).alias("of"), F.lit(m).alias("measure"), F.col(m).alias("mean")) for k, m in pairs]
    long = wide.select("column_name", "value", F.inline(F.array(*wanted))).where(F.col("of") == F.col("column_name"))
    return long.select("column_name", "measure", "value", "mean")


def sum_by(df: DataFrame, *keys: str, measure: str = "revenue", null_keys: str = "drop") -> DataFrame:
    """Sum of a measure per key."""
    return grouped(df, keys, [total(measure).alias(measure)], null_keys)


def per_column(df: DataFrame, cols: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per value of each of several columns, in one pass: ``(column_name, value, ...)``.

    A row meets its groups of all columns in the task that reads it and is combined
    there; values are given as text, rows without a value are left out.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    spread = df.select("*", F.explode(F.array(*pairs)).alias("_pair"))
    keys = [F.col("_pair.column_name").alias("column_name"), F.col("_pair.value").alias("value")]
    return spread.where(F.col("_pair.value").isNotNull()).groupBy(*keys).agg(*aggs)


def top(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go to the smaller key."""
    return df.orderBy(F.desc(by), key).limit(k)


# ---- overview ---------------------------------------------------------------


def overview_metrics(df: DataFrame) -> DataFrame:
    """Bookings, revenue, mean daily rate and cancellation rate in one row."""
    return df.agg(
        F.count("*").alias("bookings"),
        total("revenue").alias("revenue"),
        F.avg("adr").alias("average_adr"),
        percent().alias("cancel_rate"),
    )


def bookings_by(df: DataFrame, col: str) -> DataFrame:
    """Bookings per value of a column, most frequent first."""
    return count_by(df, col).orderBy(F.desc("bookings"), col)


def bookings_by_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bookings per value of every column: ``(column_name, value, bookings)``."""
    return per_column(df, cols, F.count("*").alias("bookings"))


def status_share(df: DataFrame, col: str = "reservation_status") -> DataFrame:
    """Bookings per value and their share of all in percent."""
    counts = count_by(df, col)
    everything = counts.agg(F.sum("bookings")).scalar()
    return counts.withColumn("share", F.col("bookings") * F.lit(100.0) / everything)


def segment_share(df: DataFrame) -> DataFrame:
    """Share of bookings per market segment."""
    return status_share(df, "market_segment")


def monthly_bookings(df: DataFrame) -> DataFrame:
    """Bookings per arrival month."""
    return by_month(df, F.count("*").alias("booking_count"))


def bookings_per_month_name(df: DataFrame) -> DataFrame:
    """Bookings per month name over all years, twelve rows in calendar order."""
    counts = count_by(df, "arrival_date_month")
    return fill_months(counts, "arrival_date_month", ["bookings"]).orderBy("month_num")


# ---- revenue ----------------------------------------------------------------


def revenue_by_period(df: DataFrame, level: str | None = None) -> DataFrame:
    """Revenue per month, quarter and year: ``(level, period, revenue)``.

    The rows are added up once, per month; quarters and years come from the
    monthly sums.
    """
    month = F.trunc("arrival_date", "month").alias("month")
    months = grouped(df, [month], [total("revenue").alias("revenue")])
    levels = {
        "monthly": month_year(F.col("month")),
        "quarterly": quarter_label(F.col("month")),
        "yearly": F.year("month").cast("string"),
    }
    if level is not None:
        levels = {level: levels[level]}
    periods = F.array(
        *[F.struct(F.lit(n).alias("level"), p.alias("period")) for n, p in levels.items()]
    )
    rows = months.select("revenue", F.inline(periods))
    return rows.groupBy("level", "period").agg(F.sum("revenue").alias("revenue"))


def revenue_by_hotel(df: DataFrame) -> DataFrame:
    """Revenue per hotel, largest first."""
    return sum_by(df, "hotel").orderBy(F.desc("revenue"), "hotel")


def adr_by_month(df: DataFrame) -> DataFrame:
    """Mean daily rate per arrival month."""
    return by_month(df, F.avg("adr").alias("adr"))


def segment_channel_revenue(df: DataFrame) -> DataFrame:
    """Revenue per market segment and distribution channel."""
    return sum_by(df, "market_segment", "distribution_channel")


def pivot_values(df: DataFrame, col: str, limit: int = 10_000) -> list[str]:
    """The values of a column, to be used as columns; more than ``limit`` are an error."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} values")
    return [row[0] for row in found]


def _pivoted(long: DataFrame, key: str, col: str, measure: str, values: Sequence[str] | None, limit: int) -> DataFrame:
    """One column per value; with ``values`` given, all others are added up in ``other``."""
    if values is None:
        return long.groupBy(key).pivot(col, pivot_values(long, col, limit)).agg(F.sum(measure))
    sums = [F.sum(F.when(F.col(col) == v, F.col(measure))).alias(v) for v in values]
    rest = F.sum(F.when(~F.col(col).isin(list(values)), F.col(measure))).alias("other")
    return long.groupBy(key).agg(*sums, rest)


def segment_channel_pivot(df: DataFrame, channels: Sequence[str] | None = None, limit: int = 10_000) -> DataFrame:
    """Revenue per market segment, one column per channel; null where none.

    The long sums are aggregated first and only they are pivoted. Without
    ``channels`` the channels found become columns, ``limit`` at most; with them, a
    column ``other`` holds the revenue of all channels that are not listed, so row
    totals are always those of the long sums.
    """
    return _pivoted(segment_channel_revenue(df), "market_segment", "distribution_channel", "revenue", channels, limit)


def revenue_means(df: DataFrame) -> DataFrame:
    """Revenue in total, per booking and per guest (mean of the ratios)."""
    return df.agg(
        total("revenue").alias("revenue"),
        F.avg("revenue_per_booking").alias("revenue_per_booking"),
        F.avg("revenue_per_guest").alias("revenue_per_guest"),
    )


# ---- cancellations ----------------------------------------------------------


def cancellation_metrics(df: DataFrame) -> DataFrame:
    """Cancellation rate, cancellations and mean lead time of canceled bookings."""
    return df.agg(
        percent().alias("cancel_rate"),
        F.coalesce(F.sum("is_canceled"), F.lit(0)).alias("cancellations"),
        F.avg(F.when(F.col("is_canceled") == 1, F.col("lead_time"))).alias("lead_time_canceled"),
    )


def cancel_rate_by(df: DataFrame, col: str) -> DataFrame:
    """Cancellation rate per value of a column."""
    return grouped(df, [col], [percent().alias("cancel_rate")])


def cancel_rates_by_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cancellation rate per value of every column, over all rows and over those whose flag is a number."""
    marked = df.withColumn("_flag", clean_number(F.col("is_canceled")))
    return per_column(marked, cols, percent().alias("cancel_rate"), percent("_flag").alias("checked_rate"))


def clean_cancel_rate_by(df: DataFrame, col: str = "hotel") -> DataFrame:
    """Cancellation rate over the rows whose flag is a number."""
    flags = df.withColumn("is_canceled", clean_number(F.col("is_canceled")))
    return cancel_rate_by(flags.where(F.col("is_canceled").isNotNull()), col)


def cancel_rate_top_booked(df: DataFrame, k: int = 10) -> DataFrame:
    """Cancellation rate of the ``k`` most booked countries, in one pass."""
    stats = grouped(df, ["country"], [F.count("*").alias("bookings"), percent().alias("cancel_rate")])
    return top(stats, "bookings", "country", k).select("country", "cancel_rate")


def top_cancel_rate_countries(df: DataFrame, min_bookings: int = 100, k: int = 10) -> DataFrame:
    """Highest cancellation rates among countries with more than ``min_bookings``."""
    aggs = [F.count("is_canceled").alias("bookings"), percent().alias("cancel_rate")]
    often = grouped(df, ["country"], aggs).where(F.col("bookings") > min_bookings)
    return top(often, "cancel_rate", "country", k)


# ---- countries --------------------------------------------------------------


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most booked country codes."""
    return top(count_by(df, "country", name="booking_count"), "booking_count", "country", k)


def top_named_countries(df: DataFrame, countries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most booked countries by name, unknown ones left out.

    Codes are counted before names are looked up, so the lookup sees one row per
    code; codes that share a name are added up.
    """
    named = normalize_country(count_by(df, "country", null_keys="keep"), countries)
    named = known_country(named, "country_name")
    sums = named.groupBy("country_name").agg(F.sum("bookings").alias("bookings"))
    return top(sums, "bookings", "country_name", k)


def mean_revenue_top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean revenue of the ``k`` most booked countries, in one pass."""
    stats = grouped(df, ["country"], [F.count("*").alias("bookings"), F.avg("revenue").alias("revenue")])
    return top(stats, "bookings", "country", k).select("country", "revenue")


def country_summary(df: DataFrame) -> DataFrame:
    """Bookings with a known flag, revenue and cancellation rate per country."""
    return grouped(
        df,
        ["country"],
        [
            F.count("is_canceled").alias("bookings"),
            total("revenue").alias("revenue"),
            percent().alias("cancel_rate"),
        ],
    )


def top_country_profile(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Bookings per country and value, for the ``k`` most booked countries."""
    return count_by(semi_join_top_k(df, "country", k), "country", col)


# ---- customers, stays, rooms, agents ----------------------------------------


def avg_stay(df: DataFrame) -> DataFrame:
    """Mean number of nights."""
    return df.agg(F.avg("total_nights").alias("average_nights"))


def room_crosstab(df: DataFrame, assigned: Sequence[str] | None = None, limit: int = 10_000) -> DataFrame:
    """Bookings per reserved room type, one column per assigned type, 0 where none.

    Columns as in :func:`segment_channel_pivot`.
    """
    counts = count_by(df, "reserved_room_type", "assigned_room_type")
    return _pivoted(counts, "reserved_room_type", "assigned_room_type", "bookings", assigned, limit).fillna(0)


def booking_changes_impact(df: DataFrame) -> DataFrame:
    """Canceled fraction and mean revenue by number of changes."""
    aggs = [F.avg("is_canceled").alias("cancel_fraction"), F.avg("revenue").alias("revenue")]
    return grouped(df, ["booking_changes"], aggs)


def seasonal_revenue(df: DataFrame) -> DataFrame:
    """Mean revenue per month name over all years, twelve rows."""
    months = grouped(
        df,
        [F.month("arrival_date").alias("_month")],
        [F.avg("revenue").alias("revenue"), F.min("arrival_date").alias("_day")],
    )
    named = months.select(month_name(F.col("_day")).alias("arrival_month_name"), "revenue")
    return fill_months(named, "arrival_month_name").orderBy("month_num")


def top_agents(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` agents with the most bookings; a filled ``unknown`` counts as one."""
    return top(count_by(df, "agent", name="booking_count"), "booking_count", "agent", k)


def agent_stats(df: DataFrame, k: int = 10) -> DataFrame:
    """Revenue and cancellation rate of the ``k`` agents with the most revenue."""
    stats = grouped(df, ["agent"], [total("revenue").alias("revenue"), percent().alias("cancel_rate")])
    return top(stats, "revenue", "agent", k)


def top_companies(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` companies with the most bookings."""
    return top(count_by(df, "company"), "bookings", "company", k)


def waitlist_vs_cancel(df: DataFrame) -> DataFrame:
    """Canceled fraction by days on the waiting list."""
    return grouped(df, ["days_in_waiting_list"], [F.avg("is_canceled").alias("cancel_fraction")])


def stay_vs_revenue(df: DataFrame, max_nights: int = 15) -> DataFrame:
    """Mean revenue by number of nights, up to ``max_nights``."""
    return mean_by(df, "total_nights", "revenue").where(F.col("total_nights") <= max_nights)


def price_sensitivity(df: DataFrame, q: int = 10, duplicates: str = "raise") -> DataFrame:
    """Mean daily rate and cancellation rate per daily-rate quantile interval."""
    binned = quantile_bins(df.select("adr", "is_canceled"), "adr", q, "adr_bin", duplicates)
    return grouped(binned, ["adr_bin"], [F.avg("adr").alias("adr"), percent().alias("cancel_rate")])


def lead_time_bins(
    df: DataFrame,
    edges: Sequence[float] = LEAD_TIME_EDGES,
    labels: Sequence[str] = LEAD_TIME_LABELS,
    include_lowest: bool = False,
) -> DataFrame:
    """Mean revenue and cancellation rate per lead-time bin, empty bins included."""
    binned = cut_bins(df, "lead_time", edges, labels, include_lowest=include_lowest)
    aggs = [F.avg("revenue").alias("revenue"), percent().alias("cancel_rate")]
    return fill_bins(grouped(binned, ["lead_time_bin"], aggs), "lead_time_bin", labels).orderBy("bin_order")


# ---- periods, rooms, lost revenue, occupancy, waiting list -------------------


def revenue_yoy(df: DataFrame) -> DataFrame:
    """Monthly and yearly revenue next to the same period one year before.

    ``(level, year, month_num, revenue, previous, change, change_percent)``; the
    prior value is null unless the year before is present.
    """
    month = F.trunc("arrival_date", "month").alias("month")
    months = grouped(df, [month], [total("revenue").alias("revenue")])
    levels = F.array(
        F.struct(F.lit("month").alias("level"), F.month("month").alias("month_num")),
        F.struct(F.lit("year").alias("level"), F.lit(None).cast("int").alias("month_num")),
    )
    rows = months.select(F.year("month").alias("year"), "revenue", F.inline(levels))
    sums = rows.groupBy("level", "year", "month_num").agg(F.sum("revenue").alias("revenue"))
    period = Window.partitionBy("level", "month_num").orderBy("year")
    before = F.when(F.lag("year").over(period) == F.col("year") - 1, F.lag("revenue").over(period))
    change = F.col("revenue") - F.col("previous")
    return sums.withColumn("previous", before).withColumns(
        {"change": change, "change_percent": F.try_divide(change * 100, F.col("previous"))}
    )


def adr_by_room_season(df: DataFrame) -> DataFrame:
    """Mean daily rate per reserved room type and quarter of the year."""
    season = F.quarter("arrival_date").alias("season")
    return grouped(df, ["reserved_room_type", season], [F.avg("adr").alias("adr")])


def cancel_rate_by_period(df: DataFrame) -> DataFrame:
    """Cancellation rate per arrival month."""
    return by_month(df, percent().alias("cancel_rate"))


def revenue_by(df: DataFrame, col: str = "reserved_room_type") -> DataFrame:
    """Revenue per value of a column, largest first."""
    return sum_by(df, col).orderBy(F.desc("revenue"), col)


def canceled_revenue_impact(df: DataFrame, col: str = "hotel") -> DataFrame:
    """Revenue, the part of it that was canceled, and that part in percent."""
    lost = F.coalesce(F.sum(F.when(F.col("is_canceled") == 1, F.col("revenue"))), F.lit(0.0))
    stats = grouped(df, [col], [total("revenue").alias("revenue"), lost.alias("canceled_revenue")])
    share = F.try_divide(F.col("canceled_revenue") * 100, F.col("revenue"))
    return stats.withColumn("canceled_percent", share)


def occupancy_by_date(df: DataFrame) -> DataFrame:
    """Guest rooms in use per night over stays that were not canceled.

    Equal stays are counted before they are spread over their nights.
    """
    held = (F.col("is_canceled") == 0) & (F.col("total_nights") > 0)
    stays = df.where(held).groupBy("arrival_date", "total_nights").agg(F.count("*").alias("rooms"))
    last = F.date_add("arrival_date", F.col("total_nights") - 1)
    nights = stays.where(F.col("arrival_date").isNotNull()).select(
        "rooms", F.explode(F.sequence(F.col("arrival_date"), last)).alias("date")
    )
    return nights.groupBy("date").agg(F.sum("rooms").alias("rooms_in_use"))


def waitlist_metrics(df: DataFrame) -> DataFrame:
    """Bookings, mean wait and cancellation rate of waiting and other bookings."""
    waited = (F.col("days_in_waiting_list") > 0).alias("waited")
    return grouped(
        df,
        [waited],
        [
            F.count("*").alias("bookings"),
            F.avg("days_in_waiting_list").alias("average_wait"),
            percent().alias("cancel_rate"),
        ],
    )
