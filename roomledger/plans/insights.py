"""Stored insights. Keys may be null here: rows without a key form a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, month_number, plain_money, ratio, two_digits
from ..operators.reports import top
from ..schema import INSIGHT_SCHEMAS
from ..scratch import stored
from ..sources.insights import insight_exists, read_insight, write_insight


#: Key columns of the sums, and which of them each level groups by.
_KEYS = ("arrival_date_year", "arrival_date_month", "country", "reservation_status_date")
_LEVELS = {"month": _KEYS[:2], "country": _KEYS[2:3], "date": _KEYS[3:], "all": ()}


def insight_sums(df: DataFrame, levels: Sequence[str] = tuple(_LEVELS)) -> DataFrame:
    """All counts and sums the insights need, from one pass: ``(level, keys, measures)``.

    One aggregate over grouping sets, combined in each task before the shuffle. Null
    keys are groups of their own.
    """
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    level_of = {sum(1 << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS) if k not in _LEVELS[name]): name for name in levels}
    level = F.coalesce(*[F.when(F.grouping_id() == bits, name) for bits, name in level_of.items()])
    sets = [[F.col(k) for k in _LEVELS[name]] for name in levels]
    return df.groupingSets(sets, *_KEYS).agg(
        level.alias("level"),
        F.count("*").alias("bookings"),
        F.count_if(F.col("is_canceled") == 1).alias("cancellations"),
        F.sum(F.col("adr") * nights).alias("revenue"),
        F.sum("adr").alias("adr_sum"),
        F.count("adr").alias("adr_count"),
    )


def _level(sums: DataFrame, name: str) -> DataFrame:
    return sums.where(F.col("level") == name)


def _revenue(sums: DataFrame) -> DataFrame:
    month = two_digits(F.coalesce(month_number(F.col("month")), F.lit(0)))
    named = _level(sums, "month").select(
        F.col("arrival_date_month").alias("month"), F.col("arrival_date_year").alias("year"), "revenue"
    )
    return named.orderBy("year", month)


def _locations(sums: DataFrame, k: int = 10) -> DataFrame:
    counts = _level(sums, "country").where("cancellations > 0")
    return top(counts.select(F.col("country").alias("location"), "cancellations"), "cancellations", "location", k)


def _average_adr(sums: DataFrame) -> DataFrame:
    return _level(sums, "all").agg(ratio(F.sum("adr_sum"), F.sum("adr_count")).alias("average_adr"))


def _countries(sums: DataFrame, k: int = 10) -> DataFrame:
    return top(_level(sums, "country").select("country", F.col("bookings").alias("count")), "count", "country", k)


def _dates(sums: DataFrame) -> DataFrame:
    counts = _level(sums, "date").where("cancellations > 0")
    return counts.select(F.col("reservation_status_date").alias("date"), F.col("cancellations").alias("count"))


def revenue_insights(df: DataFrame) -> DataFrame:
    """Revenue per year and month in calendar order; unknown months come first."""
    return _revenue(insight_sums(df, ["month"]))


def cancellation_insights(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` country codes with the most cancellations."""
    return _locations(insight_sums(df, ["country"]), k)


def average_adr_insight(df: DataFrame) -> DataFrame:
    """Mean daily rate over all bookings."""
    return df.agg(F.avg("adr").alias("average_adr"))


def top_booking_countries(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` country codes with the most bookings."""
    return _countries(insight_sums(df, ["country"]), k)


def cancellations_per_date(df: DataFrame) -> DataFrame:
    """Cancellations per status date, all dates."""
    return _dates(insight_sums(df, ["date"]))


def cancellation_by_date(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` status dates with the most cancellations."""
    return top(cancellations_per_date(df), "count", "date", k)


#: Every insight from the shared sums.
INSIGHTS = {
    "revenue_insights": _revenue,
    "cancellation_insights": _locations,
    "average_adr_insight": _average_adr,
    "top_booking_countries": _countries,
    "cancellation_by_date": lambda sums: top(_dates(sums), "count", "date", 10),
    "cancellations_per_date": _dates,
}


def compute_insights(df: DataFrame) -> dict[str, DataFrame]:
    """All insight tables from one pass over the bookings, whose sums are stored."""
    sums = stored(insight_sums(df), "insight-sums")
    return {name: build(sums) for name, build in INSIGHTS.items()}


def build_insights(df: DataFrame, store: str, force: bool = False) -> list[str]:
    """Store the insight tables that are missing, or all; returns the names written.

    The bookings are read once, however many tables are written.
    """
    wanted = [name for name in INSIGHTS if force or not insight_exists(df.sparkSession, store, name)]
    if wanted:
        sums = stored(insight_sums(df), "insight-sums")
        for name in wanted:
            write_insight(INSIGHTS[name](sums), store, name)
    return wanted


def load_insights(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """All stored insight tables."""
    return {name: read_insight(spark, store, name) for name in INSIGHT_SCHEMAS}


def analytics_report(insights: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The insights as display rows: ``(section, rank, label, value)``.

    Each section is a stored table of at most a few hundred rows.
    """

    def section(df: DataFrame, name: str, order: list, label, value) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("section").orderBy(*order))
        rows = df.withColumn("section", F.lit(name)).withColumn("rank", rank)
        return rows.select("section", "rank", label.cast("string").alias("label"), value.alias("value"))

    month = F.coalesce(month_number(F.col("month")), F.lit(0))
    revenue = insights["revenue_insights"]
    count = F.col("count").cast("string")
    adr = insights["average_adr_insight"].limit(1)
    parts = [
        section(revenue, "revenue_trends", [F.col("year"), month],
                F.concat_ws(" ", "month", "year"), money(F.col("revenue"))),
        section(top(insights["cancellation_insights"], "cancellations", "location", k),
                "top_cancellation_locations", [F.desc("cancellations"), F.col("location")],
                F.col("location"), F.col("cancellations").cast("string")),
        section(adr, "average_adr", [F.col("average_adr")], F.lit(None),
                F.coalesce(plain_money(F.col("average_adr")), F.lit("N/A"))),
        section(top(insights["top_booking_countries"], "count", "country", k),
                "top_booking_countries", [F.desc("count"), F.col("country")], F.col("country"), count),
        section(top(insights["cancellation_by_date"], "count", "date", k),
                "top_cancellation_dates", [F.desc("count"), F.col("date")], F.col("date"), count),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionAll(part)
    return report


def analytics_json(insights: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The same report as one JSON document."""

    def rows(df: DataFrame, order: list, **fields) -> F.Column:
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
        item = F.struct(*[value.alias(name) for name, value in fields.items()])
        packed = df.select(F.struct(rank.alias("rank"), item.alias("item")).alias("entry"))
        ordered = F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["item"])
        return packed.agg(ordered.alias("rows")).scalar()

    month = F.coalesce(month_number(F.col("month")), F.lit(0))
    spark = insights["revenue_insights"].sparkSession
    document = F.struct(
        rows(insights["revenue_insights"], [F.col("year"), month],
             month=F.col("month"), year=F.col("year"), revenue=money(F.col("revenue"))).alias("revenue_trends"),
        rows(top(insights["cancellation_insights"], "cancellations", "location", k),
             [F.desc("cancellations"), F.col("location")],
             location=F.col("location"), cancellations=F.col("cancellations")).alias("top_cancellation_locations"),
        F.coalesce(
            insights["average_adr_insight"].limit(1).select(plain_money(F.col("average_adr"))).scalar(),
            F.lit("N/A"),
        ).alias("average_adr"),
        rows(top(insights["top_booking_countries"], "count", "country", k), [F.desc("count"), F.col("country")],
             country=F.col("country"), count=F.col("count")).alias("top_booking_countries"),
        rows(top(insights["cancellation_by_date"], "count", "date", k), [F.desc("count"), F.col("date")],
             date=F.col("date"), count=F.col("count")).alias("top_cancellation_dates"),
    )
    options = {"ignoreNullFields": "false"}
    return spark.range(1, numPartitions=1).select(F.to_json(document, options).alias("report"))
