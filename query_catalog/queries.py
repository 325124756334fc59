"""One registered query per operator or small family of operators.

Operators return exact values; ratios are rounded here, for comparison only.
Row-level operators are summarised by counting equal result rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger import functions as fn
from roomledger.operators import cells, clean, features, filters, joins, ml, reports, stats, vectors
from roomledger.plans import cleaning, insights, questions
from roomledger.schema import COUNTRY_NAMES, CORRELATION_COLUMNS, RAW_TYPES
from roomledger.scratch import scratch_path, stored
from roomledger.sources import (
    read_bookings,
    read_bookings_csv,
    read_country_map,
    read_insight,
    write_bookings,
)

from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Query name -> survey ids it exercises.
COVERAGE: dict[str, str] = {}

#: Channels with a column of their own; the others are added up.
CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def query(ids: str):
    """Register ``f(inputs) -> DataFrame`` under its own name."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        COVERAGE[f.__name__] = ids
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def tally(df: DataFrame, *cols: str) -> DataFrame:
    """How often each combination of values occurs."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def profile(df: DataFrame) -> DataFrame:
    """Row count and exact sums of a booking table per hotel and year."""
    sums = [c for c, t in RAW_TYPES.items() if t.typeName() in ("integer", "double") and c != "arrival_date_year"]
    texts = [c for c, t in RAW_TYPES.items() if t.typeName() == "string" and c != "hotel"]
    return df.groupBy("hotel", "arrival_date_year").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.length(c)).alias(c) for c in texts],
        F.min("reservation_status_date").alias("first_status"),
        F.max("reservation_status_date").alias("last_status"),
        F.count("arrival_date").alias("arrivals"),
    )


# ---- sources and sinks ----------------------------------------------------------


@query("S7")
def bookings_source(t):
    return profile(t.bookings)


@query("S1 S2")
def csv_round_trip(t):
    path = scratch_path(t.spark, "bookings-csv")
    write_bookings(t.bookings, path, format="csv")
    return profile(read_bookings_csv(t.spark, path))


@query("S2 F1")
def clustered_write(t):
    path = scratch_path(t.spark, "bookings")
    write_bookings(features.report_frame(clean.add_month_number(t.bookings)), path, cluster_by="arrival_date")
    rows = filters.filter_date_range(read_bookings(t.spark, path), "1997-03-01", "1998-02-28")
    return rows.groupBy("hotel", "arrival_month_num").agg(
        F.count("*").alias("n"), F.sum("total_nights").alias("nights"), F.sum("revenue").alias("revenue")
    )


@query("S3 J3 P18 C9")
def country_map_file(t):
    path = scratch_path(t.spark, "countries")
    pairs = [F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair]
    one = t.spark.range(1, numPartitions=1)
    one.select(F.to_json(F.create_map(*pairs)).alias("value")).write.text(path)
    counts = reports.count_by(t.bookings, "country", null_keys="keep")
    return features.normalize_country(counts, read_country_map(t.spark, path))


@query("S4 S5 S6")
def stored_insights(t):
    store = scratch_path(t.spark, "insights")
    insights.build_insights(t.bookings, store)
    stored = insights.load_insights(t.spark, store)
    labels = {
        "revenue_insights": (F.concat_ws(" ", "month", "year"), "revenue"),
        "cancellation_insights": (F.col("location"), "cancellations"),
        "top_booking_countries": (F.col("country"), "count"),
        "cancellation_by_date": (F.col("date").cast("string"), "count"),
        "cancellations_per_date": (F.col("date").cast("string"), "count"),
    }
    return union(
        [
            stored[name].select(F.lit(name).alias("insight"), label.alias("label"),
                                F.col(value).cast("double").alias("value"))
            for name, (label, value) in labels.items()
        ]
    )


@query("S4 S5 T5")
def stored_first_row(t):
    store = scratch_path(t.spark, "insights")
    insights.write_insight(insights.average_adr_insight(t.bookings), store, "average_adr_insight")
    return rounded(read_insight(t.spark, store, "average_adr_insight", first=True), "average_adr")


# ---- clean-up and derivation ------------------------------------------------------


@query("P1")
def stripped_column_names(t):
    return tally(clean.strip_column_names(t.export(1)), "meal")


@query("P2 C1")
def stripped_strings(t):
    return tally(clean.strip_strings(t.export(1)), "hotel", "deposit_type")


@query("P3 C8")
def filled_defaults(t):
    return tally(clean.fill_defaults(t.export(2)), "children", "country", "agent", "company")


@query("P4 C12")
def filled_medians(t):
    return tally(clean.fill_numeric_median(clean.fill_defaults(t.export(1))), "adr", "children")


@query("P5")
def rows_with_values(t):
    return tally(clean.drop_all_null_rows(t.bookings.select("country", "company", "adr")), "country", "company")


@query("P6")
def null_summary(t):
    return clean.null_summary(t.bookings)


@query("P6")
def missing_columns(t):
    return clean.null_summary(t.bookings, k=None, only_missing=True)


@query("P6")
def missing_total(t):
    return clean.missing_total(t.bookings)


@query("P7")
def truncated_ints(t):
    return tally(clean.to_int(t.bookings, ["adults", "children", "babies", "adr"]), "adults", "children", "babies", "adr")


@query("P8 C6")
def parsed_dates(t):
    return tally(clean.parse_dates(t.export(1)), "reservation_status_date")


@query("P9 C7")
def coerced_ints(t):
    return tally(clean.coerce_int_or_zero(clean.fill_defaults(t.export(1))), "children", "agent", "company")


@query("P10")
def display_defaults(t):
    return tally(clean.fill_display_defaults(t.bookings), "country", "meal")


@query("P11 C10")
def total_nights(t):
    nights = ["stays_in_weekend_nights", "stays_in_week_nights"]
    plain = tally(clean.add_total_nights(t.bookings), *nights, "total_nights")
    gaps = t.bookings.withColumn(
        "stays_in_week_nights", F.when(F.col("children").isNotNull(), F.col("stays_in_week_nights"))
    )
    safe = tally(clean.add_total_nights(gaps, null_safe=True), *nights, "total_nights")
    return union([plain.withColumn("variant", F.lit("plain")), safe.withColumn("variant", F.lit("null safe"))])


@query("P12")
def revenue(t):
    nights = clean.add_total_nights(t.bookings)
    plain = tally(clean.add_revenue(nights), "adr", "total_nights", "revenue")
    safe = tally(clean.add_revenue(nights, null_safe=True), "adr", "total_nights", "revenue")
    return union([plain.withColumn("variant", F.lit("plain")), safe.withColumn("variant", F.lit("null safe"))])


@query("P13")
def month_numbers(t):
    return tally(clean.add_month_number(t.bookings), "arrival_date_month", "arrival_month_num")


@query("P14")
def arrival_dates(t):
    return tally(clean.add_arrival_date(clean.add_month_number(t.export(2))), "arrival_date")


@query("P15 C6")
def calendar_columns(t):
    return tally(t.facts, "month_year", "year", "quarter", "arrival_month_name")


@query("P16")
def total_guests(t):
    return tally(t.facts, "adults", "children", "babies", "total_guests")


@query("P17")
def revenue_per(t):
    per = t.facts.groupBy("hotel", "total_guests").agg(
        F.sum("revenue_per_booking").alias("per_booking"), F.sum("revenue_per_guest").alias("per_guest")
    )
    return rounded(per, "per_guest", places=3)


@query("P18 J3")
def country_names(t):
    return tally(features.normalize_country(t.bookings, t.countries), "country", "country_name")


@query("P19 P1 P2 P3 P4 P5 P7 P8 P11 P12 P13 P14 F4 F5 U1 U2")
def preprocessed(t):
    rows = cleaning.preprocess(*t.exports)
    return rows.groupBy("hotel", "arrival_month_num", "country", "reservation_status").agg(
        F.count("*").alias("n"),
        F.sum("total_nights").alias("nights"),
        F.sum("children").alias("children"),
        F.sum("adr").alias("adr"),
        F.sum("revenue").alias("revenue"),
        F.count("arrival_date").alias("arrivals"),
        F.count("reservation_status_date").alias("status_dates"),
        F.min("arrival_date").alias("first_arrival"),
        F.max("reservation_status_date").alias("last_status"),
        F.sum(F.length("agent") + F.length("company") + F.length("meal")).alias("letters"),
    )


@query("P20")
def unpivoted_nights(t):
    return tally(features.unpivot_nights(t.bookings), "hotel", "stay_type", "nights")


@query("P21")
def available_columns(t):
    chosen = features.select_available(t.bookings, ["meal", "no_such_column", "adults"])
    return tally(chosen, *chosen.columns)


@query("P22")
def preview(t):
    cols = ["arrival_date", "adr", "lead_time", "hotel"]
    ordered = t.bookings.select(*cols).dropna().orderBy(*cols)
    return features.preview(ordered)


@query("P23")
def stage_counts(t):
    return cleaning.stage_counts(*t.exports)


@query("P23")
def observed_stage_counts(t):
    return cleaning.preprocess_counted(*t.exports, path=scratch_path(t.spark, "preprocessed"))


@query("U1")
def union_of_exports(t):
    second = t.export(2).drop("company")
    return tally(clean.union_by_name(t.export(1), second), "hotel", "company")


@query("U2")
def distinct_rows(t):
    both = clean.union_by_name(*t.exports)
    return tally(clean.drop_duplicate_rows(both), "hotel", "is_canceled", "country")


# ---- filters -------------------------------------------------------------------


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("hotel", "customer_type").agg(F.count("*").alias("n"), F.sum("adr").alias("adr"))


@query("F1")
def date_range(t):
    return _summary(filters.filter_date_range(t.bookings, "1996-07-01", "1997-06-30"))


@query("F2")
def listed_values(t):
    some = _summary(filters.filter_in(t.bookings, "customer_type", ["Group", "Contract"]))
    every = _summary(filters.filter_in(t.bookings, "customer_type", []))
    return union([some.withColumn("variant", F.lit("listed")), every.withColumn("variant", F.lit("empty list"))])


@query("F3")
def dashboard_rows(t):
    return _summary(
        filters.dashboard_filter(t.bookings, "1996-01-01", "1998-12-31", ["City Hotel"], ["Group", "Transient"])
    )


@query("F3")
def dashboard_no_match(t):
    return _summary(filters.dashboard_filter(t.bookings, "1980-01-01", "1980-12-31"))


@query("F4")
def positive_nights(t):
    return _summary(filters.positive_nights(t.facts))


@query("F5")
def adr_below(t):
    return _summary(filters.adr_below(t.bookings, 500))


@query("F6")
def adr_open_range(t):
    return _summary(filters.adr_open_range(t.bookings, 0, 500))


@query("F7")
def canceled_rows(t):
    return _summary(filters.canceled_only(t.bookings))


@query("F8")
def complete_rows(t):
    return _summary(filters.drop_null_rows(t.bookings, ["adr", "children", "country"]))


@query("F9")
def known_countries(t):
    return _summary(filters.known_country(clean.fill_display_defaults(t.bookings)))


@query("F10")
def date_bounds(t):
    return filters.date_bounds(t.bookings)


@query("F11")
def filter_choices(t):
    return union(
        [
            filters.distinct_values(t.bookings, c).select(F.lit(c).alias("column_name"), F.col(c).alias("value"))
            for c in ("hotel", "customer_type")
        ]
    )


# ---- joins ---------------------------------------------------------------------


@query("J1")
def top_country_rows(t):
    return reports.top_country_profile(t.bookings, "customer_type")


@query("J2")
def frequent_arrival_rows(t):
    return tally(joins.semi_join_min_count(t.bookings, "arrival_date", 20), "arrival_date", "hotel")


@query("J2")
def frequent_country_rows(t):
    return tally(joins.semi_join_min_count(t.bookings, "country", 20), "country", "customer_type")


# ---- insights ------------------------------------------------------------------


@query("A1 T2")
def revenue_insights(t):
    return insights.revenue_insights(t.bookings)


@query("A2 T1 F7")
def cancellation_insights(t):
    return insights.cancellation_insights(t.bookings)


@query("A3")
def average_adr_insight(t):
    return rounded(insights.average_adr_insight(t.bookings), "average_adr")


@query("A4 T1")
def top_booking_countries(t):
    return insights.top_booking_countries(t.bookings)


@query("A5 T1")
def cancellation_by_date(t):
    return insights.cancellation_by_date(t.bookings)


@query("A5")
def cancellations_per_date(t):
    return insights.cancellations_per_date(t.bookings)


@query("A6 T1 T2 C4 C5")
def analytics_report(t):
    return insights.analytics_report(insights.compute_insights(t.bookings))


@query("A6")
def analytics_json(t):
    return insights.analytics_json(insights.compute_insights(t.bookings))


# ---- reports -------------------------------------------------------------------


@query("A10")
def overview_metrics(t):
    return rounded(reports.overview_metrics(t.facts), "average_adr", "cancel_rate")


@query("A11")
def bookings_by_column(t):
    cols = ["hotel", "is_canceled", "reservation_status", "customer_type", "reserved_room_type",
            "market_segment", "distribution_channel"]
    return reports.bookings_by_columns(t.facts, cols)


@query("A12")
def status_share(t):
    return rounded(reports.status_share(t.facts), "share")


@query("A13")
def monthly_bookings(t):
    return reports.monthly_bookings(t.facts)


@query("A14 J4")
def bookings_per_month_name(t):
    return reports.bookings_per_month_name(t.facts)


@query("A15")
def revenue_by_period(t):
    return reports.revenue_by_period(t.facts)


@query("A16")
def revenue_by_hotel(t):
    return reports.revenue_by_hotel(t.facts)


@query("A17")
def adr_by_month(t):
    return rounded(reports.adr_by_month(t.facts), "adr")


@query("A18")
def segment_channel_revenue(t):
    return reports.segment_channel_revenue(t.facts)


@query("A19")
def segment_channel_pivot(t):
    return reports.segment_channel_pivot(t.facts, CHANNELS)


@query("A20")
def revenue_means(t):
    return rounded(reports.revenue_means(t.facts), "revenue_per_booking", "revenue_per_guest")


@query("A21")
def cancellation_metrics(t):
    return rounded(reports.cancellation_metrics(t.facts), "cancel_rate", "lead_time_canceled")


@query("A22")
def cancel_rate_by_column(t):
    rates = reports.cancel_rates_by_columns(t.facts, ["hotel", "customer_type", "deposit_type"])
    rows = [
        F.struct("column_name", "value", "cancel_rate"),
        F.when(F.col("column_name") == "hotel",
               F.struct(F.lit("hotel, checked flag").alias("column_name"), "value", F.col("checked_rate").alias("cancel_rate"))),
    ]
    return rounded(rates.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))), "cancel_rate")


@query("A22")
def cancel_rate_of_hotels(t):
    plain = reports.cancel_rate_by(t.facts, "hotel").withColumnRenamed("cancel_rate", "plain")
    return rounded(plain.join(reports.clean_cancel_rate_by(t.facts), "hotel"), "plain", "cancel_rate")


@query("A23 J1 T3")
def cancel_rate_top_booked(t):
    return rounded(reports.cancel_rate_top_booked(t.facts), "cancel_rate")


@query("A24 J2")
def top_cancel_rate_countries(t):
    shown = clean.fill_display_defaults(t.facts)
    return rounded(reports.top_cancel_rate_countries(shown, 100), "cancel_rate")


@query("A24 J2")
def cancel_rate_over_20_bookings(t):
    shown = clean.fill_display_defaults(t.facts)
    return rounded(reports.top_cancel_rate_countries(shown, 20), "cancel_rate")


@query("A25 T3")
def top_countries(t):
    return reports.top_countries(clean.fill_display_defaults(t.facts))


@query("A26 P18 F9 T3")
def top_named_countries(t):
    return reports.top_named_countries(clean.fill_display_defaults(t.facts), t.countries)


@query("A27 J1")
def mean_revenue_top_countries(t):
    return rounded(reports.mean_revenue_top_countries(clean.fill_display_defaults(t.facts)), "revenue")


@query("A28")
def country_summary(t):
    return rounded(reports.country_summary(clean.fill_display_defaults(t.facts)), "cancel_rate")


@query("A29")
def mean_by_column(t):
    pairs = [("customer_type", "adr"), ("customer_type", "total_of_special_requests"),
             ("customer_type", "lead_time"), ("market_segment", "revenue"), ("distribution_channel", "revenue")]
    means = reports.means_by_columns(t.facts, pairs)
    return rounded(means.select(F.concat_ws("/", "column_name", "measure").alias("report"), "value", "mean"), "mean")


@query("A30")
def avg_stay(t):
    return rounded(reports.avg_stay(t.facts), "average_nights")


@query("A31")
def room_crosstab(t):
    return reports.room_crosstab(t.facts)


@query("A32")
def booking_changes_impact(t):
    return rounded(reports.booking_changes_impact(t.facts), "cancel_fraction", "revenue")


@query("A33 J4")
def seasonal_revenue(t):
    return rounded(reports.seasonal_revenue(t.facts), "revenue")


@query("A34 T3")
def top_agents(t):
    return reports.top_agents(clean.fill_defaults(t.facts))


@query("A35")
def agent_stats(t):
    return rounded(reports.agent_stats(t.facts), "cancel_rate")


@query("A36 T3")
def top_companies(t):
    return reports.top_companies(clean.fill_defaults(t.facts))


@query("A37")
def waitlist_vs_cancel(t):
    return rounded(reports.waitlist_vs_cancel(t.facts), "cancel_fraction")


@query("A38")
def stay_vs_revenue(t):
    return rounded(reports.stay_vs_revenue(t.facts, 5), "revenue")


@query("A39 B2")
def price_sensitivity(t):
    return rounded(reports.price_sensitivity(t.facts), "adr", "cancel_rate")


@query("A40 B3 J5")
def lead_time_bins(t):
    return rounded(reports.lead_time_bins(t.facts), "revenue", "cancel_rate")


@query("X1")
def revenue_yoy(t):
    return rounded(reports.revenue_yoy(t.facts), "change_percent")


@query("X2")
def adr_by_room_season(t):
    return rounded(reports.adr_by_room_season(t.facts), "adr")


@query("X3")
def cancel_rate_by_period(t):
    return rounded(reports.cancel_rate_by_period(t.facts), "cancel_rate")


@query("X4")
def revenue_by_room(t):
    return reports.revenue_by(t.facts)


@query("X5")
def canceled_revenue_impact(t):
    return rounded(reports.canceled_revenue_impact(t.facts, "market_segment"), "canceled_percent")


@query("X6 A12")
def segment_share(t):
    return rounded(reports.segment_share(t.facts), "share")


@query("X7")
def waitlist_metrics(t):
    return rounded(reports.waitlist_metrics(t.facts), "average_wait", "cancel_rate")


@query("X8")
def occupancy_by_date(t):
    return reports.occupancy_by_date(t.facts)


# ---- statistics and model ---------------------------------------------------------


@query("B1")
def histograms(t):
    frames = {
        "lead_time": stats.histogram(t.facts, "lead_time"),
        "days_in_waiting_list": stats.histogram(t.facts, "days_in_waiting_list"),
        "adr": stats.histogram(filters.adr_open_range(t.facts), "adr"),
    }
    return rounded(union([f.withColumn("measure", F.lit(c)) for c, f in frames.items()]), "bin_start", "bin_end")


@query("B2")
def quantile_codes(t):
    return tally(stats.quantile_bins(t.facts, "adr", 10, "adr_bin"), "adr", "adr_bin")


@query("B2 C12")
def rate_quantiles(t):
    q = stats.exact_quantiles(t.facts, "adr", [0.01, 0.25, 0.5, 0.75, 0.999], ["hotel", "meal"])
    return rounded(
        q.select("hotel", "meal", "n", *[q.quantiles[i].alias(f"q{i}") for i in range(5)]), *[f"q{i}" for i in range(5)]
    )


@query("B3")
def cut_codes(t):
    literal = tally(stats.cut_bins(t.facts, "lead_time"), "lead_time", "lead_time_bin")
    lowest = tally(stats.cut_bins(t.facts, "lead_time", include_lowest=True), "lead_time", "lead_time_bin")
    return union([literal.withColumn("variant", F.lit("literal")), lowest.withColumn("variant", F.lit("lowest"))])


@query("B4 P20")
def box_statistics(t):
    lead = stats.box_stats(t.facts, "is_canceled", "lead_time").withColumnRenamed("is_canceled", "key")
    stay = stats.box_stats(features.unpivot_nights(t.facts), "stay_type", "nights").withColumnRenamed("stay_type", "key")
    return union([lead.withColumn("key", F.col("key").cast("string")), stay])


@query("B5")
def densities(t):
    frames = {"lead_time": stats.kde(t.facts, "lead_time"), "adr": stats.kde(filters.adr_open_range(t.facts), "adr")}
    both = union([f.withColumn("measure", F.lit(c)) for c, f in frames.items()])
    return rounded(both, "x", "density", places=8)


@query("B6")
def correlations(t):
    constant = features.report_frame(t.spread).withColumn("constant", F.lit(1))
    return rounded(stats.correlation_matrix(constant, [*CORRELATION_COLUMNS, "constant"]), "corr")


#: Levels of the forest's trees in both reports.
FOREST_DEPTH = 5


@query("M1")
def cancellation_importance(t):
    return ml.cancellation_feature_importance(t.facts, max_depth=FOREST_DEPTH)


@query("M2")
def guarded_importance(t):
    return ml.guarded_feature_importance(filters.dashboard_filter(t.facts, hotels=["City Hotel"]), max_depth=FOREST_DEPTH)


def _importance_facts(table: DataFrame) -> DataFrame:
    """What must hold of importances: how many, their sum, the order, and the first feature."""
    order = F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False)
    return table.agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        order[0]["feature"].alias("first"), F.min("importance").alias("least"),
    ).select("features", "total", "first", (F.col("least") >= 0).alias("none_negative"))


@query("M1 M2")
def planted_importance(t):
    planted = t.facts.withColumn("lead_time", F.when(F.col("is_canceled") == 1, F.col("lead_time") + 1000).otherwise(F.col("lead_time")))
    forest = _importance_facts(ml.cancellation_feature_importance(planted, trees=5, max_depth=FOREST_DEPTH))
    guarded = _importance_facts(ml.guarded_feature_importance(planted, trees=5, max_depth=FOREST_DEPTH).drop("reason"))
    few = ml.guarded_feature_importance(planted.limit(50)).select(F.col("reason").alias("first"))
    return union([
        forest.withColumn("report", F.lit("forest")), guarded.withColumn("report", F.lit("guarded")),
        few.select(F.lit(0).cast("long").alias("features"), F.lit(0.0).alias("total"), "first", F.lit(True).alias("none_negative"), F.lit("few").alias("report")),
    ])


# ---- text and vectors -------------------------------------------------------------


@query("R1 P9 P10 C3")
def booking_texts(t):
    return t.texts.select("doc_id", F.length("text").alias("n_chars"), F.substring("text", 500, 60).alias("tail"))


@query("C4 C1")
def display_numbers(t):
    values = t.facts.select("revenue").distinct().where(F.col("revenue").isNotNull())
    x = F.col("revenue")
    return values.select(
        "revenue",
        fn.money(x / 7).alias("money"),
        fn.plain_money(x * 1000 / 8).alias("plain"),
        fn.python_float(x * 54321).alias("large"),
        fn.python_float(x / 2097152).alias("small"),
    )


def _weights(df: DataFrame) -> DataFrame:
    """Non-zero entries of the vectors, one row each."""
    key = df.columns[0]
    entries = df.select(key, F.posexplode("embedding").alias("dim", "weight"))
    entries = entries.where(F.col("weight") != 0)
    return entries.select(key, "dim", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query("R2")
def document_vectors(t):
    return _weights(vectors.embed(t.table("documents"), spread=t.spark.sparkContext.defaultParallelism))


@query("R3")
def cached_vectors(t):
    path = scratch_path(t.spark, "vectors")
    turns = t.table("conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "role", "text"
    )
    vectors.embed_cached(turns.limit(0), path, "hash-32", make_encoder=lambda: vectors.hashing_encoder(32))
    vectors.embed_cached(turns.where(F.col("role") == "user"), path, "hash-64")
    vectors.embed_cached(turns.where(F.col("role") == "user"), path, "hash-32", make_encoder=lambda: vectors.hashing_encoder(32))
    return _weights(vectors.embed_cached(turns, path, "hash-64"))


@query("R4 J8 T4 C11")
def nearest_to_label_centres(t):
    corpus = t.table("embeddings")
    entries = corpus.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = entries.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("embedding")
    )
    return rounded(vectors.knn(centres, corpus, 5, query_id="label"), "dist2")


@query("R4 J8 T4")
def nearest_documents(t):
    spread = t.spark.sparkContext.defaultParallelism
    encoder = partial(vectors.hashing_encoder, vectors.dimension(t.table("embeddings")) or 64)
    corpus = vectors.embed(t.table("documents"), make_encoder=encoder, spread=spread).withColumnRenamed("doc_id", "vec_id")
    near = vectors.knn(t.table("embeddings"), stored(corpus, "vectors"), 3, query_id="vec_id", block=100)
    return rounded(near, "dist2")


@query("R4 J8 T4")
def nearest_embeddings(t):
    index = cells.build_cells(t.table("embeddings"))
    near = cells.search_cells(t.table("embeddings"), index, 5, query_id="vec_id").neighbours
    return rounded(near, "dist2", places=4).drop("dist2")


def _document_cells(t):
    spread = t.spark.sparkContext.defaultParallelism
    corpus = stored(vectors.embed(t.table("documents"), spread=spread).withColumnRenamed("doc_id", "vec_id"), "vectors")
    return corpus, cells.build_cells(corpus)


@query("R4 J8")
def cells_skip_pairs(t):
    corpus, index = _document_cells(t)
    found = cells.search_cells(corpus, index, 5, query_id="vec_id")
    counts = corpus.agg(F.count("*").alias("n_vectors"), (F.count("*") * F.count("*")).alias("pairs"))
    return counts.select("n_vectors", (F.lit(found.compared) < F.col("pairs")).alias("fewer"))


@query("R4 J8")
def approximate_recall(t):
    corpus, index = _document_cells(t)
    probes = max(8, len(index.centres) // 4)
    near = [
        cells.search_cells(corpus, index, 10, query_id="vec_id", probes=p).neighbours.select("query_id", "vec_id", "rank")
        for p in (None, probes)
    ]
    exact, found = near[0].withColumnRenamed("rank", "exact_rank"), near[1]
    both = exact.join(found, ["query_id", "vec_id"], "left")
    k = F.explode(F.array(*map(F.lit, (1, 5, 10)))).alias("k")
    each = both.select("*", k).where("exact_rank <= k").groupBy("k")
    each = each.agg(F.count("*").alias("n_neighbours"), F.count(F.when(F.col("rank") <= F.col("k"), 1)).alias("hits"))
    return each.select("k", "n_neighbours", (F.col("hits") >= 0.9 * F.col("n_neighbours")).alias("enough"))


@query("R5")
def vector_check(t):
    turns = t.table("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")
    sides = {
        "same": vectors.embed(turns),
        "shorter": vectors.embed(turns, make_encoder=lambda: vectors.hashing_encoder(32)),
        "none": vectors.embed(turns.where("false")),
    }
    checks = {name: vectors.validate_vectors(t.table("embeddings"), side) for name, side in sides.items()}
    return union([df.withColumn("case", F.lit(name)) for name, df in checks.items()])


@query("R2 R4 R6 R7 Q8 J7")
def prompts_for_questions(t):
    return t.prompts.select("q_id", "prompt", "answer")


@query("R4 R6 R7 Q8 J7")
def prompts_with_repeated_texts(t):
    kinds = t.spread.select(F.concat(F.lit("A "), "customer_type", F.lit(" guest at the "), "hotel", F.lit(" with meal "), "meal").alias("text"))
    texts = stored(questions.different_texts(kinds), "kinds")
    corpus = stored(vectors.embed(texts).withColumnRenamed("doc_id", "vec_id"), "vectors")
    prompts = questions.question_prompts(t.questions, corpus, texts)
    return prompts.select("q_id", "prompt", "answer")


@query("R7")
def prompts_without_context(t):
    turns = t.table("conversations")
    context = F.when(F.col("role") == "assistant", F.col("text"))
    return questions.build_prompts(turns.select("conv_id", "turn", F.col("text").alias("question"), context.alias("context"))).select(
        "conv_id", "turn", F.md5("prompt").alias("prompt"), "answer"
    )


@query("R8 C3")
def extracted_answers(t):
    turns = t.table("conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("Question: "), "role").alias("prompt"),
        F.when(F.col("turn") == 0, F.concat(F.lit("Question: "), "role", F.lit(" \n\t"), "text"))
        .when(F.col("turn") == 1, F.concat(F.lit("Answer: no. Answer:\n "), "text", F.lit(" \n")))
        .otherwise(F.concat(F.lit("Question: "), "role")).alias("generated"),
    )
    return questions.extract_answer(turns).select("conv_id", "turn", "answer")


# ---- questions --------------------------------------------------------------------


@query("Q1 C2")
def question_routes(t):
    return questions.route_questions(t.questions).drop("question")


def _answers(t, route: str) -> DataFrame:
    computed = insights.compute_insights(t.asked)
    return questions.answer_from_insights(t.questions, computed, [route]).select("q_id", "answer")


@query("Q2 J6 C4")
def revenue_answers(t):
    return _answers(t, "revenue")


@query("Q3")
def cancel_location_answers(t):
    return _answers(t, "cancel_location")


@query("Q4 T5")
def average_adr_answers(t):
    return _answers(t, "avg_adr")


@query("Q5")
def cancel_date_answers(t):
    return _answers(t, "cancel_dates")


@query("Q6 J6")
def cancellations_on_date_answers(t):
    return _answers(t, "cancel_on_date")


@query("Q7")
def top_country_answers(t):
    return _answers(t, "top_countries")


@query("Q8")
def questions_left_for_retrieval(t):
    computed = insights.compute_insights(t.asked)
    return questions.answer_from_insights(t.questions, computed, ["rag"]).select("q_id", "question", "answer")


@query("Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 S6")
def all_answers(t):
    store = scratch_path(t.spark, "insights")
    insights.build_insights(t.asked, store)
    answered = questions.answer_all(t.questions, insights.load_insights(t.spark, store), t.prompts)
    return answered.select("q_id", "route", "answer", "prompt")
