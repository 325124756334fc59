import pytest
from conftest import unordered, values
from pyspark.sql import functions as F

from roomledger.operators import reports
from roomledger.plans import insights


@pytest.fixture
def bookings(rows):
    df = rows(
        "hotel string, country string, is_canceled int, adr double, total_nights int, revenue double, lead_time int, "
        "arrival string, arrival_date_month string, arrival_date_year int, stays_in_weekend_nights int, "
        "stays_in_week_nights int, status string, days_in_waiting_list int",
        ("A", "PRT", 1, 10.0, 2, 20.0, 0, "2016-01-10", "January", 2016, 1, 1, "2016-01-01", 0),
        ("A", "PRT", 0, 20.0, 1, 20.0, 7, "2016-02-29", "February", 2016, 0, 1, "2016-01-02", 3),
        ("B", None, 1, None, 3, None, 8, "2017-01-01", "January", 2017, 2, 1, "2016-01-01", 0),
        ("B", "ESP", 0, 40.0, 2, 80.0, 500, "2017-01-31", "January", 2017, 1, 1, None, 5),
        (None, "ESP", 0, 30.0, 1, 30.0, 14, "2018-01-01", "Smarch", 2018, 0, 1, None, 0),
    )
    return df.withColumns({"arrival_date": F.col("arrival").cast("date"), "reservation_status_date": F.col("status").cast("date")})


def test_null_keys_drop_in_reports_and_stay_in_insights(bookings):
    assert unordered(reports.bookings_by(bookings, "country")) == [("ESP", 2), ("PRT", 2)]
    assert unordered(insights.top_booking_countries(bookings)) == [("ESP", 2), ("PRT", 2), (None, 1)]
    assert unordered(reports.count_by(bookings, "hotel", null_keys="keep")) == [("A", 2), ("B", 2), (None, 1)]


def test_sum_of_nothing_is_zero_in_reports_and_null_in_insights(bookings):
    only = bookings.where("country IS NULL")
    assert values(reports.sum_by(only, "hotel")) == [("B", 0.0)]
    assert values(insights.revenue_insights(only)) == [("January", 2017, None)]


def test_revenue_insights_put_unknown_months_first(bookings, rows):
    early = bookings.withColumn("arrival_date_year", F.lit(2016))
    assert [r.month for r in insights.revenue_insights(early).collect()] == ["Smarch", "January", "February"]


def test_ties_go_to_the_smaller_key(bookings):
    assert values(reports.top_countries(bookings, 1)) == [("ESP", 2)]
    assert values(insights.cancellation_by_date(bookings, 1).select(F.col("date").cast("string"), "count")) == [("2016-01-01", 2)]


def test_twelve_months(bookings):
    months = values(reports.bookings_per_month_name(bookings))
    assert len(months) == 12 and months[0] == ("January", 1, 3) and months[2] == ("March", 3, 0)
    seasonal = reports.seasonal_revenue(bookings).collect()
    assert [r.month_num for r in seasonal] == list(range(1, 13))
    assert seasonal[0].revenue == pytest.approx(130 / 3) and seasonal[5].revenue is None


def test_periods(bookings):
    got = {(r.level, r.period): r.revenue for r in reports.revenue_by_period(bookings).collect()}
    assert got[("monthly", "2017-01")] == 80.0 and got[("quarterly", "2016Q1")] == 40.0 and got[("yearly", "2018")] == 30.0
    assert unordered(reports.revenue_by_period(bookings, "yearly").select("period", "revenue")) == [
        ("2016", 40.0), ("2017", 80.0), ("2018", 30.0)]


def test_year_over_year(bookings):
    got = {(r.level, r.year, r.month_num): r for r in reports.revenue_yoy(bookings).collect()}
    assert got[("month", 2017, 1)].previous == 20.0 and got[("month", 2017, 1)].change_percent == 300.0
    assert got[("year", 2016, None)].previous is None and got[("year", 2018, None)].change == -50.0
    assert got[("month", 2016, 2)].previous is None


def test_lead_time_bins_leave_out_zero_and_list_empty_bins(bookings):
    bins = reports.lead_time_bins(bookings).collect()
    assert [r.bin_order for r in bins] == list(range(7))
    assert bins[0].revenue == 20.0 and bins[1].revenue == 30.0 and bins[6].revenue == 80.0 and bins[3].revenue is None
    assert reports.lead_time_bins(bookings, include_lowest=True).collect()[0].cancel_rate == 50.0


def test_rates(bookings):
    assert unordered(reports.cancel_rate_by(bookings, "hotel")) == [("A", 50.0), ("B", 50.0)]
    assert values(reports.top_cancel_rate_countries(bookings, 1)) == [("PRT", 2, 50.0), ("ESP", 2, 0.0)]
    assert values(reports.top_cancel_rate_countries(bookings, 2)) == []
    row = reports.cancellation_metrics(bookings).first()
    assert (row.cancel_rate, row.cancellations, row.lead_time_canceled) == (40.0, 2, 4.0)
    assert unordered(reports.waitlist_metrics(bookings)) == [(False, 3, 0.0, pytest.approx(200 / 3)), (True, 2, 4.0, 0.0)]


def test_shares_add_up(bookings):
    assert sum(r.share for r in reports.status_share(bookings, "country").collect()) == pytest.approx(100)


def test_occupancy_counts_nights_of_kept_stays(bookings):
    got = unordered(reports.occupancy_by_date(bookings).select(F.col("date").cast("string"), "rooms_in_use"))
    assert got == [("2016-02-29", 1), ("2017-01-31", 1), ("2017-02-01", 1), ("2018-01-01", 1)]


def test_occupancy_ignores_stays_without_nights(bookings):
    none = bookings.withColumn("total_nights", F.lit(0))
    assert reports.occupancy_by_date(none).count() == 0


def test_pivot_without_given_columns(rows):
    df = rows("reserved_room_type string, assigned_room_type string", ("A", "A"), ("A", "B"), ("B", "B"), ("B", None))
    wide = reports.room_crosstab(df)
    assert wide.columns == ["reserved_room_type", "A", "B"] and unordered(wide) == [("A", 1, 1), ("B", 0, 1)]


def test_insights_are_stored_once(bookings, tmp_path, spark):
    store = str(tmp_path / "store")
    assert len(insights.build_insights(bookings, store)) == 6
    assert insights.build_insights(bookings, store) == []
    assert len(insights.build_insights(bookings.limit(0), store, force=True)) == 6
    assert insights.load_insights(spark, store)["top_booking_countries"].count() == 0


def test_analytics_json(bookings):
    import json

    report = json.loads(insights.analytics_json(insights.compute_insights(bookings)).first().report)
    assert list(report) == ["revenue_trends", "top_cancellation_locations", "average_adr", "top_booking_countries", "top_cancellation_dates"]
    assert report["average_adr"] == "25.00" and report["revenue_trends"][0] == {"month": "January", "year": 2016, "revenue": "20.00"}
    assert report["top_cancellation_dates"] == [{"date": "2016-01-01", "count": 2}]


def test_analytics_without_rows(bookings):
    report = insights.analytics_report(insights.compute_insights(bookings.limit(0)))
    assert values(report) == [("average_adr", 1, None, "N/A")]


def test_pivots_lose_no_rows(rows):
    df = rows("reserved_room_type string, assigned_room_type string, market_segment string, distribution_channel string, revenue double",
              ("A", "A", "s", "x", 1.0), ("A", "NEW", "s", "odd", 2.0), ("B", "C", "s", "y", 4.0), ("B", "C", "t", "odd", 8.0))
    found = reports.room_crosstab(df)
    assert found.columns == ["reserved_room_type", "A", "C", "NEW"]
    assert sorted(values(found)) == [("A", 1, 0, 1), ("B", 0, 2, 0)]
    assert sorted(values(reports.room_crosstab(df, ["A"]))) == [("A", 1, 1), ("B", 0, 2)]
    wide = reports.segment_channel_pivot(df, ["x", "y"])
    assert wide.columns == ["market_segment", "x", "y", "other"] and sorted(values(wide)) == [("s", 1.0, 4.0, 2.0), ("t", None, None, 8.0)]
    with pytest.raises(ValueError, match="more than 1"):
        reports.room_crosstab(df, limit=1)
