import pytest
from conftest import unordered, values
from pyspark.sql import functions as F

from roomledger.operators import clean, features, filters, joins
from roomledger.plans.cleaning import preprocess, question_view, stage_counts


def test_names_and_defaults(rows):
    df = clean.strip_column_names(rows("` a ` int, `country ` string", (1, None), (None, "PRT")))
    assert df.columns == ["a", "country"]
    assert unordered(clean.fill_defaults(df)) == [(1, "unknown"), (None, "PRT")]


def test_numeric_agent_becomes_text_when_filled(rows):
    df = clean.fill_defaults(rows("agent int", (9,), (None,)))
    assert dict(df.dtypes)["agent"] == "string" and unordered(df) == [("9",), ("unknown",)]


def test_median_interpolates_and_touches_only_gaps(rows):
    df = rows("x int, y double, z int, s string", (1, 1.0, 1, "a"), (2, None, 2, None), (None, 4.0, 3, "b"), (4, 9.5, 4, "c"), (9, 0.0, 5, "d"))
    out = clean.fill_numeric_median(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "double", "int", "string"]
    assert unordered(out.select("x", "y")) == [(1.0, 1.0), (2.0, 2.5), (3.0, 4.0), (4.0, 9.5), (9.0, 0.0)]


def test_median_of_nothing_keeps_nulls(rows):
    assert values(clean.fill_numeric_median(rows("x int", (None,), (None,)))) == [(None,), (None,)]


def test_all_null_rows(rows):
    df = rows("a int, b string", (None, None), (1, None), (None, "x"))
    assert unordered(clean.drop_all_null_rows(df)) == [(1, None), (None, "x")]
    assert clean.drop_all_null_rows(clean.fill_defaults(df, {"a": 0})).count() == 3


def test_null_summary(rows):
    df = rows("a int, b int, c int", (None, 1, None), (None, 1, 2), (None, 1, 2))
    assert values(clean.null_summary(df)) == [("a", 3), ("c", 1), ("b", 0)]
    assert values(clean.null_summary(df, k=None, only_missing=True)) == [("a", 3), ("c", 1)]
    assert values(clean.missing_total(df)) == [(4,)]


def test_dates_and_ints(rows):
    df = rows("d string, children double", ("2017-01-05", 1.9), ("not-a-date", 0.0), (None, 2.0))
    out = clean.to_int(clean.parse_dates(df, ["d"]))
    assert values(out.select(F.col("d").cast("string"), "children")) == [("2017-01-05", 1), (None, 0), (None, 2)]


def test_nights_and_revenue_with_gaps(rows):
    df = rows("stays_in_weekend_nights int, stays_in_week_nights int, adr string", (1, 2, "10.5"), (None, 2, "x"), (0, 0, None))
    assert values(clean.add_total_nights(df).select("total_nights")) == [(3,), (None,), (0,)]
    out = clean.add_revenue(clean.add_total_nights(df, null_safe=True), null_safe=True)
    assert values(out.select("total_nights", "revenue")) == [(3, 31.5), (2, 0.0), (0, 0.0)]


def test_absent_columns_give_zero(rows):
    df = rows("hotel string", ("a",))
    out = clean.add_revenue(clean.add_total_nights(df, null_safe=True), null_safe=True)
    assert values(out.select("total_nights", "revenue")) == [(0, 0.0)]


def test_union_and_duplicates(rows):
    a, b = rows("x int, y string", (1, None), (1, None)), rows("x int, z int", (1, None), (2, 3))
    both = clean.union_by_name(a, b)
    assert unordered(both) == [(1, None, None)] * 3 + [(2, None, 3)]
    assert unordered(clean.drop_duplicate_rows(both)) == [(1, None, None), (2, None, 3)]


RAW = (
    "hotel string, stays_in_weekend_nights int, stays_in_week_nights int, adults int, children double, babies int, "
    "country string, agent string, company string, adr double, arrival_date_year int, arrival_date_month string, "
    "arrival_date_day_of_month int, reservation_status_date string"
)


def test_preprocess_order(rows):
    base = ("City Hotel", 1, 2, 2, None, 0, None, None, None, 100.0, 2017, "July", 4, "2017-07-07")
    nameless = rows(RAW, base, (" City Hotel ", *base[1:]),  # equal after stripping
                    ("City Hotel", 0, 0, *base[3:]),  # no nights
                    ("City Hotel", 1, 0, *base[3:9], 700.0, *base[10:]),  # rate too high
                    ("City Hotel", 1, 1, *base[3:9], None, 2017, "February", 30, "bad"))
    other = rows(RAW, base, ("Resort Hotel", 1, 1, *base[3:9], None, *base[10:]), ("Resort Hotel", 1, 1, *base[3:9], 20.0, *base[10:]),
                 ("Resort Hotel", 2, 1, *base[3:9], 40.0, *base[10:]))
    out = preprocess(nameless, other)
    got = unordered(out.select("hotel", "total_nights", "adr", "revenue", "children", "country", F.col("arrival_date").cast("string")))
    # medians: 100 in the first file (three 100s and 700), 40 in the second
    assert got == sorted([
        ("City Hotel", 3, 100.0, 300.0, 0, "unknown", "2017-07-04"),
        ("City Hotel", 2, 100.0, 200.0, 0, "unknown", None),
        ("Resort Hotel", 2, 40.0, 80.0, 0, "unknown", "2017-07-04"),
        ("Resort Hotel", 2, 20.0, 40.0, 0, "unknown", "2017-07-04"),
        ("Resort Hotel", 3, 40.0, 120.0, 0, "unknown", "2017-07-04"),
    ], key=repr)
    assert unordered(stage_counts(nameless, other)) == [
        (1, "file 1", 5), (2, "file 2", 4), (3, "union", 9), (4, "deduplicated", 7),
        (5, "with nights", 6), (6, "below rate limit", 5)]


def test_question_view(rows):
    df = rows(RAW + ", meal string", ("City Hotel", 1, None, 2, None, 0, None, "9.0", "unknown", None, 2017, "July", 4, "x", None))
    row = question_view(df).first()
    assert (row.agent, row.company, row.children, row.country, row.meal) == (9, 0, 0, "Unknown", "Undefined/SC")
    assert (row.total_nights, row.revenue) == (1, 0.0)


def test_filters(rows):
    df = rows("arrival_date string, hotel string, customer_type string, adr double",
              ("2017-01-01", "a", "x", 0.0), ("2017-01-31", "b", "x", 499.5), (None, "a", "y", None), ("2017-02-01", "a", "y", 500.0))
    df = df.withColumn("arrival_date", F.col("arrival_date").cast("date"))
    assert filters.filter_date_range(df, "2017-01-01", "2017-01-31").count() == 2
    assert filters.filter_in(df, "hotel", []).count() == 4
    assert filters.filter_in(df, "hotel", ["a"]).count() == 3
    assert filters.dashboard_filter(df, "2017-01-01", "2017-02-01", ["a"], ["y"]).count() == 1
    assert filters.dashboard_filter(df, "2001-01-01", "2001-02-01").count() == 0
    assert filters.adr_below(df).count() == 2 and filters.adr_open_range(df).count() == 1


def test_unknown_country_in_any_case(rows):
    df = rows("country string", ("PRT",), ("Unknown",), ("unknown",), (None,))
    assert values(filters.known_country(df)) == [("PRT",)]


def test_semi_joins_break_ties_by_key(rows):
    df = rows("country string, x int", *[(c, i) for c in "ABC" for i in range(3)], ("D", 0), (None, 1))
    kept = joins.semi_join_top_k(df, "country", 2)
    assert {r.country for r in kept.collect()} == {"A", "B"} and kept.count() == 6
    assert joins.semi_join_min_count(df, "country", 1).count() == 9


def test_feature_columns(rows):
    df = rows("adults int, children int, babies int, revenue double", (2, None, 1, 30.0), (0, 0, None, 8.0), (None, 1, 1, 5.0))
    out = features.add_revenue_per(features.add_total_guests(df))
    assert values(out.select("total_guests", "revenue_per_guest")) == [(3, 10.0), (0, 8.0), (None, None)]
    assert features.select_available(df, ["babies", "nope", "adults"]).columns == ["babies", "adults"]
    assert features.preview(df, 2).count() == 2


@pytest.mark.parametrize("codes, names", [(["PRT", "XXA", None], ["Portugal", "XXA", "unknown"])])
def test_country_names(spark, rows, codes, names):
    from roomledger.sources import country_dimension

    df = rows("country string", *[(c,) for c in codes])
    got = {(r.country, r.country_name) for r in features.normalize_country(df, country_dimension(spark)).collect()}
    assert got == set(zip(codes, names))


def test_frequent_keys_with_a_hot_one(rows):
    data = [("H", i) for i in range(50)] + [("A", 1), ("A", 1), ("B", 1), (None, 1), (None, 2)]
    kept = joins.semi_join_min_count(rows("country string, x int", *data), "country", 1)
    assert unordered(kept) == sorted([d for d in data if d[0] in ("H", "A")], key=repr)


def test_no_job_runs_while_the_plan_is_built(rows):
    df = rows("x int, y double, s string, stays_in_weekend_nights int, stays_in_week_nights int, adr double", (1, None, "a", 1, 2, 3.0))
    tracker = df.sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    filled = clean.fill_numeric_median(df)
    counts = stage_counts(df, df)
    assert len(tracker.getJobIdsForGroup()) == before
    assert filled.count() == 1 and counts.count() == 6


def test_rows_are_packed_for_the_shuffle_and_come_back_whole(spark, rows):
    """Whole rows of columns went through the shuffle, more than twice as wide."""
    odd = ["", None, "\\N", "\\", "\t", "\\t", "\\b", "\\\t\\bt", " a\nb ", "NaN", "é\0"]
    numbers = [0.0, -0.0, float("nan"), float("inf"), None, 0.1 + 0.2, 1e-310, -1.5e300]
    given = [(a, b, i % 2 == 0, 2**62 + i % 3, x) for i, (a, b) in enumerate((a, b) for a in odd for b in odd) for x in numbers]
    df = rows("a string, `b.c` string, d boolean, e bigint, x double", *given, *given[::3], *given[::5])
    got = clean.drop_duplicate_rows(df)
    assert list(map(repr, unordered(got))) == list(map(repr, unordered(df.dropDuplicates()))) and got.dtypes == df.dtypes
    exchange = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchange and all("hashpartitioning(_line#" in line for line in exchange)
    other = rows("a string, at timestamp, l array<int>", ("x", None, [1]), ("x", None, [1]), (None, None, None))
    assert unordered(clean.drop_duplicate_rows(other)) == unordered(other.distinct())
    counted = other.groupBy(clean.packed_row(other)).count()
    assert sorted(r[1] for r in counted.collect()) == [1, 2]
