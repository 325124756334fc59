"""Every registered query against its SQL, and some plans."""

import contextlib
import io

import numpy as np
import pytest
from check_queries import bag, connect

from __spark_entry__ import entry, oracle_sql, queries
from query_catalog import ORACLES as SQL
from query_catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).columns == ["month", "year", "revenue"]


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"cancellation_importance", "guarded_importance"}
    assert set(SQL) <= set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.collect(), df.columns) == bag(result.fetchall(), columns)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from roomledger.operators.filters import dashboard_filter
    from roomledger.operators.reports import cancel_rate_by
    from roomledger.schema import booking_schema
    from roomledger.sources import read_bookings, write_bookings

    path = str(tmp_path / "b")
    write_bookings(spark.createDataFrame([], booking_schema()), path)
    df = dashboard_filter(read_bookings(spark, path), "2016-01-01", "2016-12-31", ["City Hotel"])
    text = plan(cancel_rate_by(df, "customer_type"))
    assert "GreaterThanOrEqual(arrival_date,2016-01-01)" in text and "EqualTo(hotel,City Hotel)" in text
    assert "ReadSchema: struct<hotel:string,is_canceled:int,customer_type:string,arrival_date:date>" in text


def test_no_cross_joins(spark):
    for name in ("revenue_insights", "price_sensitivity", "densities", "histograms", "all_answers", "nearest_to_label_centres"):
        text = plan(queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def scans_of(df, table):
    """How often the executed plan reads a table."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    return sum("FileScan parquet" in line and f"{table}.parquet" in line for line in final.splitlines())


def test_reports_and_insights_read_the_bookings_once(spark):
    from roomledger.plans import insights
    from roomledger.sources import read_bookings_tables

    for name in ("bookings_by_column", "cancel_rate_by_column", "mean_by_column"):
        assert scans_of(QUERIES[name](spark, SF), "lineitem") == 1, name
    assert scans_of(insights.insight_sums(read_bookings_tables(spark, SF)), "lineitem") == 1
    assert scans_of(QUERIES["analytics_report"](spark, SF), "lineitem") == 0  # only the stored sums
    assert scans_of(QUERIES["frequent_arrival_rows"](spark, SF), "lineitem") <= 2


@pytest.mark.parametrize("n", [20, 150])
def test_nearest_documents_of_vectors_of_any_width(spark, tmp_path, n):
    """Documents were embedded in 64 components whatever the table of vectors has, and the search failed."""
    from roomledger.operators.vectors import hashing_encoder

    texts = [None, ""] + [" ".join(f"w{i * j % 23}" for j in range(i % 7)) for i in range(300)]
    given = np.random.default_rng(2).normal(size=(n, 24)).astype(np.float32)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(given)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r)[:3] for r in QUERIES["nearest_documents"](spark, str(tmp_path)).collect())
    corpus = hashing_encoder(24)(texts).astype(float)
    want = []
    for i, v in enumerate(given.astype(float)):
        near = sorted(zip(np.round(((corpus - v) ** 2).sum(1), 9), range(len(corpus))))[:3]
        want += [(i, rank, doc) for rank, (_, doc) in enumerate(near, 1)]
    assert got == want
