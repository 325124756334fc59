import datetime as dt

from conftest import unordered, values
from pyspark.sql import functions as F

from roomledger.operators import ml
from roomledger.scratch import scratch_path, shared_folder
from roomledger.sources import (
    insight_exists, read_bookings_csv, read_country_map, read_insight, write_bookings, write_insight,
)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        "hotel,is_canceled, lead_time ,children,agent,adr,reservation_status_date,note\n"
        '"Inn, the ""old""",1,3,2.0,9,75.5,2015-07-01,x\nB,0,x,NA,NULL,nan,07/01,\n')
    df = read_bookings_csv(spark, str(tmp_path / "b.csv"))
    assert df.columns[2] == " lead_time " and dict(df.dtypes)[" lead_time "] == "int"
    assert values(df) == [('Inn, the "old"', 1, 3, 2, "9", 75.5, dt.date(2015, 7, 1), "x"), ("B", 0, None, None, None, None, None, None)]


def test_csv_round_trip(spark, rows, tmp_path):
    df = rows("hotel string, adr double, country string", ('a "b", c', 1.5, None), ("x\\y", None, "PRT"))
    write_bookings(df, str(tmp_path / "out"), format="csv")
    assert unordered(read_bookings_csv(spark, str(tmp_path / "out"))) == unordered(df)


def test_hot_date_is_cut_into_several_files(spark, tmp_path):
    df = spark.range(20000).selectExpr("id", "if(id % 3 = 0, 0, id) AS day")
    write_bookings(df, str(tmp_path / "out"), cluster_by="day", partitions=8)
    sizes = spark.read.parquet(str(tmp_path / "out")).selectExpr("input_file_name() AS f", "day").where("day = 0").groupBy("f").count()
    assert sizes.count() > 1


def test_interleaved_layout_skips_files_for_filters_on_any_column(spark, tmp_path):
    df = spark.range(40_000).selectExpr(
        "date_add(DATE'2016-01-01', int(id * 7919 % 700)) AS arrival_date", "if(id * 31 % 97 < 40, 'City Hotel', 'Resort Hotel') AS hotel",
        "element_at(array('Transient', 'Group', 'Contract', NULL), int(id * 17 % 1009 % 4) + 1) AS customer_type", "id",
    )
    wanted = "arrival_date BETWEEN DATE'2016-03-01' AND DATE'2016-03-31' AND hotel = 'City Hotel' AND customer_type = 'Group'"

    def files_met(name, columns):
        path = str(tmp_path / name)
        write_bookings(df, path, cluster_by=columns, partitions=32)
        rows = spark.read.parquet(path)
        assert unordered(rows.where(wanted)) == unordered(df.where(wanted)) and rows.count() == 40_000
        ends = "min({0}) AS lo_{0}, max({0}) AS hi_{0}".format
        by_file = rows.groupBy(F.input_file_name()).agg(*[F.expr(e) for c in ("arrival_date", "hotel", "customer_type") for e in ends(c).split(", ")])
        met = "lo_arrival_date <= DATE'2016-03-31' AND hi_arrival_date >= DATE'2016-03-01' AND lo_hotel <= 'City Hotel' AND hi_hotel >= 'City Hotel'"
        by_type = "lo_customer_type <= 'Group' AND hi_customer_type >= 'Group'"
        return by_file.where(f"{met} AND {by_type}").count(), by_file.where(by_type).count()

    several, several_by_type = files_met("several", ["arrival_date", "hotel", "customer_type"])
    _, one_by_type = files_met("one", "arrival_date")
    assert 0 < several <= 6 and several_by_type < 0.8 * one_by_type


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from roomledger.operators.joins import semi_join_min_count
    from roomledger.sources.bookings import write_bucketed

    lines = spark.range(5000).selectExpr("id * 7 % 900 AS l_orderkey", "id AS line")
    orders = spark.range(900).selectExpr("id AS o_orderkey", "if(id % 3 = 0, 'PRT', concat('C', id % 200)) AS country")
    bookings = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tables = {"bucketed_lines": (lines, "l_orderkey"), "bucketed_orders": (orders, "o_orderkey"), "bucketed_bookings": (bookings, "country")}
    try:
        for name, (df, key) in tables.items():
            write_bucketed(df, name, key, 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = {name: spark.table(name) for name in tables}
        joined = stored["bucketed_lines"].join(stored["bucketed_orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        often = semi_join_min_count(stored["bucketed_bookings"], "country", 30, bucketed=True)
        for df in (joined, often):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert unordered(joined) == unordered(bookings)
        assert unordered(often) == unordered(semi_join_min_count(bookings, "country", 30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_country_map_file(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"PRT":\n "Portugal"}')
    bad.write_text("{oops")
    assert values(read_country_map(spark, str(good))) == [("PRT", "Portugal")]
    assert values(read_country_map(spark, str(bad))) == []
    assert values(read_country_map(spark, str(tmp_path / "none.json"))) == []


def test_insight_store(spark, rows, tmp_path):
    store = str(tmp_path)
    assert not insight_exists(spark, store, "average_adr_insight")
    write_insight(rows("average_adr double", (1.0,)), store, "average_adr_insight")
    write_insight(rows("average_adr double", (2.0,)), store, "average_adr_insight")
    assert insight_exists(spark, store, "average_adr_insight")
    assert values(read_insight(spark, store, "average_adr_insight", first=True)) == [(2.0,)]


def test_shared_folder_follows_the_setting(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a") and scratch_path(spark, "a").startswith(folder)


def test_feature_importance(spark, rows):
    cols = list(ml.CANCELLATION_FEATURES)
    data = [tuple(float((i * p) % 11) for p in range(1, 9)) + (i % 2,) for i in range(200)]
    df = spark.createDataFrame([(float(r[-1]),) + r[1:] for r in data], cols + ["is_canceled"])
    got = ml.cancellation_feature_importance(df, trees=5).collect()
    assert len(got) == 8 and abs(sum(r.importance for r in got) - 1) < 1e-9
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True) and got[0].feature == cols[0]


def test_importance_refusals(spark, rows):
    assert ml.guarded_feature_importance(rows("adr double", (1.0,))).first().reason == "required columns are not available"
    small = rows("adr double, is_canceled int", *[(1.0, 0)] * 50)
    assert ml.guarded_feature_importance(small).first().reason == "not enough rows"
    none = rows("adr double, is_canceled int", (None, 0))
    assert ml.guarded_feature_importance(none).first().reason == "no complete rows"


def test_csv_files_with_different_headers_meet_by_name(spark, tmp_path):
    import gzip

    folder = tmp_path / "exports of all"
    folder.mkdir()
    (folder / "a.csv").write_text("hotel,lead_time\nCity Hotel,5\n")
    (folder / "b.csv").write_text('lead_time,"hotel",note\n7,"Resort, Hotel",x\n8,Inn,\n')
    (folder / "c.csv").write_text("hotel,lead_time\nNA,6\n")
    (folder / "d.csv.gz").write_bytes(gzip.compress(b"note,hotel\ny,Z\n"))
    (folder / "empty.csv").write_text("")
    got = read_bookings_csv(spark, str(folder))
    assert dict(got.dtypes)["lead_time"] == "int"
    one_by_one = [read_bookings_csv(spark, str(folder / name)) for name in ("a.csv", "b.csv", "c.csv", "d.csv.gz")]
    want = one_by_one[0]
    for frame in one_by_one[1:]:
        want = want.unionByName(frame, allowMissingColumns=True)
    assert unordered(got.select(*want.columns)) == unordered(want) and got.count() == 5


def test_a_failing_write_leaves_the_insight_readable(spark, rows, tmp_path):
    import pytest

    store = str(tmp_path)
    write_insight(rows("average_adr double", (1.0,)), store, "average_adr_insight")
    held = read_insight(spark, store, "average_adr_insight")
    broken = rows("average_adr double", (3.0,)).withColumn("average_adr", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        write_insight(broken, store, "average_adr_insight")
    assert values(read_insight(spark, store, "average_adr_insight")) == [(1.0,)]
    write_insight(rows("average_adr double", (2.0,)), store, "average_adr_insight")
    assert values(held) == [(1.0,)] and values(read_insight(spark, store, "average_adr_insight")) == [(2.0,)]
    write_insight(rows("average_adr double", (4.0,)), store, "average_adr_insight")
    assert values(read_insight(spark, store, "average_adr_insight")) == [(4.0,)]
    done = [p for p in (tmp_path / "average_adr_insight").iterdir() if (p / "_SUCCESS").exists()]
    assert len(done) == 2


def test_scratch_tables_are_removed(spark, rows):
    from roomledger.scratch import remove_scratch, stored

    df = stored(rows("a int", (1,)), "t")
    assert df.count() == 1
    assert remove_scratch(spark) >= 1 and remove_scratch(spark) == 0
