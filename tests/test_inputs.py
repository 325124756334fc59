"""The queries' inputs: how often the tables are joined, and what the joins give."""

import pytest
from conftest import unordered, values
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from query_catalog import QUERIES, inputs
from query_catalog.inputs import QUESTION_FORMS, Inputs
from roomledger.operators import ml
from roomledger.plans import cleaning, insights
from roomledger.scratch import stored
from roomledger.sources import read_bookings_tables, star


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _inputs(spark, tmp_path):
    """Tables of few rows: repeated lines and orders, null keys, lines without their order or part."""
    nation = [0, 1, None]
    frames = {
        "customer": spark.createDataFrame([(i, nation[(i or 0) % 3], "BUILDING" if i in (1, 3) else None) for i in (*range(5), 1, None)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "part": spark.createDataFrame([(i, f"TYPE {i}", i) for i in (*range(4), None)], "p_partkey bigint, p_type string, p_size int"),
        "orders": spark.range(12).selectExpr("nullif(id % 10, 7) AS o_orderkey", "nullif(id % 6, 4) AS o_custkey", "'O' AS o_orderstatus",
                                             "if(id = 3, null, timestamp_ntz'1996-01-01 00:00:00') AS o_orderdate", "'1-URGENT' AS o_orderpriority"),
        "lineitem": spark.range(60).selectExpr("id % 12 AS l_orderkey", "nullif(id % 5, 2) AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber", "cast(id AS double) AS l_quantity",
                                               "cast(id * 100 AS double) AS l_extendedprice", "if(id % 2 = 0, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus",
                                               "if(id % 9 = 0, null, timestamp_ntz'1997-03-04 00:00:00') AS l_shipdate"),
    }
    for name, df in frames.items():
        df.union(df.limit(3)).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "yes")], "conv_id int, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return Inputs(spark, str(tmp_path))


def test_question_forms_read_the_bookings_once(spark, tmp_path):
    t = _inputs(spark, tmp_path)
    for prefix, keys, parts in QUESTION_FORMS:
        made = t.question_form(prefix, keys, parts)
        assert "Join" not in _plan(made)
        text = F.concat(*[F.col(p).cast("string") if p in keys else F.lit(p) for p in parts])
        groups = t.bookings.select(*keys).dropna().distinct()
        want = groups.select(F.concat_ws("/", F.lit(prefix), *keys).alias("q_id"), text.alias("question"))
        assert unordered(made) == unordered(want)


def test_exports_are_joined_once(spark, tmp_path):
    t = _inputs(spark, tmp_path)
    for number, stored in enumerate(t.exports, 1):
        assert "Join" not in _plan(stored)
        assert stored.dtypes == t.export(number).dtypes and unordered(stored) == unordered(t.export(number))
    assert "l_orderkey" not in _plan(cleaning.stage_counts(*t.exports))


def test_customers_meet_orders_before_lines(spark, tmp_path):
    t = _inputs(spark, tmp_path)
    plan = _plan(read_bookings_tables(spark, t.directory))
    assert plan.index("(l_orderkey") < plan.index("(o_custkey")  # printed from the top
    lines, orders, customers, parts = (t.table(n) for n in ("lineitem", "orders", "customer", "part"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    assert t.bookings.count() == joined.join(parts, lines.l_partkey == parts.p_partkey).count() > 0


def test_lines_meet_parts_by_key_only(spark, tmp_path):
    t = _inputs(spark, tmp_path)
    names = ["hotel", "meal", "country", "adr", "market_segment", "reservation_status_date"]
    narrow = read_bookings_tables(spark, t.directory, columns=names)  # parts that are missing, null or repeated
    assert narrow.columns == names and unordered(narrow) == unordered(t.bookings.select(names))
    assert read_bookings_tables(spark, t.directory, columns=["hotel", "reserved_room_type"]).count() == t.bookings.count()
    lines, parts = t.table("lineitem"), t.table("part").dropDuplicates(["p_partkey"])
    rows = star._with_a_part(lines, parts)
    want = lines.join(parts, lines.l_partkey == parts.p_partkey).select(lines.columns)
    assert unordered(rows.select(lines.columns)) == unordered(want)
    assert rows.count() < lines.count() and "p_partkey" not in _plan(rows)


def test_insights_and_questions_share_one_join(spark, tmp_path, monkeypatch):
    t, read = _inputs(spark, tmp_path), []
    monkeypatch.setattr(inputs, "stored", lambda df, name: (read.append((name, "l_orderkey" in _plan(df))), stored(df, name))[1])
    monkeypatch.setattr(insights, "stored", lambda df, name: (read.append((name, "l_orderkey" in _plan(df))), stored(df, name))[1])
    made = QUERIES["revenue_answers"](spark, t.directory)
    assert made.count() > 0 and [name for name, joins in read if joins] == ["asked"]
    sums, want = insights.insight_sums(t.asked), insights.insight_sums(t.bookings)
    assert unordered(sums) == unordered(want)


def test_forest_parts_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "PART_ROWS", 50)
    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: (seen.append(df.rdd.glom().map(len).collect()), fit(self, df, *a))[1])
    df = spark.range(2000).selectExpr("cast(id % 2 AS int) AS is_canceled", "cast(id % 7 AS double) AS adr", "cast(id AS int) AS lead_time")
    table = ml.cancellation_feature_importance(df, ["adr", "lead_time"], trees=2, max_depth=2)
    assert table.count() == 2 and len(seen[0]) >= 40 and sum(seen[0]) == 2000 and max(seen[0]) <= 60


def test_forest_of_a_large_table_is_grown_in_several_fits(spark, monkeypatch):
    """One fit kept every row with its draws for all trees, and each of its passes shuffled the rows."""
    monkeypatch.setattr(ml, "PART_ROWS", 100)
    monkeypatch.setattr(ml, "DRAWS", 2000 * 4)
    seen, fit, before = [], RandomForestClassifier.fit, spark.conf.get(ml._MIN_PARTS, None)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: (seen.append((self.getNumTrees(), self.getSeed(), df.rdd.getNumPartitions(), _plan(df))), fit(self, df, *a))[1])
    df = spark.range(2000, numPartitions=4).selectExpr("cast(id % 2 AS int) AS is_canceled", "cast(id % 7 AS double) AS adr", "cast(id % 2 AS int) AS lead_time")
    table = values(ml.cancellation_feature_importance(df, ["adr", "lead_time"], trees=11, max_depth=2))
    assert [s[0] for s in seen] == [4, 4, 3] and len({s[1] for s in seen}) == 3
    assert all(s[2] >= 20 and "Exchange" not in s[3] and "Repartition" not in s[3] for s in seen)
    assert table[0][0] == "lead_time" and sum(r[1] for r in table) == pytest.approx(1)
    assert spark.conf.get(ml._MIN_PARTS, None) == before
    assert ml._fits(100, 10**12) == [2] * 50 and ml._fits(1, 10**12) == [1] and ml._fits(5, 10) == [5]
