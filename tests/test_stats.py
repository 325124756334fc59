import numpy as np
import pandas as pd
import pytest
from conftest import unordered, values
from pyspark.sql import functions as F

from roomledger.operators import stats


def frame(spark, values, key=None):
    data = pd.DataFrame({"x": pd.Series(values, dtype="float64")})
    data["k"] = key if key is not None else 0
    return spark.createDataFrame(data)


SAMPLES = {
    "even": list(range(10)),
    "ties": [5.0] * 40 + [1.0, 2.0, 9.0] * 3,
    "wide": [1e-9, -1e-9, 0.0, 1e12, -1e12, 3.5, 1e300, -1e300],
    "near": [1000 + i * 1e-7 for i in range(200)],
    "random": list(np.random.default_rng(1).normal(100, 30, 1000).round(2)),
    "one": [7.0],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_quantiles_equal_numpy(spark, name):
    probs = [0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    got = stats.exact_quantiles(frame(spark, SAMPLES[name]), "x", probs).first()
    assert got.n == len(SAMPLES[name])
    assert got.quantiles == pytest.approx(list(np.quantile(SAMPLES[name], probs)), rel=1e-12)


def test_quantiles_per_key_with_one_hot_key(spark):
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 40, 6000))
    data = pd.DataFrame({"k": keys, "x": rng.exponential(50, 6000).round(1)})
    data.loc[::17, "x"] = np.nan
    got = {r.k: r.quantiles for r in stats.exact_quantiles(spark.createDataFrame(data), "x", [0.1, 0.5, 0.9], ["k"]).collect()}
    want = data.groupby("k")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    assert set(got) == set(want.index)
    for k, q in got.items():
        assert q == pytest.approx(list(want.loc[k]))


@pytest.mark.parametrize("name", ["even", "ties", "random", "near"])
def test_histogram_equals_numpy(spark, name):
    sample = np.array(SAMPLES[name], dtype=float)
    edges = np.histogram_bin_edges(sample, 50)
    want, _ = np.histogram(sample, edges)
    got = stats.histogram(frame(spark, sample), "x").orderBy("bin").collect()
    assert [r.n for r in got] == list(want) and sum(r.n for r in got) == len(sample)
    assert got[0].bin_start == pytest.approx(edges[0]) and got[-1].bin_end == pytest.approx(edges[-1])


def test_histogram_of_a_constant(spark):
    got = stats.histogram(frame(spark, [3.0, 3.0]), "x", 4).orderBy("bin").collect()
    assert (got[0].bin_start, got[-1].bin_end, sum(r.n for r in got)) == (2.5, 3.5, 2)
    assert stats.histogram(frame(spark, [np.nan]), "x").count() == 0


def test_quantile_bins_equal_pandas(spark):
    sample = SAMPLES["random"] + [None]
    got = stats.quantile_bins(frame(spark, sample), "x", 10).select("x", "bin").toPandas()
    want = pd.qcut(got["x"], 10, labels=False)
    assert got["bin"].fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_quantile_bins_with_equal_edges(spark):
    df = frame(spark, SAMPLES["ties"])
    with pytest.raises(Exception, match="not unique"):
        stats.quantile_bins(df, "x", 10).collect()
    got = stats.quantile_bins(df, "x", 10, duplicates="drop").toPandas()
    assert got["bin"].tolist() == pd.qcut(got["x"], 10, labels=False, duplicates="drop").tolist()


def test_cut_bins(rows):
    df = rows("lead_time int", (0,), (1,), (7,), (8,), (180,), (181,), (-1,), (None,))
    assert [r[1] for r in values(stats.cut_bins(df, "lead_time"))] == [
        None, "0-7 days", "0-7 days", "8-14 days", "91-180 days", "180+ days", None, None]
    assert stats.cut_bins(df, "lead_time", include_lowest=True).first().lead_time_bin == "0-7 days"


def test_box_stats(spark):
    sample = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -50]
    row = stats.box_stats(frame(spark, sample, "a"), "k", "x").first()
    q1, q2, q3 = np.quantile(sample, [0.25, 0.5, 0.75])
    assert (row.n, row.q1, row.median, row.q3) == (11, q1, q2, q3)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 9.0, 2)


def test_kde_equals_the_formula(spark):
    sample = np.array(SAMPLES["random"])
    got = stats.kde(frame(spark, sample), "x").orderBy("point").collect()
    grid = np.linspace(sample.min(), sample.max(), 200)
    h = sample.std(ddof=1) * len(sample) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - sample) / h) ** 2).sum(1) / (len(sample) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in got] == pytest.approx(list(grid)) and [r.density for r in got] == pytest.approx(list(want))
    assert stats.kde(frame(spark, [2.0, 2.0]), "x").count() == 0


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    data["c"] += data["a"]
    data["flat"] = 1.0
    data.loc[::7, "a"] = np.nan
    data.loc[::5, "c"] = np.nan
    got = stats.correlation_matrix(spark.createDataFrame(data), list(data.columns) + ["missing"]).collect()
    want = data.corr()
    assert len(got) == 16
    for r in got:
        if "flat" in (r.col_a, r.col_b):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b])


def test_nan_is_missing(rows):
    df = rows("x double", (float("nan"),), (1.0,), (None,))
    assert unordered(stats.value_counts(df, "x")) == [(1.0, 1)]
    assert df.select(F.count("x")).first()[0] == 2


def test_quantiles_of_even_values_close_together(spark):
    n = 100_000
    df = spark.range(n).selectExpr("100.0D + id * 1e-7D AS x", "id % 3 AS k")
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    got = stats.exact_quantiles(df, "x", probs).first()
    values_ = np.sort(100.0 + np.arange(n) * 1e-7)
    assert got.n == n and list(got.quantiles) == pytest.approx(list(np.quantile(values_, probs)), abs=1e-12)
    per_key = {r.k: list(r.quantiles) for r in stats.exact_quantiles(df, "x", probs, ["k"]).collect()}
    for k in range(3):
        assert per_key[k] == pytest.approx(list(np.quantile(values_[k::3], probs)), abs=1e-12)


def test_correlations_put_blocks_together(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, size=(5000, 3))
    x[:, 1] += x[:, 0]
    rows_ = [tuple(None if rng.random() < 0.1 else float(v) for v in row) for row in x]
    df = spark.createDataFrame(rows_, "a double, b double, c double").repartition(7)
    got = {(r.col_a, r.col_b): r["corr"] for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    data = np.array(rows_, dtype=float)
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            assert got[p, q] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)


def test_quantiles_of_many_values_close_together(spark):
    df = spark.range(1_000_000).selectExpr("1000 + (id * 7919 % 1000000) * 1e-9 AS x", "id % 3 AS k")
    probs = [0, 0.001, 0.25, 0.5, 0.999, 1]
    want = np.quantile(1000 + np.arange(1_000_000) * 1e-9, probs)
    assert stats.exact_quantiles(df, "x", probs).first().quantiles == pytest.approx(list(want), abs=1e-13)
    x = 1000 + (np.arange(1_000_000) * 7919 % 1_000_000) * 1e-9
    for r in stats.exact_quantiles(df, "x", probs, ["k"]).collect():
        assert r.quantiles == pytest.approx(list(np.quantile(x[r.k::3], probs)), abs=1e-13)


def test_only_values_between_brackets_are_put_in_order(spark):
    df = spark.range(300_000).selectExpr("rand(1) AS x")
    found = stats.exact_quantiles(df, "x", [0.25, 0.5, 0.75])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert found.first().n == 300_000


def test_density_sends_one_vector_a_task(spark):
    df = spark.range(50_000).selectExpr("rand(2) AS x").repartition(4)
    plan = stats.kde(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert stats.kde(df, "x", 50).count() == 50
