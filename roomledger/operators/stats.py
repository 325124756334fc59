"""Distribution statistics.

Quantiles are selected by rank between values of a sketch. Histograms, densities and
correlations are sums over the rows, added up per task. No whole column, and no hot
group, ever meets in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_number, ratio
from ..schema import LEAD_TIME_EDGES, LEAD_TIME_LABELS

# Ship the functions of this module inside the tasks, so that executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, value, n)``: how often each non-null value occurs per key."""
    rows = df.select(*keys, clean_number(F.col(col)).alias("value"))
    for name in (*keys, "value"):
        rows = rows.where(F.col(name).isNotNull())
    return rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))


#: Size of a quantile sketch over all rows, and of one for each key.
SKETCH, KEY_SKETCH = 65_535, 4096


def _pad(k: int) -> float:
    """Four times the rank error, as a share of the rows, that a sketch of size ``k`` keeps to in 99 of 100 cases."""
    return 4 * 2.296 / k**0.9021


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles: ``(keys, n, quantiles array<double>)``.

    Selection by rank in two scans. The first builds a mergeable quantile sketch per key,
    whose error is known; two of its values bracket every wanted rank. The second counts
    the rows between brackets and keeps the values inside them, counted per value, so only
    these, 0.2 % of the rows a probability without keys and 2 % with keys, are put in
    order. Counts are exact, so quantiles are. A bracket that misses its rank, which its
    width all but rules out, fails the job instead of giving a wrong value.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    size = KEY_SKETCH if keys else SKETCH
    rows = df.select(*keys, clean_number(F.col(col)).cast("double").alias("value"))
    for name in (*keys, "value"):
        rows = rows.where(F.col(name).isNotNull())
    ends = [F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")]
    sketch = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("value", size).alias("s"), *ends)

    pad = _pad(size)

    def at(rank: float) -> Column:
        if rank <= 0:
            return F.col("lo")
        if rank >= 1:
            return F.col("hi")
        return F.kll_sketch_get_quantile_double("s", F.lit(rank))

    def bracket(p: float) -> Column:
        # one pad for the sketch's error and one for whole ranks; of few rows, all are put in order
        few = F.col("n") * pad < 2
        low, high = at(p - 2 * pad), at(p + 2 * pad)
        if p in (0.0, 1.0):
            low = high = at(p)
            few = F.lit(False)
        return F.struct(F.when(few, F.col("lo")).otherwise(low).alias("low"), F.when(few, F.col("hi")).otherwise(high).alias("high"))

    brackets = F.array(*map(bracket, sorted(probs))).alias("brackets")
    if keys:
        counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("n")).join(sketch.select(*keys, brackets), keys)
    else:
        counted = rows.select("value", F.lit(1).alias("n"), sketch.select(F.struct(brackets)).scalar().alias("_")).select("value", "n", "_.brackets")
    # the bracket that holds the value, or the next one above it
    place = F.size(F.filter("brackets", lambda b: b["high"] < F.col("value")))
    inside = F.col("value") >= F.get("brackets", F.col("place"))["low"]
    counted = counted.withColumn("place", place).select(*keys, "place", F.when(inside, F.col("value")).alias("value"), "n")
    counted = counted.groupBy(*keys, "place", "value").agg(F.sum("n").alias("n"))

    wanted = "array({})".format(", ".join(f"{p!r}D" for p in probs))
    needed = f"""array_distinct(flatten(transform({wanted}, p -> array(
        cast(floor((total - 1) * p) AS bigint), cast(ceil((total - 1) * p) AS bigint)))))"""
    per_key = Window.partitionBy(*keys)
    # rows that lie before a bracket have no value and come first
    ranked = counted.withColumns({"upto": F.sum("n").over(per_key.orderBy("place", "value")), "total": F.sum("n").over(per_key)})
    known = F.coalesce("value", F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    hits = ranked.select(*keys, "total", "value", F.expr(f"filter({needed}, r -> r >= upto - n AND r < upto) AS ranks")).where("size(ranks) > 0")
    hits = hits.select(*keys, "total", known.alias("value"), F.explode("ranks").alias("rank"))
    # at most 2 * len(probs) entries per key
    found = hits.groupBy(*keys).agg(
        F.first("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"),
    )
    low, high = "at[cast(floor((total - 1) * p) AS bigint)]", "at[cast(ceil((total - 1) * p) AS bigint)]"
    part = "((total - 1) * p - floor((total - 1) * p))"
    quantiles = F.expr(f"transform({wanted}, p -> {low} + ({high} - {low}) * {part}) AS quantiles")
    return found.select(*keys, F.col("total").alias("n"), quantiles)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]: ``(bin, bin_start, bin_end, n)``.

    All bins are listed, the last one includes its end, and a constant column
    gets the range half a unit to either side. Rows are counted by bin, so a task
    sends at most one row per bin to the shuffle.
    """
    values = df.select(clean_number(F.col(col)).alias("value")).where(F.col("value").isNotNull())
    low, high = F.min("value"), F.max("value")
    same = low == high
    span = values.agg(
        F.struct(
            F.when(same, low - 0.5).otherwise(low).alias("lo"),
            F.when(same, high + 0.5).otherwise(high).alias("hi"),
        )
    ).scalar()
    lo, width = F.col("span.lo"), (F.col("span.hi") - F.col("span.lo")) / bins

    value = F.col("value")
    guess = F.floor((value - lo) / width)
    settled = (
        F.when(value < lo + guess * width, guess - 1)
        .when(value >= lo + (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    index = F.greatest(F.least(settled, F.lit(bins - 1)), F.lit(0)).cast("int")
    filled = values.withColumn("span", span).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))

    axis = df.sparkSession.range(bins, numPartitions=1)
    axis = axis.select(F.col("id").cast("int").alias("bin"), span.alias("span"))
    axis = axis.where(lo.isNotNull()).select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end")
    )
    return axis.join(F.broadcast(filled), "bin", "left").fillna(0, subset=["n"])


def quantile_bins(
    df: DataFrame, col: str, q: int = 10, output: str = "bin", duplicates: str = "raise"
) -> DataFrame:
    """Add the code 0..q-1 of the quantile interval that holds the value.

    Intervals are right-closed and the lowest value belongs to the first. Equal
    edges are an error unless ``duplicates='drop'``.
    """
    probs = [i / q for i in range(q + 1)]
    edges = F.col("quantiles")
    if duplicates == "drop":
        edges = F.array_distinct(edges)
    else:
        edges = F.when(F.size(F.array_distinct(edges)) == q + 1, edges).otherwise(
            F.raise_error(F.lit(f"quantile edges of {col} are not unique")).cast("array<double>")
        )
    edges = exact_quantiles(df, col, probs).select(edges).scalar()
    above = " + ".join(f"coalesce(cast(get(_edges, {i}) < _value AS int), 0)" for i in range(q + 1))
    code = F.expr(f"CASE WHEN _value IS NOT NULL THEN greatest({above} - 1, 0) END")
    marked = df.withColumns({"_edges": edges, "_value": clean_number(F.col(col))})
    return marked.withColumn(output, code).drop("_edges", "_value")


def cut_bins(
    df: DataFrame,
    col: str,
    edges: Sequence[float] = LEAD_TIME_EDGES,
    labels: Sequence[str] = LEAD_TIME_LABELS,
    output: str = "lead_time_bin",
    include_lowest: bool = False,
) -> DataFrame:
    """Add the label of the interval (a, b] that holds the value; the last is open.

    A value equal to the lowest edge has no bin unless ``include_lowest``.
    """
    value = F.col(col)
    label = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        above = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        inside = above & (value <= edges[i + 1]) if i + 1 < len(edges) else above
        label = F.when(inside, F.lit(labels[i])).otherwise(label)
    return df.withColumn(output, label)


def box_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and number of outliers per key."""
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75], [key]).select(
        key, *[F.col("quantiles")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("value")
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    return (
        value_counts(df, col, [key])
        .join(quartiles, key)
        .groupBy(key)
        .agg(
            F.sum("n").alias("n"),
            F.min("q1").alias("q1"),
            F.min("median").alias("median"),
            F.min("q3").alias("q3"),
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def _grid_sums(batches: Iterator[pa.RecordBatch], grid: int) -> Iterator[pa.RecordBatch]:
    """point and weight: the task's rows (value, lo, hi, width) summed up at every point of the grid."""
    total = np.zeros(grid)
    for batch in batches:
        if not batch.num_rows:
            continue
        value, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
        lo, hi, width = (batch.column(i)[0].as_py() for i in (1, 2, 3))
        x = lo + np.arange(grid) * (hi - lo) / (grid - 1)
        for at in range(0, len(value), 4096):
            z = (x[:, None] - value[None, at : at + 4096]) / width
            total += np.exp(-0.5 * z * z) @ n[at : at + 4096]
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid, dtype=np.int32)), pa.array(total)], ["point", "weight"])


def kde(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density on an even grid over [min, max]: ``(point, x, density)``.

    The bandwidth is the sample deviation times ``n ** -0.2``. Each task adds its rows up
    to one vector over the grid and sends that alone; a column without spread gives no
    rows.
    """
    values = df.select(clean_number(F.col(col)).cast("double").alias("value")).where(F.col("value").isNotNull())
    stats = values.agg(
        F.struct(
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").cast("double").alias("n"), F.var_samp("value").alias("variance")
        )
    ).scalar()
    width = F.sqrt("stats.variance") * F.pow(F.col("stats.n"), F.lit(-0.2))
    rows = values.withColumn("stats", stats).where("stats.variance > 0").select("value", "stats.lo", "stats.hi", width.alias("width"))
    sums = rows.mapInArrow(partial(_grid_sums, grid=grid), "point int, weight double").groupBy("point").agg(F.sum("weight").alias("weight"))
    sums = sums.withColumn("stats", stats)
    x = F.col("stats.lo") + F.col("point") * (F.col("stats.hi") - F.col("stats.lo")) / (grid - 1)
    scale = F.col("stats.n") * width * F.sqrt(F.lit(2.0) * F.pi())
    return sums.select("point", x.alias("x"), (F.col("weight") / scale).alias("density"))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and pair of columns: rows with both, means, and centred sums."""
    parts, n_cols = [], 0
    for batch in batches:
        n_cols = batch.num_columns
        parts.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        if sum(map(len, parts)) >= 100_000:
            yield _sums_of(np.concatenate(parts))
            parts = []
    if n_cols and sum(map(len, parts)):
        yield _sums_of(np.concatenate(parts))


def _sums_of(x: np.ndarray) -> pa.RecordBatch:
    known = ~np.isnan(x)
    middle = np.array([c[k].mean() if k.any() else 0.0 for c, k in zip(x.T, known.T)])
    x, m = np.where(known, x - middle, 0.0), known.astype(float)
    n, sums, squares, products = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
    a, b = np.nonzero((n > 0) & (np.arange(len(n))[:, None] <= np.arange(len(n))))
    n, sa, sb = n[a, b], sums[a, b], sums[b, a]
    columns = {
        "a": a, "b": b, "n": n, "mean_a": middle[a] + sa / n, "mean_b": middle[b] + sb / n,
        "aa": squares[a, b] - sa * sa / n, "bb": squares[b, a] - sb * sb / n, "ab": products[a, b] - sa * sb / n,
    }
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair: ``(col_a, col_b, corr)``.

    Each pair uses the rows where both values are known; a constant column gives
    null. One pass: tasks take products of column blocks, centred on the block's
    means, and send one row per pair and block; blocks are then put together.
    """
    cols = [c for c in cols if c in df.columns]
    numbers = df.select(*[clean_number(F.col(c)).cast("double").alias(c) for c in cols])
    schema = "a long, b long, n double, mean_a double, mean_b double, aa double, bb double, ab double"
    parts = numbers.mapInArrow(_pair_sums, schema)
    pair = Window.partitionBy("a", "b")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair)
    off_a, off_b = F.col("mean_a") - mean("mean_a"), F.col("mean_b") - mean("mean_b")
    parts = parts.withColumns({"off_a": off_a, "off_b": off_b})
    whole = lambda c, x, y: F.sum(F.col(c) + F.col("n") * F.col(x) * F.col(y))
    deviations = F.sqrt(whole("aa", "off_a", "off_a")) * F.sqrt(whole("bb", "off_b", "off_b"))
    found = parts.groupBy("a", "b").agg(ratio(whole("ab", "off_a", "off_b"), deviations).alias("corr"))
    both_ways = ", ".join(
        f"struct({i}L AS a, {j}L AS b, '{x}' AS col_a, '{y}' AS col_b)"
        for i, p in enumerate(cols)
        for j, q in list(enumerate(cols))[i:]
        for x, y in sorted({(p, q), (q, p)})
    )
    names = df.sparkSession.range(1, numPartitions=1).selectExpr(f"inline(array({both_ways}))")
    return names.join(found, ["a", "b"], "left").select("col_a", "col_b", "corr")
