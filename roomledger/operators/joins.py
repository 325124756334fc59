"""Joins against small derived tables, dimensions and id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MONTHS


def semi_join_top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Rows whose ``key`` is among the ``k`` most frequent ones.

    The key set has at most ``k`` rows, so it is broadcast and the rows stay put.
    """
    top = df.where(F.col(key).isNotNull()).groupBy(key).count()
    top = top.orderBy(F.desc("count"), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def semi_join_min_count(df: DataFrame, key: str, more_than: int = 20, bucketed: bool = False) -> DataFrame:
    """Rows whose ``key`` occurs more than ``more_than`` times.

    The key set has no fixed bound, so it is not broadcast by hint; the rows of a hot
    key are split by the adaptive skew join. Rows that are stored in buckets of the key
    (``write_bucketed``) are counted and joined where they are.
    """
    often = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > more_than)
    keys = often.select(key)
    return df.join(keys.hint("merge") if bucketed else keys.repartition(key), key, "left_semi")


def lookup_dimension(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    value: str,
    output: str,
    default: str | None = None,
) -> DataFrame:
    """Left lookup in a dimension: its value, else the key itself, else ``default``."""
    keys = dim.select(F.col(dim_key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(keys, F.col(key) == F.col("_key"), "left")
    fallback = [F.col("_value"), F.col(key)] + ([F.lit(default)] if default is not None else [])
    return joined.withColumn(output, F.coalesce(*fallback)).drop("_key", "_value")


def _fixed_rows(df: DataFrame, columns: dict[str, Sequence[object]]) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, r)]) for r in zip(*columns.values())]
    one = df.sparkSession.range(1, numPartitions=1)
    return one.select(F.inline(F.array(*rows)))


def fill_months(
    agg: DataFrame, month_col: str, zero_cols: Sequence[str] = ()
) -> DataFrame:
    """All twelve months in calendar order; listed measures are 0 where missing."""
    months = _fixed_rows(agg, {"month_num": range(1, 13), month_col: MONTHS})
    filled = months.join(agg, month_col, "left")
    return filled.fillna(0, subset=list(zero_cols)) if zero_cols else filled


def fill_bins(agg: DataFrame, bin_col: str, labels: Sequence[str]) -> DataFrame:
    """All bins in order, with null measures for the empty ones."""
    bins = _fixed_rows(agg, {"bin_order": range(len(labels)), bin_col: labels})
    return bins.join(agg, bin_col, "left")


def lookup_insight(df: DataFrame, insight: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Left key lookup into an insight table, which has one row per key."""
    return df.join(insight, on if isinstance(on, Column) else list(on), "left")


def fetch_rows(neighbours: DataFrame, rows: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Rows behind neighbour ids; ids without a row are ignored.

    A row id may repeat: every row with the id is fetched, and callers that want one
    row per neighbour group by what they asked for.
    """
    return rows.join(neighbours.withColumnRenamed("vec_id", row_id), row_id)
