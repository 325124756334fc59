"""Merge and clean raw booking exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.filters import adr_below, positive_nights


def clean_file(df: DataFrame) -> DataFrame:
    """Clean one export on its own: names, text, defaults, medians, empty rows."""
    df = clean.strip_strings(clean.strip_column_names(df))
    df = clean.fill_numeric_median(clean.fill_defaults(df))
    return clean.drop_all_null_rows(df)


def merge_files(*frames: DataFrame) -> DataFrame:
    """Clean each export, put them together and drop repeated rows."""
    return clean.drop_duplicate_rows(clean.union_by_name(*map(clean_file, frames)))


def preprocess(*frames: DataFrame, max_adr: float = 500) -> DataFrame:
    """From raw exports to the booking table the reports read.

    Stays without nights and high rates are dropped before the exports meet:
    equal rows pass or fail together, so the result is the same as filtering
    last, and the rows that go never reach the shuffle.
    """
    kept = [adr_below(positive_nights(clean.add_total_nights(clean_file(df))), max_adr) for df in frames]
    df = clean.drop_duplicate_rows(clean.union_by_name(*kept))
    df = clean.parse_dates(clean.to_int(df))
    return clean.add_revenue(clean.add_arrival_date(clean.add_month_number(df)))


class _Stages:
    """Rows after each stage, observed while they pass; the stages stand in the order in which they are counted."""

    def __init__(self, frames: Sequence[DataFrame], max_adr: float):
        self.spark, self.seen = frames[0].sparkSession, []
        cleaned = [self._counted(clean_file(df), f"file {i}") for i, df in enumerate(frames, 1)]
        df = self._counted(clean.union_by_name(*cleaned), "union")
        df = self._counted(clean.drop_duplicate_rows(df), "deduplicated")
        df = self._counted(positive_nights(clean.add_total_nights(df)), "with nights")
        self.kept = self._counted(adr_below(df, max_adr), "below rate limit")

    def _counted(self, df: DataFrame, stage: str) -> DataFrame:
        self.seen.append((stage, Observation()))
        return df.observe(self.seen[-1][1], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> DataFrame:
        """``(step, stage, rows)``, once a job has run over ``kept``."""
        rows = [(step, stage, seen.get["rows"]) for step, (stage, seen) in enumerate(self.seen, 1)]
        return self.spark.createDataFrame(rows, "step int, stage string, rows long")


def preprocess_counted(*frames: DataFrame, path: str, max_adr: float = 500) -> DataFrame:
    """Write what :func:`preprocess` returns to ``path``; rows after each stage: ``(step, stage, rows)``.

    The counts are observed while the rows pass, so they and the table come out of one run.
    """
    stages = _Stages(frames, max_adr)
    df = clean.parse_dates(clean.to_int(stages.kept))
    clean.add_revenue(clean.add_arrival_date(clean.add_month_number(df))).write.mode("overwrite").parquet(path)
    return stages.counts()


def stage_counts(*frames: DataFrame, max_adr: float = 500) -> DataFrame:
    """Rows after each stage of :func:`preprocess`: ``(step, stage, rows)``.

    Equal rows are grouped once, as packed rows, with the number of copies from each export;
    all counts follow from these groups.
    """
    marked = [clean_file(df).withColumn("_file", F.lit(i)) for i, df in enumerate(frames, 1)]
    union = clean.union_by_name(*marked)
    per_file = [F.count_if(F.col("_file") == i).alias(f"_from_{i}") for i in range(1, len(frames) + 1)]
    whole = clean.packed_row(union.drop("_file")).alias("_row")
    union = clean.add_total_nights(union)
    kept, low = (F.col("total_nights") > 0).alias("_kept"), (F.col("adr") < max_adr).alias("_low")
    merged = union.select(whole, kept, low, "_file").groupBy("_row", "_kept", "_low").agg(*per_file)
    counts = [F.coalesce(F.sum(f"_from_{i}"), F.lit(0)) for i in range(1, len(frames) + 1)]
    stages = {f"file {i}": n for i, n in enumerate(counts, 1)}
    stages["union"] = sum(counts[1:], counts[0])
    stages |= {
        "deduplicated": F.count("*"),
        "with nights": F.count_if("_kept"),
        "below rate limit": F.count_if(F.col("_kept") & F.col("_low")),
    }
    totals = merged.agg(*[n.alias(name) for name, n in stages.items()])
    entries = [F.struct(F.lit(i).alias("step"), F.lit(c).alias("stage"), F.col(c).alias("rows")) for i, c in enumerate(stages, 1)]
    return totals.select(F.inline(F.array(*entries)))


def question_view(df: DataFrame) -> DataFrame:
    """The booking table as the text and question jobs see it.

    Ids are whole numbers with 0 for none, country and meal have display
    defaults, nights and revenue are computed with gaps as 0.
    """
    df = clean.fill_display_defaults(clean.coerce_int_or_zero(df))
    return clean.add_revenue(clean.add_total_nights(df, null_safe=True), null_safe=True)
