"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.scratch import scratch_path

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds at least one row in so many; by counting, no more keys than this can be hot.
HOT_KEYS = 1024


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that begins with ``name`` and clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs started inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for executors that have no copy of it."""
    package, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


class Steps:
    """Tables that one job writes to the shared folder between its steps.

    A table in the shared folder cuts the lineage and outlives executors. The shuffle
    files of a step go once its table is written; ``drop`` removes a table that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int = 2000, codec: str = "snappy"):
        self.spark, self.name, self.batch_rows, self.codec, self.paths = spark, name, batch_rows, codec, {}
        ship(spark)

    def store(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        with settings(
            self.spark,
            spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
            spark__sql__execution__arrow__maxRecordsPerBatch=str(self.batch_rows),
        ):
            df.write.option("compression", self.codec).parquet(path)
        self.paths[step] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(step))
            path.getFileSystem(conf).delete(path, True)


def join_lookup(left: DataFrame, lookup: DataFrame, on: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """Left join with a table of unique keys, whatever the share of one key on the left.

    ``hot`` holds the lookup rows of the keys with most left rows; it must be bounded
    (see ``HOT_KEYS``) and is broadcast. Rows it serves leave the shuffled join spread by
    ``spread``, a value that differs from row to row and is the same on a rerun.
    """
    values = [c for c in lookup.columns if c not in on]
    packed = lambda df, name: df.select(*on, F.struct(F.lit(1).alias("_"), *values).alias(name))
    found = left.join(F.broadcast(packed(hot, "_hot")), on, "left")
    found = found.withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    )
    # Always 0, but no constant: else the salt would not be a key of the join.
    rest = packed(lookup, "_cold").withColumn("_salt", F.pmod(F.xxhash64(*on), F.lit(1)).cast("int"))
    found = found.join(rest, [*on, "_salt"], "left")
    either = F.coalesce("_hot", "_cold")
    return found.select(*left.columns, *[either[v].alias(v) for v in values])


def hot_rows(lookup: DataFrame, count: str, total: int) -> DataFrame:
    """The lookup rows of the keys with at least one in ``HOT_KEYS`` of all rows."""
    return lookup.where(F.col(count) * HOT_KEYS >= F.lit(max(total, 1)))


def running_total(df: DataFrame, group: list[str], order: list[str], unit: Column, rows: Column, value: str,
                  out: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group, without a task per group.

    ``unit`` is a number from 0 up to, but without, 1 that grows with ``order``, and
    ``rows`` the row count of the row's group. A group of n rows is cut into about sqrt(n)
    ranges of ``unit`` with about sqrt(n) rows each; totals of ranges are summed first,
    then rows inside their range, so no task meets more than about sqrt(n) rows at once.
    Group columns must not be null.
    """
    cut = df.withColumn("_range", F.floor(unit * F.ceil(F.sqrt(rows)).cast("double")).cast("long"))
    totals = cut.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = cut.join(totals, [*group, "_range"])
    found = found.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return found.drop("_range", "_before")


def join_counted(left: DataFrame, lookup: DataFrame, on: str, spread: Column) -> DataFrame:
    """``join_lookup`` that counts the rows per key of ``left`` itself to find the hot keys."""
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    keys = hot_rows(counts, "_n", total).select(on)
    return join_lookup(left, lookup, [on], lookup.join(F.broadcast(keys), on, "left_semi"), spread)
