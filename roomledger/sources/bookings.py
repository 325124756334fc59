"""Booking tables as CSV and Parquet."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DERIVED_TYPES, NA_TOKENS, RAW_TYPES, booking_schema


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by the names in their first line, which alone is read here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream, codec = place.getFileSystem(conf).open(place), codecs.getCodec(place)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line is not None:
            found.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")]))), []).append(unquote(file))
    return found


def read_bookings_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read a booking CSV, or a folder of them, with header rows.

    Every field arrives as text, so one bad value cannot change a column's type;
    missing-value tokens become null and known columns get their declared type.
    Column names are matched after stripping and other columns stay text. Only
    the headers are read here; Spark does not scan the files to infer types. Fields
    with line breaks need ``multiline``, which makes each file one task. Files with
    different headers are read in groups of one header each and put together by name;
    a column that a file lacks is null there.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}
    groups = _headers(spark, path)
    frames = []
    for names, files in groups.items() if len(groups) > 1 else [(None, [path])]:
        names = names or spark.read.options(**options).csv(path).columns
        # every header is checked against these names when its file is read
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        frames.append(_typed(spark.read.schema(schema).options(**options, enforceSchema=False).csv(files)))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def _typed(raw: DataFrame) -> DataFrame:
    known = {**RAW_TYPES, **DERIVED_TYPES}
    columns = []
    for name in raw.columns:
        value = F.col(f"`{name}`")
        value = F.when(~value.isin(*NA_TOKENS), value)
        kind = known.get(name.strip())
        if kind is not None and kind.typeName() in ("integer", "double"):
            # "3.0" is how a whole number prints once its column has held a gap
            value = value.try_cast("double").cast(kind)
        elif kind is not None:
            value = value.try_cast(kind)
        columns.append(value.alias(name))
    return raw.select(*columns)


#: Bits of a column's place in an interleaved key; so many equally full ranges are told apart.
_BITS = 6


def add_interleaved_key(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """Add a number whose bits come in turn from each column's place, so that near keys are near in every column.

    A place is the number of the equally full range that holds the value; texts are placed
    by their hash, which serves filters for equality. Nulls come first.
    """

    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DateType):
            return F.unix_date(F.col(name)).cast("double")
        return (F.col(name) if isinstance(kind, T.NumericType) else F.xxhash64(name)).cast("double")

    shares = [i / (1 << _BITS) for i in range(1, 1 << _BITS)]
    ends = df.agg(F.struct(*[F.percentile_approx(F.when(F.col(c).isNotNull(), number(c)), shares, 10_000).alias(f"_{i}") for i, c in enumerate(columns)])).scalar()
    key = F.lit(0).cast("long")
    for i, name in enumerate(columns):
        value = number(name)
        below = F.size(F.filter(F.col(f"_ends._{i}"), lambda end: end < value))  # noqa: B023
        place = F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.greatest(below, F.lit(0)))
        for bit in range(_BITS):
            key = key + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + i)
    return df.withColumn("_ends", ends).withColumn(output, key).drop("_ends")


def write_bookings(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    cluster_by: str | Sequence[str] | None = None,
    partitions: int | None = None,
) -> None:
    """Write a booking table, replacing what is at ``path``.

    ``cluster_by`` lays the rows out in ranges of that column, so that filters on
    it skip whole files and row groups; of several columns, in ranges of an interleaved
    key, which serves filters on any of them. The row hash is a second range key: a
    single hot date is cut into several files instead of one.
    """
    if cluster_by is not None:
        several = not isinstance(cluster_by, str)
        keyed = add_interleaved_key(df, cluster_by, "_order") if several else df.withColumn("_order", F.col(cluster_by))
        keyed = keyed.withColumn("_hash", F.xxhash64(*df.columns))
        keyed = keyed.repartitionByRange(*([partitions] if partitions else []), "_order", "_hash")
        df = keyed.sortWithinPartitions("_order", *(cluster_by if several else [])).drop("_order", "_hash")
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(format).save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """Save as a catalog table in buckets of ``key``, sorted by it, replacing the table.

    Joins and groups by the key, and joins with another table of as many buckets, then need
    no shuffle and no sort. Each bucket is one file, so take many buckets where a key is hot.
    """
    bucketed = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    bucketed.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_bookings(spark: SparkSession, path: str, derived: bool = True) -> DataFrame:
    """Read a Parquet booking table with its declared schema."""
    return spark.read.schema(booking_schema(derived)).parquet(path)
