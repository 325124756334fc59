"""Clean-up steps for raw booking exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrival_date, clean_number, integer_or_zero, month_number, strip
from ..schema import DISPLAY_DEFAULTS, FILL_DEFAULTS
from .stats import exact_quantiles


def strip_column_names(df: DataFrame) -> DataFrame:
    """Strip whitespace around column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def strip_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Strip whitespace around the values of text columns, all of them by default."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(c)) for c in cols})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = FILL_DEFAULTS) -> DataFrame:
    """Replace nulls by a default per column; absent columns are ignored."""
    present = {c: v for c, v in defaults.items() if c in df.columns}
    texts = [c for c, v in present.items() if isinstance(v, str)]
    df = df.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else df
    return df.fillna(present) if present else df


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact medians in one row: ``(medians map<string, double>)``; columns without values are left out.

    One pass: the values are stacked with the name of their column and counted before
    the shuffle.
    """
    stacked = ", ".join(f"struct('{c}' AS name, CAST(`{c}` AS double) AS value)" for c in cols)
    values = df.selectExpr(f"inline(array({stacked}))")
    found = exact_quantiles(values, "value", [0.5], ["name"])
    return found.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("quantiles")[0]))).alias("medians"))


def fill_numeric_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls of numeric columns by the column's exact median.

    A column without any value keeps its nulls. Columns keep their type: the median of a
    whole-number column is truncated as :func:`to_int` does, so pass it as double where
    halves matter. Nothing runs while the plan is built: all medians come from one scalar
    subquery over all columns.
    """
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not cols:
        return df
    known = df.withColumn("_medians", medians(df, cols).scalar())
    fill = lambda c: F.coalesce(F.col(c), F.element_at("_medians", F.lit(c)).cast(df.schema[c].dataType))
    return known.withColumns({c: fill(c) for c in cols}).drop("_medians")


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null.

    A column that cannot be null, such as one with a default, settles the matter
    without a filter over all columns.
    """
    if any(not f.nullable for f in df.schema):
        return df
    return df.dropna(how="all")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column as ``(column_name, nulls)``."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "column_name", "nulls")


def null_summary(df: DataFrame, k: int | None = 10, only_missing: bool = False) -> DataFrame:
    """Columns by descending number of nulls, the first ``k`` or, with None, all."""
    counts = null_counts(df)
    if only_missing:
        counts = counts.where(F.col("nulls") > 0)
    ordered = counts.orderBy(F.desc("nulls"), "column_name")
    return ordered if k is None else ordered.limit(k)


def missing_total(df: DataFrame) -> DataFrame:
    """All missing values of a table in one number."""
    return null_counts(df).agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("missing"))


def to_int(df: DataFrame, cols: Sequence[str] = ("adults", "children", "babies")) -> DataFrame:
    """Truncate to whole numbers; absent columns are ignored."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols if c in df.columns})


def parse_dates(df: DataFrame, cols: Sequence[str] = ("reservation_status_date",)) -> DataFrame:
    """Parse dates; text that is no date becomes null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in cols})


def _whole(df: DataFrame, col: str) -> Column:
    """A column as whole numbers with 0 for gaps; integer columns need no coercion."""
    if isinstance(df.schema[col].dataType, T.IntegerType):
        return F.coalesce(F.col(col), F.lit(0))
    return integer_or_zero(F.col(col))


def coerce_int_or_zero(
    df: DataFrame, cols: Sequence[str] = ("children", "agent", "company")
) -> DataFrame:
    """Coerce to whole numbers; null and non-numeric values become 0."""
    return df.withColumns({c: _whole(df, c) for c in cols if c in df.columns})


def fill_display_defaults(
    df: DataFrame, defaults: Mapping[str, str] = DISPLAY_DEFAULTS
) -> DataFrame:
    """Replace a null country or meal by its display default."""
    return fill_defaults(df, defaults)


def add_total_nights(
    df: DataFrame,
    null_safe: bool = False,
    parts: Sequence[str] = ("stays_in_weekend_nights", "stays_in_week_nights"),
) -> DataFrame:
    """Weekend plus week nights.

    With ``null_safe``, missing and non-numeric parts count as 0, and where a
    part's column is absent an existing total is kept, else the total is 0.
    """
    if not null_safe:
        return df.withColumn("total_nights", F.col(parts[0]) + F.col(parts[1]))
    if not set(parts) <= set(df.columns):
        return df if "total_nights" in df.columns else df.withColumn("total_nights", F.lit(0))
    if all(isinstance(df.schema[c].dataType, T.IntegerType) for c in parts):
        numbers = [_whole(df, c) for c in parts]
    else:
        numbers = [F.coalesce(clean_number(F.col(c)), F.lit(0.0)) for c in parts]
    return df.withColumn("total_nights", (numbers[0] + numbers[1]).cast("int"))


def add_revenue(df: DataFrame, null_safe: bool = False) -> DataFrame:
    """Daily rate times nights.

    With ``null_safe``, a missing or non-numeric rate is set to 0, and where a
    column is absent an existing revenue is kept, else the revenue is 0.
    """
    if not null_safe:
        return df.withColumn("revenue", F.col("adr") * F.col("total_nights"))
    if not {"adr", "total_nights"} <= set(df.columns):
        return df if "revenue" in df.columns else df.withColumn("revenue", F.lit(0.0))
    df = df.withColumn("adr", F.coalesce(clean_number(F.col("adr")), F.lit(0.0)))
    return df.withColumn("revenue", F.col("adr") * F.col("total_nights"))


def add_month_number(df: DataFrame) -> DataFrame:
    """Number of the arrival month, null for an unknown name."""
    return df.withColumn("arrival_month_num", month_number(F.col("arrival_date_month")))


def add_arrival_date(df: DataFrame) -> DataFrame:
    """Arrival date from year, month number and day; impossible dates are null."""
    return df.withColumn(
        "arrival_date",
        arrival_date(
            F.col("arrival_date_year").cast("int"),
            F.col("arrival_month_num"),
            F.col("arrival_date_day_of_month").cast("int"),
        ),
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name and missing ones null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def _packs(df: DataFrame) -> bool:
    """Whether every column can be written as text and read back exactly."""
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
    names = {c.lower() for c in df.columns}
    return 0 < len(names) == len(df.columns) and all(f.dataType == T.StringType() or type(f.dataType) in plain for f in df.schema)


def packed_row(df: DataFrame) -> Column:
    """A row as one value that is equal for equal rows, nulls and the two zeros included.

    Text and numbers become one line: fields end with tabs, a missing one is ``\\N``. It is
    less than half as wide in a shuffle as the columns. Rows with other types become a struct.
    """
    if not _packs(df):
        return F.struct(*[F.col(f"`{c}`") for c in df.columns])

    def field(f: T.StructField) -> Column:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType):
            text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\b")), F.lit("\t"), F.lit("\\t"))
        else:
            zero = isinstance(f.dataType, (T.FloatType, T.DoubleType))
            text = (value + F.lit(0).cast(f.dataType) if zero else value).cast("string")  # -0.0 + 0.0 is 0.0
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("\t", *map(field, df.schema))


def _unpacked(lines: DataFrame, line: str, schema: T.StructType) -> DataFrame:
    """The columns of lines made by :func:`packed_row`."""

    def value(i: int, f: T.StructField) -> Column:
        text = F.nullif(F.col("_fields")[i], F.lit("\\N"))
        if isinstance(f.dataType, T.StringType):
            return F.replace(F.replace(text, F.lit("\\t"), F.lit("\t")), F.lit("\\b"), F.lit("\\")).alias(f.name)
        return text.cast(f.dataType).alias(f.name)

    fields = lines.select(F.split(line, "\t", -1).alias("_fields"))
    return fields.select(*[value(i, f) for i, f in enumerate(schema)])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each group of equal rows; nulls compare equal.

    The copies of a row meet in the map-side half of the aggregate first, so a
    row repeated very often still sends one row per task to the shuffle. Rows of
    text and numbers are shuffled as lines of text (:func:`packed_row`).
    """
    if not _packs(df):
        return df.dropDuplicates()
    return _unpacked(df.select(packed_row(df).alias("_line")).distinct(), "_line", df.schema)
