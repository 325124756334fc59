"""Exact de-duplication: local, then salted, then global winners. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, fresh, hot_rows, join_lookup, text_of

#: Copies of one text meet in so many salted groups before they meet globally.
SALTS = 32
#: More than any doc_id that is shifted to be positive; the shift; the place after every doc_id.
_UNIT, _SHIFT, _NO_ID = 10**20, 2**63, 2**64


def normalised(text: Column) -> Column:
    """The text without space and the ASCII controls 9 to 13."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number: more code points first, then the smaller doc_id, null ids last.

    A decimal can be updated in place, so the aggregates below stay hash aggregates.
    """
    place = F.coalesce(doc_id.cast("decimal(20,0)") + _number(_SHIFT), _number(_NO_ID))
    return (n_chars.cast("decimal(10,0)") * _number(_UNIT) - place).cast("decimal(38,0)")


def _chars(rank: Column) -> Column:
    return F.ceil(rank / _number(_UNIT)).cast("long")


def _best_id(rank: Column) -> Column:
    place = _chars(rank).cast("decimal(12,0)") * _number(_UNIT) - rank
    return F.when(place < _number(_NO_ID), (place - _number(_SHIFT)).cast("long"))


def _keys(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select("doc_id", normalised(text).alias("_norm"), F.length(text).alias("_n"))


def winners(docs: DataFrame) -> DataFrame:
    """One row per different text: its digest, ``keep_id``, ``group_size`` and code points.

    Rows are combined inside each task first, with the whole normalised text in the
    grouping key; a task's winners then meet in ``SALTS`` salted groups (the salt is the
    task's number, so a text that fills every task arrives as one row per task), and the
    salts' winners meet globally, again by whole text. Should two texts have one digest,
    the job fails instead of mixing them.
    """
    rows = _keys(docs)
    rows = rows.select(
        F.sha2("_norm", 256).alias("text_sha256"), "_norm", _rank(F.col("_n"), F.col("doc_id")).alias("_rank"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"),
    )
    count, best = F.count(F.lit(1)).alias("_count"), F.max("_rank").alias("_rank")
    salted = rows.groupBy("text_sha256", "_norm", "_salt").agg(best, count)
    texts = salted.groupBy("text_sha256", "_norm").agg(best, F.sum("_count").alias("_count"))
    groups = texts.groupBy("text_sha256").agg(best, F.sum("_count").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    whole = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts with one digest")).cast("long"))
    return groups.select(
        "text_sha256", _best_id(F.col("_rank")).alias("keep_id"),
        F.coalesce(whole, F.col("group_size")).alias("group_size"),
        _chars(F.col("_rank")).alias("_keep_n"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; a null text counts as
    empty, and all empty texts are one group. The row with most code points stays, then
    the smallest doc_id; a null doc_id comes last and is kept as null. Of several rows
    with the winner's doc_id and length one stays. An empty table gives an empty result;
    other columns are not read.
    """
    steps = Steps(docs.sparkSession, "exact")
    groups = steps.store(winners(docs), "winners")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = _keys(docs)
    rows = rows.select("doc_id", F.sha2("_norm", 256).alias("text_sha256"), "_n")
    spread = F.coalesce("doc_id", F.lit(0))
    found = join_lookup(rows, groups, ["text_sha256"], hot_rows(groups, "group_size", total), spread)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("_keep_n"))
    same = Window.partitionBy("doc_id", "text_sha256", "_n").orderBy(F.lit(0))
    found = found.withColumn("kept", first & (F.row_number().over(same) == 1))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Decides as ``exact_groups``, for null texts, null ids and empty tables too. Of rows
    that agree in doc_id and text but not in other columns, the first by their JSON text
    stays. Columns of any name and type are carried along unchanged.
    """
    steps = Steps(docs.sparkSession, "exact")
    groups = steps.store(winners(docs), "winners")
    key = fresh("key", docs.columns)
    sha, doc, n = f"{key}_sha", f"{key}_id", f"{key}_n"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(doc)
    keys = groups.select(F.col("text_sha256").alias(sha), name("keep_id"), F.col("_keep_n").cast("int").alias(n))
    text = text_of("text")
    rows = docs.select("*", F.sha2(normalised(text), 256).alias(sha), name("doc_id"), F.length(text).alias(n))
    kept = rows.join(keys, [sha, doc, n], "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # As JSON, for columns that have no order of their own.
    same = Window.partitionBy(sha, doc, n).orderBy(F.to_json(F.struct(*others)) if others else F.lit(""))
    return kept.withColumn(key, F.row_number().over(same)).where(F.col(key) == 1).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size,
         first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
