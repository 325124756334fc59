"""Feature importance of cancellations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CANCELLATION_FEATURES
from ..scratch import stored

#: Rows of a part of the training table at most. The fit keeps each row with its draws for all trees.
PART_ROWS = 250_000
#: Draws of rows that a fit keeps at most, one for each row and tree; more trees are grown in several fits.
DRAWS = 4_000_000_000

_MIN_PARTS = "spark.sql.files.minPartitionNum"
_RESULT = "feature string, importance double"


def cancellation_feature_importance(
    df: DataFrame,
    features: Sequence[str] = CANCELLATION_FEATURES,
    trees: int = 100,
    max_depth: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Random-forest importances of the features, largest first.

    Rows with a missing value are left out. Trees are grown level by level over
    the partitions; ``max_depth`` (up to 30) trades depth for passes. A fit keeps every row
    with its draws for each of its trees, so the trees of a large table are grown in several
    fits, each with a seed of its own and no fewer than two trees.
    """
    wanted = [F.col(c).cast("double").alias(c) for c in features]
    label = F.col("is_canceled").cast("double").alias("label")
    # the fit reads its input several times, so its parts are the files and not made by a shuffle for each pass
    rows = stored(df.select(*wanted, label).dropna(), "training", file_rows=PART_ROWS)
    spark, n, files = df.sparkSession, rows.count(), len(rows.inputFiles())
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    if files < parts:  # fewer than cores
        rows = rows.repartition(parts)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    vectors, total = vectors.select("features", "label"), np.zeros(len(features))
    before = spark.conf.get(_MIN_PARTS, None)
    if files >= parts:
        spark.conf.set(_MIN_PARTS, str(2 * files))  # no two files in one part
    try:
        for i, size in enumerate(_fits(trees, n)):
            model = RandomForestClassifier(numTrees=size, maxDepth=max_depth, seed=seed + 1_000_003 * i).fit(vectors)
            # a forest's importances are the sum over its trees, scaled to 1
            total += sum(tree.featureImportances.toArray() for tree in model.trees)
    finally:
        spark.conf.unset(_MIN_PARTS) if before is None else spark.conf.set(_MIN_PARTS, before)
    result = [(f, float(v)) for f, v in zip(features, total / (total.sum() or 1))]
    table = spark.createDataFrame(result, _RESULT)
    return table.orderBy(F.desc("importance"), "feature")


def _fits(trees: int, n: int) -> list[int]:
    """How many trees each fit over ``n`` rows grows: one of them alone would draw no rows and no features."""
    fits = max(1, min(-(-trees * n // DRAWS), trees // 2))
    return [trees // fits + (i < trees % fits) for i in range(fits)]


def guarded_feature_importance(
    df: DataFrame, trees: int = 50, min_rows: int = 50, max_depth: int = 5
) -> DataFrame:
    """Importances of the features at hand, or one row that tells why there are none.

    ``(feature, importance, reason)``: a model needs a flag, at least one feature
    and more than ``min_rows`` complete rows.
    """
    features = [c for c in CANCELLATION_FEATURES if c in df.columns]

    def refuse(reason: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(None, None, reason)], _RESULT + ", reason string")

    if not features or "is_canceled" not in df.columns:
        return refuse("required columns are not available")
    complete = df.select(*features, "is_canceled").dropna()
    seen = complete.limit(min_rows + 1).count()
    if seen == 0:
        return refuse("no complete rows")
    if seen <= min_rows:
        return refuse("not enough rows")
    table = cancellation_feature_importance(complete, features, trees, max_depth)
    return table.withColumn("reason", F.lit(None).cast("string"))
