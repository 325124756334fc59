"""Country code to name map."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTRY_NAMES

_SCHEMA = "code string, name string"


def country_dimension(spark: SparkSession) -> DataFrame:
    """The built-in map as ``(code, name)``; 70 rows, so it is marked for broadcast."""
    return F.broadcast(spark.createDataFrame(list(COUNTRY_NAMES.items()), _SCHEMA))


def read_country_map(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON object ``{code: name}`` as ``(code, name)``.

    A missing or unreadable file gives an empty map, so codes pass through. The
    file's size reaches the optimizer, which broadcasts the map while it is small.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], _SCHEMA)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "name"))
