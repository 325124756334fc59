"""A shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
#: Paths each application has handed out and not removed yet.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Executors must all see it, so on a cluster the setting is required; only a
    local session without it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="roomledger-")
    return _own_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/roomledger/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Remove what this application has written to the shared folder; returns how many paths.

    Results that were not written elsewhere read these tables, so the owner of a job calls
    this when it has what it wants. Other applications' tables stay.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, paths):
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def stored(df: DataFrame | Iterable[DataFrame], name: str, batch_rows: int | None = None, file_rows: int = 0) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    For results that several later passes read: they are not computed again, and
    losing executors does not lose them. ``batch_rows`` bounds the rows that travel to
    Python together while it is written, for wide rows, ``file_rows`` the rows of a file.
    Of several frames, at least one, each is asked for when the one before is written, and
    all make one table.
    """
    path = schema = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, setting = part.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
        path, schema = path or scratch_path(spark, name), part.schema
        before = spark.conf.get(setting)
        if batch_rows:
            spark.conf.set(setting, str(batch_rows))
        try:
            part.write.mode("append").option("maxRecordsPerFile", file_rows).parquet(path)
        finally:
            spark.conf.set(setting, before)
    return spark.read.schema(schema).parquet(path)
