"""A folder that the driver and all executors see, for files that a job writes and reads again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only in local mode, where driver and executors are one process, is an unset one made up for."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="spark-")
    return "file://" + _own_folders[context.applicationId].name


def fresh(spark: SparkSession, name: str) -> str:
    """A path in that folder which nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a path of that folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold inside; then the caller's are back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to that folder once and read back from there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
