"""A shared folder for tables and files that queries make on the way."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: The folders made so far and not deleted.
_made: list[str] = []


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the folders made inside but the last one, which holds the result."""
    before = len(_made)
    yield
    for path in _made[before:-1]:
        delete(spark, path)
    del _made[before:-1]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def replace(df: DataFrame, path: str) -> None:
    """Writes the table beside ``path``, then puts it in its place: a write that fails leaves what was there."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    delete(spark, path)
    target, files = _file_system(spark, path)
    files.rename(_file_system(spark, beside)[0], target)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or an own one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = option.get() if option.isDefined() else None
    if not root:
        local = spark.sparkContext.master.startswith("local")
        if not local:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="leadtime-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet in the shared folder and read back: what uses it more than once doesn't compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
