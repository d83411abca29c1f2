"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # folders made here, by application
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process (local, local[n]) gets a
    temporary folder of its own, which goes when Python ends; elsewhere an unset folder is an error, as executors can't see the driver's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and what makes its Path objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at(path), True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, in a folder that goes at the end of the innermost cleared(), else of the application."""
    folder = f"{shared_dir(spark)}/draftmill/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, folder)
    fs.mkdirs(at(folder))
    fs.deleteOnExit(at(folder))
    if _scopes:
        _scopes[-1].append(folder)
    return f"{folder}/table"


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Paths that are made within are removed at the end; what is read from them must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it has the same rows however often it is read, its lineage is cut, and a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
