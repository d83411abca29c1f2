"""A stored table of crops by id, apart from the results: put, delete, look up and clear, in any order and as often as one likes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions.columns import or_empty
from draftmill.streaming.store import KeyedTable

CROPS = "id string, crop string"


def _store(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "id")


def save_crops(crops: DataFrame, path: str) -> None:
    """Stores `crop` by `id` over what is there; rows with an empty crop or without an id are passed over. Of rows that share an id in one call, the one with the
    greatest crop counts."""
    kept = crops.filter(or_empty(F.col("crop")) != "").groupBy("id").agg(F.max("crop").alias("crop"))
    _store(crops.sparkSession, path).put(kept)


def drop_crops(ids: DataFrame, path: str) -> None:
    """Removes the crops of `id`s; ids that aren't there are no matter."""
    _store(ids.sparkSession, path).delete(ids)


def load_crops(spark: SparkSession, path: str) -> DataFrame:
    """(id, crop) of all that is stored; no rows where nothing is."""
    stored = _store(spark, path).read()
    return stored if stored is not None else spark.createDataFrame([], CROPS)


def clear_crops(spark: SparkSession, path: str) -> None:
    _store(spark, path).clear()
