"""Storing: appends that keep keys unique, and latest-wins views of logs, on plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, stored: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of a batch whose key isn't stored yet, the first of each key."""
    fresh = batch.join(stored.select(key), key, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key: what updates in place would have left."""
    ranked = log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))))
    return ranked.where("_r = 1").drop("_r")
