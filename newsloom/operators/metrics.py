"""Hourly counters as fact rows (hour, name, by, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HOUR_MS
from ..functions.dates import hour_bucket


def facts(counts: DataFrame) -> DataFrame:
    """Buffered counts (at, name, by, value) summed into hour rows; spread over
    the cluster by map-side sums."""
    return counts.groupBy(hour_bucket("at").alias("hour"), "name", "by").agg(F.sum("value").alias("value"))


def in_window(rows: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Hours from the one that holds the start, whole, up to the end."""
    return rows.where((F.col("hour") >= start_ms // HOUR_MS * HOUR_MS) & (F.col("hour") < end_ms))


def total(rows: DataFrame, name: str, start_ms: int, end_ms: int) -> DataFrame:
    return in_window(rows, start_ms, end_ms).where(F.col("name") == name).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def by_key(rows: DataFrame, name: str, start_ms: int, end_ms: int) -> DataFrame:
    keyed = in_window(rows, start_ms, end_ms).where((F.col("name") == name) & F.col("by").isNotNull())
    return keyed.groupBy("by").agg(F.sum("value").alias("total"))


def with_splits(rows: DataFrame) -> DataFrame:
    """Totals of each hour and name, and of each split, in one pass."""
    return rows.groupingSets([["hour", "name"], ["hour", "name", "by"]], "hour", "name", "by").agg(F.sum("value").alias("value"), F.grouping("by").alias("is_total")).where("is_total = 1 or by is not null")
