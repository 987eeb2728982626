"""Structured Streaming: settle windows, hourly counters, idempotent batch writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import HOUR_MS, SETTLE_MS
from ..operators import work


def settled_publishes(changes: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One publish request for each message and five-minute window.  changes:
    message, ts (timestamp); state goes once the watermark passes the window."""
    rows = changes.withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", "5 minutes").alias("w"), "message").agg(F.min("ts").alias("at"))
    bucket = F.floor(F.unix_millis("w.start") / SETTLE_MS).cast("long")
    return out.select(F.sha1(F.concat("message", F.lit("@"), bucket.cast("string"))).alias("id"), "message", (F.unix_millis("at") + SETTLE_MS).alias("runAt"))


def hourly_counters(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(hour, name, by, value) from events of ts, name, by, value."""
    rows = events.withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "name", "by").agg(F.sum("value").alias("value")).select(F.unix_millis("w.start").alias("hour"), "name", "by", "value")


def late_split(items: DataFrame, now_ms: int, max_age_ms: int) -> tuple[DataFrame, DataFrame]:
    """(items in time, counter rows of the others by hour): old items are counted,
    not silently dropped by a watermark."""
    late = F.coalesce(F.lit(now_ms) - F.col("at") > max_age_ms, F.lit(True))
    facts = items.where(late).groupBy((F.floor(F.lit(now_ms) / HOUR_MS) * HOUR_MS).cast("long").alias("hour")).agg(F.count("*").alias("value"))
    return items.where(~late), facts.select("hour", F.lit("ItemsDropped").alias("name"), F.lit("obsolete").alias("by"), "value")


def count_hours(events: DataFrame, checkpoint: str, out: str, lateness_ms: int = HOUR_MS) -> StreamingQuery:
    """Hourly counters of events (ts, name, by, value) that lose nothing in silence.

    One batch has two sinks, each written over when a batch is run again: partial
    counters under out/facts, and under out/late the rows that came more than
    lateness_ms behind the newest event of earlier batches, by hour and name.  So a
    finished hour stays as it was, and events in = counted + late."""

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("ms", F.unix_millis("ts")).persist()
        try:
            before = spark.read.schema("newest long, epoch long").parquet(f"{out}/seen") if epoch else None
            newest = before.where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0] if epoch else None
            late = F.lit(False) if newest is None else F.coalesce(F.col("ms") < newest - lateness_ms, F.lit(True))
            hour = (F.floor(F.col("ms") / HOUR_MS) * HOUR_MS).cast("long").alias("hour")
            counted = lambda rows: rows.groupBy(hour, "name", "by").agg(F.sum("value").alias("value"), F.count("*").alias("rows"))
            for name, rows in (("facts", batch.where(~late)), ("late", batch.where(late))):
                counted(rows).write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
            batch.agg(F.max("ms").alias("newest")).write.mode("overwrite").parquet(f"{out}/seen/epoch={epoch}")
        finally:
            batch.unpersist()

    return write_batches(events, checkpoint, save)


def counted_hours(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(counters, late counters) of count_hours: hour, name, by, value, rows."""
    read = lambda name: spark.read.schema("hour long, name string, by string, value long, rows long, epoch long").parquet(f"{out}/{name}")
    return tuple(read(n).groupBy("hour", "name", "by").agg(F.sum("value").alias("value"), F.sum("rows").alias("rows")) for n in ("facts", "late"))


def settle_publishes(changes: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Publish requests of a stream of changes (message, ts) without a watermark: the
    request of a message and window is the smallest over all batches, so a late change
    finds the request that its window already has and is never dropped."""

    def save(batch: DataFrame, epoch: int) -> None:
        work.publish_requests(batch.select("message", F.unix_millis("ts").alias("at"))).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write_batches(changes, checkpoint, save)


def settled(spark: SparkSession, out: str) -> DataFrame:
    """id, message, runAt of settle_publishes: one row for each message and window."""
    rows = spark.read.schema("id string, message string, runAt long, epoch long").parquet(out)
    return rows.groupBy("id", "message").agg(F.min("runAt").alias("runAt"))


def write_batches(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs apply(batch, epoch) on what is available; the sink makes it idempotent
    by message and target."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
