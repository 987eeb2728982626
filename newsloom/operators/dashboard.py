"""Console queries: overview, message lists, members, search by tags, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUDIT_PAGE, DAY_MS, FOUND_MESSAGES, MESSAGE_STATUSES, ROLES, SCAN_PER_STATUS, SEARCHED_STATUSES, SKIP_REASONS, STAGES, WEEK_MS
from ..functions.text import col, csv_cell, merge_tags, post_url
from . import metrics, work
from .items import live


def _every(df: DataFrame, names: tuple[str, ...], column: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {column} string")


def status_counts(messages: DataFrame) -> DataFrame:
    """Live messages by status, zeros included."""
    n = messages.where(F.col("deleted") == F.lit(False)).groupBy("status").agg(F.count("*").alias("n"))
    return _every(messages, MESSAGE_STATUSES, "status").join(n, "status", "left").select("pos", "status", F.coalesce("n", F.lit(0)).alias("n"))


def status_totals(messages: DataFrame) -> DataFrame:
    """Counts by status with the overall count (status null)."""
    return messages.where(live()).rollup("status").agg(F.count("*").alias("n"))


def queue_depth(items: DataFrame) -> DataFrame:
    n = items.where(F.col("status").isin("pending", "running")).groupBy("stage").agg(F.count("*").alias("n"))
    return _every(items, STAGES, "stage").join(n, "stage", "left").select("pos", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def skip_split(facts: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Zero-filled reasons; the total is the sum of the split."""
    rows = metrics.in_window(facts, start_ms, end_ms).where(F.col("name") == "ItemsSkipped")
    parts = [F.coalesce(F.sum(F.when(F.col("by") == r, F.col("value"))), F.lit(0)).alias(r) for r in SKIP_REASONS]
    return rows.agg(*parts).withColumn("total", sum((F.col(r) for r in SKIP_REASONS[1:]), F.col(SKIP_REASONS[0])))


def recent_messages(messages: DataFrame, most: int = 3) -> DataFrame:
    """The newest of each status, then the newest of those."""
    rows = messages.where((F.col("deleted") == F.lit(False)) & F.col("status").isin(*MESSAGE_STATUSES))
    return rows.orderBy(F.desc("ts"), "id").limit(most)


def overview(facts: DataFrame, items: DataFrame, sources: DataFrame, messages: DataFrame, now_ms: int) -> DataFrame:
    """One row of totals over a day (classes: a week)."""
    day = metrics.in_window(facts, now_ms - DAY_MS, now_ms)
    week = metrics.in_window(facts, now_ms - WEEK_MS, now_ms).where((F.col("name") == "ItemsClassified") & F.col("by").isNotNull())
    of = lambda n, extra=F.lit(True): F.coalesce(F.sum(F.when((F.col("name") == n) & extra, F.col("value"))), F.lit(0))
    reason = lambda r: of("ItemsSkipped", F.col("by") == r).alias(f"skipped_{r}")
    a = day.agg(of("ItemsScraped").alias("scraped"), of("ItemsDropped", F.col("by").isNotNull()).alias("dropped"), of("ItemsAnalyzed").alias("analyzed"), *map(reason, SKIP_REASONS))
    b = items.agg(*[F.count(F.when((F.col("stage") == s) & F.col("status").isin("pending", "running"), 1)).alias(f"queued_{s}") for s in STAGES], F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
    c = sources.where(live() & (F.col("status") == "ok")).agg(F.count(F.when(F.length("lastError") > 0, 1)).alias("failingSources"))
    d = messages.where(F.col("deleted") == F.lit(False)).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"messages_{s}") for s in MESSAGE_STATUSES])
    e = week.groupBy("by").agg(F.sum("value").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("by", "n")))).alias("categories"))
    return a.join(b).join(c).join(d).join(e)  # one row each


def message_list(messages: DataFrame, audit: DataFrame, status: str) -> DataFrame:
    """Messages of a status, newest first, with errors since their last post."""
    rows = messages.where((F.col("status") == status) & (F.col("deleted") == F.lit(False)))
    a = audit.where("messageId is not null").select(F.col("messageId").alias("id"), "target", "at")
    open_ = rows.select("id", "posts").join(a, "id").where(F.col("at") > F.coalesce(F.try_element_at("posts", F.col("target"))["tgAt"], F.lit(-1)))
    n = open_.groupBy("id").agg(F.count("*").alias("errors"))
    return rows.join(n, "id", "left").withColumn("errors", F.coalesce("errors", F.lit(0))).orderBy(F.desc("ts"), "id")


def members_of(messages: DataFrame, id: str) -> DataFrame:
    rows = messages.where((F.col("id") == id) & live()).select(F.explode("members").alias("itemId", "block"))
    return rows.select("itemId", "block.*", post_url("itemId").alias("url")).orderBy("ts", "itemId")


def audit_page(audit: DataFrame, message: str | None = None) -> DataFrame:
    rows = audit if message is None else audit.where(F.col("messageId") == message)
    rows = rows.orderBy(F.desc("at"), "messageId", "target", "itemId", "error")
    return rows.limit(AUDIT_PAGE) if message is None else rows


def find_by_tags(messages: DataFrame, tags: list[str], limit: int = FOUND_MESSAGES) -> DataFrame:
    """Messages with any of the tags, newest first; matched counts all within the
    newest SCAN_PER_STATUS of each searched status."""
    wanted = merge_tags(F.array(*[F.lit(t) for t in tags]))
    order = Window.partitionBy("status").orderBy(F.desc("ts"), "id")
    window = messages.where((F.col("deleted") == F.lit(False)) & F.col("status").isin(*SEARCHED_STATUSES)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SCAN_PER_STATUS)
    hits = window.where(F.arrays_overlap(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower), wanted))
    total = hits.agg(F.count("*").alias("matched"))
    return hits.drop("_r").orderBy(F.desc("ts"), "id").limit(min(limit, FOUND_MESSAGES)).join(total)


def allowed(enabled, roles, least: str) -> Column:
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    return col(enabled) & F.exists(col(roles), lambda r: F.coalesce(F.try_element_at(rank, r), F.lit(-1)) >= ROLES.index(least))


def errors_page(items: DataFrame) -> DataFrame:
    total = items.where(F.col("status") == "error").agg(F.count("*").alias("total"))
    return work.previews(work.errors(items)).join(total)


def verdict_guard(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Ids whose verdicts are missing, unasked or repeated; empty when all is well."""
    v = verdicts.groupBy("id").agg(F.count("*").alias("n"))
    rows = asked.select("id", F.lit(True).alias("asked")).join(v, "id", "full")
    return rows.select("id", F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "stranger").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One CSV line for each row; arrays as comma text."""
    text = lambda c: F.array_join(c, ",") if rows.schema[c].dataType.typeName() == "array" else F.col(c)
    return rows.select(F.concat_ws(",", *[csv_cell(text(c)) for c in columns]).alias("line"))
