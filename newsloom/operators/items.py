"""Stages one and two: channel posts to scraped items, scraped to analyzed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_MS, DROPPED_CATEGORY, MAX_AGE_MS, POSTS_PER_PAGE, SOURCES_PER_RUN
from ..functions.dates import epoch_ms
from ..functions.text import col, merge_tags, normalize_country, strip_teaser, trim

MINUTE_MS = DAY_MS // 1440


def live() -> Column:
    return ~F.coalesce(F.col("deleted"), F.lit(False))


def due_at(last_count="lastCount", last_updated="lastUpdated") -> Column:
    """Full pages are due at once, short ones after 30 minutes, empty after 240."""
    n, at = col(last_count), col(last_updated)
    return F.when(n > POSTS_PER_PAGE, at).when(n > 0, at + 30 * MINUTE_MS).otherwise(at + 240 * MINUTE_MS)


def select_sources(sources: DataFrame, now_ms: int, kind: str = "telegram", limit: int = SOURCES_PER_RUN) -> DataFrame:
    """The most overdue enabled sources of a type."""
    due = sources.where(live() & (F.col("status") == "ok") & (F.coalesce("type", F.lit("telegram")) == kind)).withColumn("dueAt", due_at())
    return due.where(F.col("dueAt") <= now_ms).orderBy("lastUpdated", "id").limit(limit)


def source_previews(sources: DataFrame, now_ms: int) -> DataFrame:
    """Enabled sources; those of the next run first, then by due time."""
    order = Window.partitionBy(F.coalesce("type", F.lit("telegram"))).orderBy("lastUpdated", "id")
    due = sources.where(live() & (F.col("status") == "ok") & (due_at() <= now_ms))
    chosen = due.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= SOURCES_PER_RUN).select("id")
    rows = sources.where(live() & (F.col("status") == "ok")).join(chosen.withColumn("next", F.lit(True)), "id", "left")
    rows = rows.select("id", F.coalesce("type", F.lit("telegram")).alias("type"), due_at().alias("dueAt"), F.coalesce("next", F.lit(False)).alias("next"), "lastCount", F.nullif("lastError", F.lit("")).alias("lastError"))
    return rows.orderBy(F.desc("next"), "dueAt", "id")


def page_after(posts: DataFrame, cursors: DataFrame, size: int = POSTS_PER_PAGE) -> DataFrame:
    """For each source the newest page without a cursor, else the next page after it."""
    number = F.col("id").cast("long")
    rows = posts.join(cursors.select("source_id", "lastItemId"), "source_id", "left").withColumn("_cursor", F.expr("try_cast(lastItemId as bigint)"))
    rows = rows.where(F.col("_cursor").isNull() | (number > F.col("_cursor")))
    order = F.when(F.col("_cursor").isNull(), -number).otherwise(number)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source_id").orderBy(order)))
    return ranked.where(F.col("_rank") <= size).drop("_rank", "_cursor", "lastItemId")


def is_obsolete(posted_at, now_ms: int) -> Column:
    at = epoch_ms(posted_at)
    return at.isNull() | (F.lit(now_ms) - at > MAX_AGE_MS)


def item_kind(body, forwarded_from, posted_at, now_ms: int) -> Column:
    kept = F.when(F.coalesce(col(forwarded_from), F.lit("")) != "", "forward").when(trim(body) == "", "empty").otherwise("post")
    return F.when(is_obsolete(posted_at, now_ms), "obsolete").otherwise(kept)


def to_items(posts: DataFrame, sources: DataFrame, date: str, now_ms: int) -> DataFrame:
    """Scraped items: the post with its source's category, tags and teaser rule.
    Spark broadcasts sources where they are small."""
    s = sources.select(F.col("id").alias("source_id"), "category", "tags", "teaser")
    rows = posts.join(s, "source_id").withColumn("body", strip_teaser("body", "teaser"))
    return rows.select(
        F.concat_ws("/", "source_id", "id").alias("id"), "body", "links", "image", "forwardedFrom", F.lit(date).alias("date"),
        "category", "tags", item_kind("body", "forwardedFrom", "postedAt", now_ms).alias("kind"),
    )


def prefilter(body) -> Column:
    """nobody for an empty body or a lone link, else null."""
    text = trim(body)
    return F.when((text == "") | text.rlike(r"^\[[^\]]*\]\(#\d+\)$"), "nobody")


def route(category, importance) -> Column:
    """A struct of decision (drop, retry, enqueue) and reason."""
    category = F.coalesce(col(category), F.lit(""))
    decide = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).cast("string").alias("reason"))
    low = F.coalesce(col(importance) == "low", F.lit(False))
    return F.when(category == "", decide("retry", "no-category")).when(low, decide("drop", "low")).when(category == DROPPED_CATEGORY, decide("drop", "category")).otherwise(decide("enqueue", None))


def map_tags(rows: DataFrame, dictionary: DataFrame, key: str = "id", column: str = "tags") -> DataFrame:
    """Each tag becomes all ids whose keywords hold it, or stays; first occurrence
    kept.  An equi join on exploded tags, whatever the size of the dictionary."""
    words = dictionary.where(live()).select(F.explode("keywords").alias("_tag"), F.col("id").alias("_id")).distinct()
    tags = rows.select(key, F.posexplode(column).alias("_pos", "_tag"))
    hits = tags.join(words, "_tag", "left").select(key, F.struct("_pos", F.coalesce("_id", "_tag").alias("tag")).alias("t"))
    mapped = hits.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"])).alias("_mapped"))
    out = rows.join(mapped, key, "left")
    return out.withColumn(column, F.coalesce("_mapped", F.array().cast("array<string>"))).drop("_mapped")


def normalize_analyzed(scraped: DataFrame, answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Scraped items with a classifier's answers, joined by id: country trimmed
    and upper case, answer and source tags merged and mapped."""
    a = answers.select("id", "title", "summary", "country", "location", F.col("category").alias("_category"), "importance", "peoples", "properNames", F.col("tags").alias("_tags"))
    rows = scraped.join(a, "id").withColumns({"country": normalize_country("country"), "category": F.col("_category"), "tags": merge_tags("_tags", "tags")})
    return map_tags(rows.drop("_category", "_tags"), dictionary)


def tag_encounters(items: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag table after counting: count grows by one for each item that carries
    the tag, lastDate is that of the newest."""
    seen = items.select("date", F.explode(F.array_distinct("tags")).alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.max("date").alias("d"))
    rows = tags.join(seen, "id", "full")
    return rows.select("id", "keywords", (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("count"), F.coalesce("d", "lastDate").alias("lastDate"), "deleted")


def cursors(posts: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """The cursor fields of each polled source: newest id by number over all posts,
    page size, zero-yield runs and staleness."""
    found = posts.groupBy("source_id").agg(F.max_by("id", F.col("id").cast("long")).alias("newest"), F.count("*").alias("n"))
    s = sources.select(F.col("id").alias("source_id"), "lastItemId", "zeroYieldRuns", "lastNonZeroCount")
    n = F.coalesce("n", F.lit(0))
    runs = F.when(n > 0, 0).otherwise(F.coalesce("zeroYieldRuns", F.lit(0)) + 1)
    some = F.when(n > 0, n).otherwise(F.coalesce("lastNonZeroCount", F.lit(0)))
    return s.join(found, "source_id", "left").select(
        F.col("source_id").alias("id"), F.coalesce("newest", "lastItemId").alias("lastItemId"), n.cast("long").alias("lastCount"), F.lit(now_ms).alias("lastUpdated"),
        runs.cast("long").alias("zeroYieldRuns"), some.cast("long").alias("lastNonZeroCount"), ((runs >= 3) & (some > 0)).alias("stale"),
    )
