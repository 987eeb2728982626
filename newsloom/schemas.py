"""Explicit table schemas; read-side defaults; write-side allow-lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = "array<struct<id: bigint, href: string>>"
MEMBER = f"struct<summary: string, links: {LINKS}, channel: string, ts: bigint>"
POST = "struct<tgId: string, tgAt: bigint>"
SOURCES = "id string, status string, category string, tags array<string>, teaser string, type string, lastItemId string, lastCount bigint, lastUpdated bigint, lastResult string, zeroYieldRuns bigint, lastNonZeroCount bigint, lastError string, deleted boolean"
CHANNEL_POST = f"source_id string, id string, body string, links {LINKS}, image string, forwardedFrom string, postedAt string"
SCRAPED = f"id string, body string, links {LINKS}, image string, forwardedFrom string, date string, category string, tags array<string>, kind string"
ANALYZED = f"id string, seq bigint, body string, links {LINKS}, image string, date string, kind string, title string, summary string, country string, location string, category string, importance string, peoples string, properNames string, tags array<string>"
MESSAGES = f"id string, status string, members map<string, {MEMBER}>, memberCount bigint, keyEntities array<string>, keyTitle array<string>, keyTags array<string>, memberIds array<string>, date string, title string, country string, location string, peoples string, tags array<string>, image string, tgChannel string, posts map<string, {POST}>, tgId string, tgAt bigint, ts bigint, deleted boolean"
TARGETS = "id string, type string, lastPostedDate string, lastPostedMessageId string, messageTemplate string, tags array<string>, deleted boolean"
TAGS = "id string, keywords array<string>, count bigint, lastDate string, deleted boolean"
INGEST = "id string, stage string, status string, raw string, retryCount bigint, runAt bigint, leaseUntil bigint, error string, cause string, diagnosis struct<summary: string, cause: string, fix: string, at: bigint>, createdAt bigint, startedAt bigint, finishedAt bigint, expireAt timestamp"
CONTROLS = "stage string, paused boolean, budget bigint, requestedAt bigint"
AUDIT = "kind string, messageId string, target string, method string, stage string, itemId string, ref string, job string, error string, cause string, at bigint, expireAt timestamp"
METRICS = "hour bigint, name string, by string, value bigint"
VIDEOS = "id string, title string, status string, addedAt bigint, note string, lang string, kind string, transcript string, deleted boolean"

# Fields that an edit may write, by table.
WRITABLE = {
    "sources": ("status", "category", "tags", "teaser", "type"),
    "messages": ("status", "title", "country", "location", "peoples", "tags", "image"),
    "targets": ("type", "messageTemplate", "tags"),
    "tags": ("keywords",),
}
CURSOR_FIELDS = ("lastItemId", "lastCount", "lastUpdated", "lastResult", "zeroYieldRuns", "lastNonZeroCount", "lastError")


def _defaulted(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.expr(e)) for c, e in defaults.items() if c in df.columns})


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Missing counters are 0, missing keys and posts empty, a missing source
    type is telegram."""
    none = "cast(array() as array<string>)"
    return _defaulted(df, {
        "sources": {"type": "'telegram'", "lastCount": "0L", "lastUpdated": "0L", "zeroYieldRuns": "0L", "lastNonZeroCount": "0L", "lastItemId": "''"},
        "messages": {"keyEntities": none, "keyTitle": none, "keyTags": none, "memberIds": none, "posts": f"cast(map() as map<string, {POST}>)"},
        "targets": {"type": "'telegram'"},
        "tags": {"count": "0L", "keywords": none},
    }.get(table, {}))


def check_writable(table: str, fields) -> None:
    """Unknown fields are an error; an empty edit is one except for tags."""
    unknown = sorted(set(fields) - set(WRITABLE[table]))
    if unknown:
        raise ValueError(f"{table}: not writable: {', '.join(unknown)}")
    if not fields and table != "tags":
        raise ValueError(f"{table}: an edit must change at least one field")


def violations(messages: DataFrame) -> DataFrame:
    """Message rows that break an invariant."""
    from .functions.dates import is_date_key

    return messages.where((F.col("memberCount") != F.size("members")) | ~F.col("id").rlike(r"^[^/]+/\d+$") | ~is_date_key("date") | (F.col("country") != F.upper("country")))
