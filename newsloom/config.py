"""Limits, thresholds and enumerations, one definition each."""

from __future__ import annotations

MERGE_THRESHOLD = 0.72
DISTINCT_THRESHOLD = 0.35
WEIGHTS = {"entities": 0.6, "titleTokens": 0.25, "tags": 0.15}
KEY_CAP = 256
MAX_MEMBERS = 20
RENDERED_MEMBERS = 12
SETTLE_MS = 300_000
TEXT_LIMIT = 4096
PHOTO_LIMIT = 1012
SUMMARY_MAX = 220
MAX_AGE_MS = 3 * 86_400_000
HOUR_MS, DAY_MS, WEEK_MS = 3_600_000, 86_400_000, 7 * 86_400_000
BACKOFF_MS = 30_000
DONE_TTL_MS, AUDIT_TTL_MS = 7 * DAY_MS, 30 * DAY_MS
CHUNK_SECONDS = 25
MIN_LABELLED_PAIRS = 100
SOURCES_PER_RUN, POSTS_PER_PAGE, VIDEOS_PER_RUN = 10, 20, 20
QUEUE_PREVIEW, ITEMS_PAGE, ERROR_PAGE, AUDIT_PAGE, PUBLISH_NOW = 10, 100, 50, 200, 10
SCAN_PER_STATUS, FOUND_MESSAGES, PREVIEW_CHARS, PAYLOAD_CHARS = 200, 10, 140, 4000

# Closed sets of names, in their customary order.
CATEGORIES = (
    "art&fashion", "crime", "culture&history", "news-digest", "economics&finance", "education", "energy", "entertainment", "sports",
    "environmental", "geopolitics", "health", "human-rights", "infrastructure", "international", "media", "other", "politics",
    "real-estate", "science", "social", "technology", "internet", "traditions", "tourism", "traffic", "war", "incidents", "nature",
)
DROPPED_CATEGORY = "crime&law"
MESSAGE_STATUSES = ("topublish", "published", "no_target", "error")
SEARCHED_STATUSES = ("published", "topublish")
STAGES = ("analyze", "aggregate", "publish")
ATTEMPTS = {"analyze": 3, "aggregate": 3, "publish": 5}
SKIP_REASONS = ("low", "category", "nobody")
ROLES = ("viewer", "editor", "admin")
PALETTE = ("#4a9eff", "#3fb950", "#d29922", "#c3cfe0", "#a371f7", "#39c5cf", "#db6d28", "#db61a2", "#8ddb8c", "#6e7681")
