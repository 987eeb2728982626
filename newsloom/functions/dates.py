"""Epoch-millisecond dates, buckets and delays; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BACKOFF_MS, HOUR_MS, SETTLE_MS
from .text import col


def date_key(ms) -> Column:
    """UTC day of an epoch-millisecond column."""
    days = F.expr("DATE '1970-01-01'")
    return F.date_format(F.date_add(days, F.floor(col(ms) / 86_400_000).cast("int")), "yyyy-MM-dd")


def iso_timestamp(ms) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_date_key(key) -> Column:
    return F.coalesce(col(key).rlike(r"^\d{4}-\d{2}-\d{2}$") & col(key).try_cast("date").isNotNull(), F.lit(False))


def hour_bucket(ms) -> Column:
    return F.floor(col(ms) / HOUR_MS).cast("long") * HOUR_MS


def settle_bucket(ms) -> Column:
    return F.floor(col(ms) / SETTLE_MS).cast("long")


def backoff(attempt) -> Column:
    """30 s, then twice as long with each attempt."""
    return (F.lit(BACKOFF_MS) * F.pow(F.lit(2.0), col(attempt) - 1)).cast("long")


def epoch_ms(iso) -> Column:
    """Milliseconds of an ISO time; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(col(iso)))


def clock(seconds) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = col(seconds).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), pad(m), pad(r))).otherwise(F.concat_ws(":", pad(m), pad(r)))
