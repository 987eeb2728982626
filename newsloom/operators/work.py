"""The work queue as a table: selections and state transitions.

A transition is an expression over the rows it concerns, with the time given;
mutual exclusion of a stage is Spark's (one query for each stage)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ATTEMPTS, DONE_TTL_MS, ERROR_PAGE, ITEMS_PAGE, PAYLOAD_CHARS, PREVIEW_CHARS, PUBLISH_NOW, QUEUE_PREVIEW, SETTLE_MS, STAGES
from ..functions.dates import backoff, settle_bucket
from ..functions.text import ref_of
from .graph import checkpoints


def _set(rows: DataFrame, where: Column, **values) -> DataFrame:
    on = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(on, v).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in rows.columns])


def waiting(items: DataFrame, stage: str, limit: int = QUEUE_PREVIEW) -> DataFrame:
    rows = items.where((F.col("stage") == stage) & F.col("status").isin("pending", "running"))
    return rows.orderBy("runAt", "id").limit(limit)


def item_list(items: DataFrame, stage: str | None = None, status: str | None = None, limit: int = ITEMS_PAGE) -> DataFrame:
    for name, value in (("stage", stage), ("status", status)):
        if value is not None:
            items = items.where(F.col(name) == value)
    return items.orderBy(F.desc("createdAt"), "id").limit(limit)


def due(items: DataFrame, stage: str, now_ms: int, limit: int) -> DataFrame:
    rows = items.where((F.col("stage") == stage) & (F.col("status") == "pending") & (F.col("runAt") <= now_ms))
    return rows.orderBy("runAt", "id").limit(limit)


def claim(items: DataFrame, stage: str, now_ms: int, lease_until: int, limit: int) -> DataFrame:
    """All items, with the due ones of the stage running under a lease."""
    chosen = due(items, stage, now_ms, limit).select("id", F.lit(True).alias("_mine"))
    rows = items.join(chosen, "id", "left")
    return _set(rows, F.col("_mine"), status=F.lit("running"), startedAt=F.lit(now_ms), leaseUntil=F.lit(lease_until)).drop("_mine").select(items.columns)


def expired_leases(items: DataFrame, now_ms: int) -> DataFrame:
    return items.where((F.col("status") == "running") & (F.col("leaseUntil") < now_ms))


def _attempts() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ATTEMPTS.items() for x in kv]), F.col("stage"))


def settle(items: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Items after a round.  outcomes: id, ok, error, cause.  Success is done for
    seven days; failure backs off, or is an error after the stage's attempts."""
    o = outcomes.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_error"), F.left(F.col("cause"), F.lit(2000)).alias("_cause"))
    rows = items.join(o, "id", "left")
    ok, bad = F.col("_ok"), ~F.col("_ok")
    tries = F.col("retryCount") + 1
    final = tries >= _attempts()
    ttl = F.timestamp_millis(F.lit(now_ms + DONE_TTL_MS))
    none = F.lit(None)
    rows = _set(rows, ok, status=F.lit("done"), finishedAt=F.lit(now_ms), expireAt=ttl, leaseUntil=none, error=none, cause=none)
    rows = _set(
        rows, bad, status=F.when(final, "error").otherwise("pending"), error=F.col("_error"), cause=F.col("_cause"), leaseUntil=none,
        finishedAt=F.when(final, F.lit(now_ms)).otherwise(F.col("finishedAt")), runAt=F.when(final, F.col("runAt")).otherwise(F.lit(now_ms) + backoff(tries)), retryCount=tries,
    )
    return rows.select(items.columns)


def failure_audit(items: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    bad = outcomes.where(~F.col("ok")).select("id", F.col("error").alias("_e"), F.col("cause").alias("_c"))
    return items.join(bad, "id").select(F.lit("item").alias("kind"), "stage", F.col("id").alias("itemId"), ref_of("raw").alias("ref"), F.col("_e").alias("error"), F.col("_c").alias("cause"), F.lit(now_ms).alias("at"))


def reclaim(items: DataFrame, now_ms: int) -> DataFrame:
    """A running item past its lease is one failed attempt."""
    lost = expired_leases(items, now_ms).select("id", F.lit(False).alias("ok"), F.lit("the lease ran out before the work was finished").alias("error"), F.lit(None).cast("string").alias("cause"))
    return settle(items, lost, now_ms)


def drain(items: DataFrame, controls: DataFrame, stage: str, run: Callable[[DataFrame], DataFrame], clock: Callable[[], int], concurrency: int = 5, lease_ms: int = 300_000) -> tuple[DataFrame, DataFrame, int]:
    """(items, controls, how many ran) after a stage has run its due items, `concurrency`
    at a time, until none is due, a paused stage's budget is spent or half the lease
    is over.  run: claimed items to outcomes (id, ok, error, cause); each round is a
    checkpoint, so that its work is done once."""
    checkpoints(items.sparkSession)
    start, ran = clock(), 0
    (control,) = read_controls(controls).where(F.col("stage") == stage).collect()
    left = control.budget if control.paused else math.inf
    while left > 0 and (now := clock()) < start + lease_ms // 2:
        claimed = claim(items, stage, now, start + lease_ms, min(concurrency, left)).checkpoint()
        mine = claimed.where((F.col("stage") == stage) & (F.col("status") == "running") & (F.col("startedAt") == now) & (F.col("leaseUntil") == start + lease_ms))
        n = mine.count()
        if not n:
            break
        items = settle(claimed, run(mine).checkpoint(), clock()).checkpoint()
        left, ran = left - n, ran + n
    if control.paused and ran:
        spent = F.when(F.col("stage") == stage, F.col("budget") - ran).otherwise(F.col("budget"))
        controls = read_controls(controls).withColumn("budget", spent)
    return items, controls, ran


def restart(items: DataFrame, ids: DataFrame, run_at: int, statuses: tuple[str, ...] = ("error",)) -> DataFrame:
    """The named items pending again from the beginning."""
    rows = items.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    none, on = F.lit(None), F.col("_hit") & F.col("status").isin(*statuses)
    fresh = on & (F.col("status") == "error")
    rows = rows.withColumn("_fresh", fresh).withColumn("_on", on)
    rows = _set(rows, F.col("_fresh"), status=F.lit("pending"), retryCount=F.lit(0), error=none, cause=none, diagnosis=none, finishedAt=none)
    return _set(rows, F.col("_on"), runAt=F.lit(run_at)).select(items.columns)


def run_item_now(items: DataFrame, id: str) -> DataFrame:
    return restart(items, items.where(F.col("id") == id), 0, ("pending", "error"))


def replay_errors(items: DataFrame, most: int, now_ms: int) -> DataFrame:
    return restart(items, errors(items, most).select("id"), now_ms)


def run_now(items: DataFrame, stage: str, now_ms: int, limit: int | None = None) -> DataFrame:
    """The oldest pending items of a stage are due now."""
    order = Window.partitionBy("stage", "status").orderBy("runAt", "id")
    if limit is None:
        return _set(items, (F.col("stage") == stage) & (F.col("status") == "pending") & (F.col("runAt") > now_ms), runAt=F.lit(now_ms))
    first = items.where((F.col("stage") == stage) & (F.col("status") == "pending")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    rows = items.join(first.select("id", F.lit(True).alias("_hit")), "id", "left")
    return _set(rows, F.col("_hit") & (F.col("runAt") > now_ms), runAt=F.lit(now_ms)).select(items.columns)


def set_paused(controls: DataFrame, stage: str, paused: bool, now_ms: int) -> DataFrame:
    from .tables import put

    row = controls.sparkSession.createDataFrame([(stage, paused, 0, now_ms)], controls.schema)
    return put(controls, row, "stage")


def read_controls(controls: DataFrame) -> DataFrame:
    """One row for each stage, not paused by default."""
    every = controls.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    rows = every.join(controls, "stage", "left")
    return rows.select("stage", F.coalesce("paused", F.lit(False)).alias("paused"), F.coalesce("budget", F.lit(0).cast("long")).alias("budget"), "requestedAt")


def errors(items: DataFrame, limit: int = ERROR_PAGE) -> DataFrame:
    """Failed items, oldest first; those without a finish time drop out."""
    return items.where((F.col("status") == "error") & F.col("finishedAt").isNotNull()).orderBy("finishedAt", "id").limit(limit)


def discard_errors(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce(F.col("status") != "error", F.lit(True)))


def save_raw(items: DataFrame, id: str, raw: str) -> DataFrame:
    """A new payload, only for a waiting or failed item."""
    return _set(items, (F.col("id") == id) & F.col("status").isin("pending", "error"), raw=F.lit(raw))


def save_diagnosis(items: DataFrame, id: str, summary: str, cause: str, fix: str, now_ms: int) -> DataFrame:
    told = F.struct(F.lit(summary).alias("summary"), F.lit(cause).alias("cause"), F.lit(fix).alias("fix"), F.lit(now_ms).cast("long").alias("at"))
    return _set(items, (F.col("id") == id) & (F.col("status") == "error"), diagnosis=told)


def diagnosis_reports(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "error").select("id", "stage", F.coalesce("error", F.lit("")).alias("error"), "cause", F.col("retryCount").alias("attempts"), F.left(F.col("raw"), F.lit(PAYLOAD_CHARS)).alias("payload"))


def previews(items: DataFrame) -> DataFrame:
    """What the console lists: reference, first characters of title or body."""
    part = lambda p: F.nullif(F.get_json_object("raw", p), F.lit(""))
    text = F.substring(F.coalesce(part("$.title"), part("$.body"), F.lit("")), 1, PREVIEW_CHARS)
    return items.select("id", "stage", "status", "runAt", "retryCount", "error", ref_of("raw").alias("ref"), text.alias("text"), "createdAt", "finishedAt", "cause", "diagnosis")


def enqueue(stage: str, payloads: DataFrame, now_ms: int, delay_ms: int = 0) -> DataFrame:
    """Pending rows of id and raw."""
    return payloads.select("id", F.lit(stage).alias("stage"), F.lit("pending").alias("status"), "raw", F.lit(0).cast("long").alias("retryCount"), F.lit(now_ms + delay_ms).cast("long").alias("runAt"), F.lit(now_ms).cast("long").alias("createdAt"))


def publish_requests(changes: DataFrame) -> DataFrame:
    """One publish item for each message and five-minute window, 300 s later.
    changes: message, at (epoch ms)."""
    rows = changes.withColumn("bucket", settle_bucket("at")).groupBy("message", "bucket").agg(F.min("at").alias("at"))
    return rows.select(F.sha1(F.concat("message", F.lit("@"), F.col("bucket").cast("string"))).alias("id"), "message", (F.col("at") + SETTLE_MS).alias("runAt"))


def pending_publish(messages: DataFrame, most: int = PUBLISH_NOW) -> DataFrame:
    from .tables import messages_by_status

    return messages_by_status(messages, "topublish", min(most, PUBLISH_NOW)).select("id")
