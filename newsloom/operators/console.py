"""Actions of the console and of agents, and the composed scrape run.

Every action returns the new table (or what it tells); the caller writes it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import AUDIT_TTL_MS, MESSAGE_STATUSES, STAGES
from ..contracts import payload_problems
from ..functions.dates import date_key, iso_timestamp
from ..functions.text import canonical_id, col, csv_cell, forward_origin, normalize_tag, trim
from . import items as stage_one
from . import tables, work
from .items import live

#: What a stage's payload must hold, as JSON paths.
REQUIRED = {"analyze": ("id", "body", "date"), "aggregate": ("id", "title", "summary", "date"), "publish": ("messageId",)}
CAUSE_CHARS = 2000


# -- reads


def video_statuses(videos: DataFrame) -> DataFrame:
    """Every video's status, without its transcript."""
    return videos.select("id", "status")


def audit_keys(audit: DataFrame, ids: DataFrame) -> DataFrame:
    """Where and when sends of the named messages failed."""
    return audit.join(ids.select(F.col("id").alias("messageId")).distinct(), "messageId", "left_semi").select("messageId", "target", "at")


def item_search(items: DataFrame, text: str) -> DataFrame:
    """Item previews whose reference, text or error holds the text, whatever the case."""
    rows, needle = work.previews(items), text.strip().lower()
    if not needle:
        return rows
    found = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle)) for c in ("ref", "text", "error")]
    return rows.where(found[0] | found[1] | found[2])


def all_status_messages(messages: DataFrame) -> DataFrame:
    """List rows of every status, newest first."""
    rows = messages.where((F.col("deleted") == F.lit(False)) & F.col("status").isin(*MESSAGE_STATUSES))
    return rows.drop("members", "keyEntities", "keyTitle", "keyTags", "posts", "tgChannel").orderBy(F.desc("ts"), "id")


def whoami(users: DataFrame, email: str) -> DataFrame:
    """The user's row, without one a disabled user without roles."""
    want = users.sparkSession.createDataFrame([(email,)], "email string").join(users, "email", "left")
    return want.select("email", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def pipeline_nodes(stages: DataFrame, depth: DataFrame | None, controls: DataFrame | None) -> DataFrame:
    """Stages in their order with what waits there; unread numbers are null, not 0.
    stages: pos, stage, queue (null where a stage has none)."""
    rows = stages.withColumn("arrow", F.col("pos") > 0)
    if depth is None:
        rows = rows.withColumn("queued", F.lit(None).cast("long"))
    else:
        rows = rows.join(depth.select(F.col("stage").alias("queue"), F.col("n").alias("queued")), "queue", "left")
    if controls is None:
        rows = rows.withColumn("paused", F.lit(False))
    else:
        rows = rows.join(controls.select(F.col("stage").alias("queue"), "paused"), "queue", "left").withColumn("paused", F.coalesce("paused", F.lit(False)))
    return rows.select("pos", "stage", "queue", "arrow", "queued", "paused")


def polled_text(next_run, due_at, now_ms: int) -> Column:
    due = F.concat(F.lit("due "), F.date_format(F.timestamp_millis(col(due_at)), "HH:mm"))
    return F.when(col(next_run), "next run").when(col(due_at) <= now_ms, "after the next run").otherwise(due)


def due_text(status, run_at) -> Column:
    due = F.concat(F.lit("due "), F.date_format(F.timestamp_millis(col(run_at)), "HH:mm"))
    return F.when(col(status) == "running", "running").when(col(run_at) == 0, "first in the queue").otherwise(due)


def queue_rows(items: DataFrame) -> DataFrame:
    """Queue items as the console shows them."""
    failed = F.when(F.col("retryCount") > 0, F.concat(F.lit("failed "), F.col("retryCount").cast("string"), F.lit(" times")))
    ref = F.coalesce(F.nullif(F.col("ref"), F.lit("")), F.col("id"))
    return work.previews(items).select("id", ref.alias("ref"), "text", F.concat_ws(" · ", due_text("status", "runAt"), failed).alias("meta"), F.coalesce("error", F.lit("")).alias("error"), (F.col("status") == "pending").alias("canRun"))


def failure_total(overview: DataFrame) -> DataFrame:
    """Failed items and failing sources of an overview row."""
    return overview.select((F.coalesce("errors", F.lit(0)) + F.coalesce("failingSources", F.lit(0))).alias("failures"))


# -- text and files


def describe_error(message, causes, stack) -> Column:
    """(message, cause): the cause chain, at most five deep, else the stack, cut."""
    chain = F.array_join(F.slice(F.coalesce(col(causes), F.array().cast("array<string>")), 1, 5), "\n")
    return F.struct(col(message).alias("message"), F.left(F.when(chain != "", chain).otherwise(col(stack)), F.lit(CAUSE_CHARS)).alias("cause"))


def export_name(table: str, now_ms: int) -> Column:
    return F.concat(F.lit(f"{table}-"), date_key(F.lit(now_ms)), F.lit(".csv"))


def csv_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(pos, line): the header line at 0, then a line for each row in order."""
    text = lambda c: F.array_join(c, ",") if rows.schema[c].dataType.typeName() == "array" else F.col(c)
    body = rows.select(F.col(order).alias("_order"), F.concat_ws(",", *[csv_cell(text(c)) for c in columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, ",".join(columns))], "pos int, line string").select(F.lit(None).cast(body.schema["_order"].dataType).alias("_order"), "pos", "line")
    return head.unionByName(body.withColumn("pos", F.lit(1))).orderBy("pos", "_order").select("pos", "line")


def seed_text(rows: list[dict]) -> str:
    """A snapshot as a seed file holds it: indented JSON and a final line break."""
    return json.dumps(rows, indent=2, ensure_ascii=False, sort_keys=True) + "\n"


def transcript_files(videos: DataFrame, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, transcript) of fetched videos, and the videos with those that an
    archive already holds marked as absorbed."""
    files = videos.where(live() & (F.col("status") == "fetched")).select(F.concat("id", F.lit(".md")).alias("name"), "transcript")
    hit = videos.join(archived.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    done = F.when(F.col("_hit") & (F.col("status") == "fetched"), "absorbed").otherwise(F.col("status"))
    return files, hit.withColumn("status", done).select(videos.columns)


def channel_posts(messages: DataFrame) -> DataFrame:
    """Chat messages (source_id, id, text, spans, at, forwarded, fromName, fromPeer)
    as channel posts: links numbered, text trimmed, origin named, time in ISO form."""
    from ..functions.spans import tokenise_links

    rows = messages.withColumn("_t", tokenise_links("text", "spans"))
    return rows.select("source_id", F.col("id").cast("string").alias("id"), trim("_t.body").alias("body"), F.col("_t.links").alias("links"), forward_origin("forwarded", "fromName", "fromPeer").alias("forwardedFrom"), iso_timestamp("at").alias("postedAt"))


# -- checks


def tag_id(c) -> Column:
    """A normalised tag; empty ones and lists are an error."""
    tag = normalize_tag(c)
    return F.when((tag != "") & ~F.contains(tag, F.lit(",")), tag).otherwise(F.raise_error(F.concat(F.lit("expected one tag: "), F.coalesce(col(c), F.lit("null")))).cast("string"))


def payload_problem(stage, raw) -> Column:
    """Why a stage cannot work on a payload; null if it can."""
    parsed = F.try_parse_json(col(raw))
    missing = {s: [F.when(F.coalesce(F.get_json_object(col(raw), f"$.{f}"), F.lit("")) == "", F.lit(f)) for f in fields] for s, fields in REQUIRED.items()}
    named = F.lit(None).cast("string")
    for s, tests in missing.items():
        named = F.when(col(stage) == s, F.concat_ws(", ", *tests)).otherwise(named)
    return F.when(parsed.isNull() | ~F.startswith(trim(raw), F.lit("{")), "no object").when(named.isNull(), "no stage").when(named != "", F.concat(F.lit("missing "), named))


def check_input(fields: dict, known: dict[str, type], required: tuple[str, ...] = ()) -> dict:
    """An action's input: unknown, missing or mistyped fields are a ValueError."""
    problems = [f"unknown {k}" for k in sorted(set(fields) - set(known))] + [f"missing {k}" for k in required if k not in fields]
    problems += [f"{k} is no {known[k].__name__}" for k in sorted(set(fields) & set(known)) if not isinstance(fields[k], known[k]) or (known[k] is int and isinstance(fields[k], bool))]
    if problems:
        raise ValueError("bad input: " + ", ".join(problems))
    return fields


# -- writes


def upsert(table: str, base: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after edits (id and the edited columns): a known row is patched; an
    unknown one is added with its defaults, but a message, which is an error; a tag that
    was deleted starts over, without what it had."""
    schemas.check_writable(table, [c for c in changes.columns if c != "id"])
    if table == "messages":
        lost = changes.select("id").join(base.select("id"), "id", "left_anti").first()
        if lost:
            raise ValueError(f"no such message: {lost.id}")
    if table == "tags":
        again = base.where(~live()).join(changes.select("id"), "id", "left_semi").select("id")
        base = base.join(again, "id", "left_anti")
    known = base.select("id", F.lit(True).alias("_known"))
    rows = tables.patch(base, changes)
    fresh = schemas.with_defaults(rows.join(known, "id", "left_anti"), table)
    return rows.join(known, "id", "left_semi").select(base.columns).unionByName(fresh.select(base.columns))


def edit_item(items: DataFrame, id: str, raw: str) -> DataFrame:
    """Items with a new payload for a waiting or failed one, once its stage can work on
    it; else an error that says why."""
    found = items.where(F.col("id") == id).select("status", payload_problems("stage", F.lit(raw)).alias("problems")).first()
    if found is None:
        raise ValueError(f"no such item: {id}")
    if found.problems:
        raise ValueError(f"{id}: {', '.join(found.problems)}")
    if found.status not in ("pending", "error"):
        raise ValueError(f"{id} is no longer waiting or failed")
    return work.save_raw(items, id, raw)


def reset_ingest(items: DataFrame) -> tuple[DataFrame, int]:
    """No items, and how many there were; controls stay."""
    return items.limit(0), items.count()


def reset_cursors(sources: DataFrame) -> DataFrame:
    """Every live source due now, from its oldest post."""
    new = {"lastItemId": F.lit(""), "lastUpdated": F.lit(0).cast("long"), "zeroYieldRuns": F.lit(0).cast("long")}
    return sources.select(*[F.when(live(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sources.columns])


def republish(messages: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The messages with the named ones to be published again, and their publish
    requests; a missing or deleted one is an error."""
    found = ids.select("id").distinct().join(messages.where(live()).select("id", F.lit(True).alias("_live")), "id", "left")
    lost = found.where("_live is null").select("id").first()
    if lost:
        raise ValueError(f"no such message: {lost.id}")
    rows = tables.patch(messages, found.select("id", F.lit("topublish").alias("status"), F.lit(now_ms).cast("long").alias("ts")))
    return rows, work.publish_requests(found.select(F.col("id").alias("message"), F.lit(now_ms).cast("long").alias("at")))


def released(items: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """How many items a run-now of a stage releases."""
    rows = items.where((F.col("stage") == stage) & (F.col("status") == "pending"))
    return (rows.orderBy("runAt", "id").limit(limit) if limit is not None else rows).agg(F.count("*").alias("released"))


def step_budget(controls: DataFrame, stage: str, released: int, now_ms: int) -> DataFrame:
    """Controls after a run-now: a paused stage may run exactly what was released."""
    rows = work.read_controls(controls)
    mine = F.col("stage") == stage
    budget = F.when(mine & F.col("paused"), F.col("budget") + released).otherwise(F.col("budget"))
    return rows.withColumn("budget", budget).withColumn("requestedAt", F.when(mine, F.lit(now_ms).cast("long")).otherwise(F.col("requestedAt")))


def may_run(controls: DataFrame) -> DataFrame:
    """Stages that may take an item: not paused, or with budget left."""
    return work.read_controls(controls).where(~F.col("paused") | (F.col("budget") > 0)).select("stage")


def last_posts(targets: DataFrame, sent: DataFrame) -> DataFrame:
    """Targets with their last post recorded; unknown ones are created.  sent:
    target, message, at; the newest counts."""
    last = sent.groupBy(F.col("target").alias("id")).agg(F.max(F.struct("at", "message")).alias("m"))
    return tables.patch(targets, last.select("id", iso_timestamp("m.at").alias("lastPostedDate"), F.col("m.message").alias("lastPostedMessageId")))


def add_row(base: DataFrame, row: dict, defaults: dict) -> DataFrame:
    """An agent's new source or target: its canonical id must be free."""
    spark = base.sparkSession
    one = spark.createDataFrame([({**defaults, **row}.get("id"),)], "id string").select(canonical_id("id").alias("id"))
    values = {**defaults, **row}
    cells = [F.col("id") if f.name == "id" else (F.array(*[F.lit(x) for x in values[f.name]]) if isinstance(values.get(f.name), list) else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in base.schema]
    return tables.put_new(base, one.select(*cells))


def add_source(sources: DataFrame, row: dict) -> DataFrame:
    known = {"id": str, "status": str, "category": str, "tags": list, "teaser": str, "type": str}
    return add_row(sources, check_input(row, known, ("id",)), {"status": "ok", "type": "telegram"})


def add_target(targets: DataFrame, row: dict) -> DataFrame:
    known = {"id": str, "type": str, "messageTemplate": str, "tags": list}
    return add_row(targets, check_input(row, known, ("id",)), {"type": "telegram"})


# -- runs


def scrape_run(posts: DataFrame, sources: DataFrame, refused: DataFrame, date: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One scrape of the polled sources: (items for analyze, sources after it, totals).

    refused: id of items whose enqueue failed.  A source with one keeps its cursor
    and notes the failure, the others go on; only posts are sent, whatever was read
    counts as processed."""
    scraped = stage_one.to_items(posts, sources, date, now_ms)
    sent = scraped.where(F.col("kind") == "post")
    failed = sent.join(refused.select("id"), "id", "left_semi").select(F.substring_index("id", "/", 1).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("lost"))
    expected = sent.groupBy(F.substring_index("id", "/", 1).alias("source_id")).agg(F.count("*").alias("expected"))
    per = sources.select(F.col("id").alias("source_id")).join(expected, "source_id", "left").join(failed, "source_id", "left").fillna(0, ["expected", "lost"])
    moved = stage_one.cursors(posts, sources, now_ms).withColumnRenamed("id", "source_id").join(per, "source_id")
    error = F.concat(F.lit("enqueued "), (F.col("expected") - F.col("lost")).cast("string"), F.lit(" of "), F.col("expected").cast("string"), F.lit(" posts; the next run sends them again"))
    outcome = moved.select("source_id", (F.col("lost") > 0).alias("failed"), "lastItemId", "lastCount", "lastUpdated", "zeroYieldRuns", "lastNonZeroCount", "stale", F.when(F.col("lost") > 0, error).otherwise("").alias("lastError"), (F.col("expected") - F.col("lost")).alias("enqueued"))
    new = outcome.select(F.col("source_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("lastItemId", "lastCount", "lastUpdated", "zeroYieldRuns", "lastNonZeroCount", "lastError", "failed")])
    rows, kept = sources.join(new, "id", "left"), ("lastItemId", "lastCount", "lastUpdated", "zeroYieldRuns", "lastNonZeroCount")
    after = rows.select(*[F.when(F.col("_failed") == F.lit(False), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else (F.coalesce("_lastError", "lastError").alias(c) if c == "lastError" else F.col(c)) for c in sources.columns])
    totals = outcome.agg(F.coalesce(F.sum("lastCount"), F.lit(0)).alias("processed"), F.coalesce(F.sum("enqueued"), F.lit(0)).alias("enqueued"), F.count(F.when(F.col("failed"), 1)).alias("failed"), F.count(F.when(F.col("stale"), 1)).alias("stale"))
    return sent.join(refused.select("id"), "id", "left_anti"), after, totals


def attempt_numbers(log: DataFrame) -> DataFrame:
    """An attempt log (item, at, ok) with each attempt's number."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy("item").orderBy("at", "ok")).cast("long"))


@contextmanager
def audited_job(job: str, record, now_ms: int) -> Iterator[None]:
    """Runs a scheduled job; its failure is recorded (a row for the audit table is
    passed to `record`) and raised again."""
    try:
        yield
    except Exception as error:
        record({"kind": "job", "job": job, "error": str(error), "at": now_ms, "expireAt": now_ms + AUDIT_TTL_MS})
        raise


def stage_list(spark) -> DataFrame:
    """The pipeline's stages in their order, with the queue of each."""
    return spark.createDataFrame([(0, "scrape", None), *[(k, s, s) for k, s in enumerate(STAGES, 1)]], "pos int, stage string, queue string")
