"""Named queries for table writes, checks and small texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import match, text
from ..operators import captions, console, dashboard, grid, publish, stories, tables, work
from ..streaming import flows
from . import views
from .console import _fetches
from .queries import query

NEW = 10_000_000  # added to a key that is to be unknown


def _people(spark, sf):
    return views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))


def _events(spark, sf):
    return views.load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))


# -- table writes


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS n FROM customer
UNION ALL SELECT c_custkey + {NEW}, 'new', NULL FROM customer WHERE c_custkey % 3 = 0""")
def put_rows(spark, sf):
    p = _people(spark, sf)
    third = p.where("id % 3 = 0").select("id", F.lit("new").alias("name"), F.lit(None).cast(p.schema["n"].dataType).alias("n"))
    return tables.put(p, third.unionByName(third.withColumn("id", F.col("id") + NEW)))


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey + {NEW}, 'new' FROM customer WHERE c_custkey % 2 = 1")
def put_absent_rows(spark, sf):
    """Half of the rows have a known key; every row comes twice."""
    p = _people(spark, sf).drop("n")
    rows = p.select((F.col("id") + F.when(F.col("id") % 2 == 1, NEW).otherwise(0)).alias("id"), F.lit("new").alias("name"))
    return tables.put_absent(p, rows.unionByName(rows))


@query(f"WITH {views.SOURCES_SQL} SELECT id, status FROM sources WHERE status = 'paused'")
def paused_sources(spark, sf):
    return tables.by_status(views.sources(spark, sf), "paused").select("id", "status")


@query(f"WITH {views.MESSAGES_SQL} SELECT id, ts, title FROM messages WHERE status = 'topublish' ORDER BY ts DESC, id LIMIT 50")
def newest_messages(spark, sf):
    return tables.messages_by_status(views.messages(spark, sf), "topublish", 50).select("id", "ts", "title")


@query(f"WITH {views.MESSAGES_SQL} SELECT id FROM messages WHERE status = 'topublish' ORDER BY ts DESC, id LIMIT 10")
def pending_publish(spark, sf):
    return work.pending_publish(views.messages(spark, sf))


@query(f"WITH {views.KEYS_SQL} SELECT keys.id, array_to_string(e, '|') AS entities, array_to_string(t, '|') AS title_tokens, array_to_string(g, '|') AS tags, title FROM keys JOIN items USING (id) WHERE keys.date = '2024-01-05' AND seq % 5 <> 0")
def day_candidates(spark, sf):
    rows = stories.with_key(views.items(spark, sf))
    stored = rows.select("id", "date", "title", F.col("key.entities").alias("keyEntities"), F.col("key.titleTokens").alias("keyTitle"), F.col("key.tags").alias("keyTags"), F.array("id").alias("memberIds"), F.lit(1).alias("memberCount"), (F.col("seq") % 5 == 0).alias("deleted"))
    return tables.candidates_of(stored, "2024-01-05").select("id", *[F.array_join(c, "|").alias(n) for c, n in (("keyEntities", "entities"), ("keyTitle", "title_tokens"), ("keyTags", "tags"))], "title")


@query("SELECT id, c_name AS name FROM (VALUES ('7'), ('3'), ('no'), ('7')) v(id) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = id")
def picked_names(spark, sf):
    p = _people(spark, sf).select(F.col("id").cast("string").alias("id"), "name")
    return tables.pick_in_order(p, ["7", "3", "no", "7"], "name")


@query("""SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS "memberCount", CASE WHEN c_custkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS "memberIds", CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS b FROM customer""")
def merged_members(spark, sf):
    p = _people(spark, sf)
    m = p.select("id", F.create_map(F.lit("a"), F.col("name"), F.lit("b"), F.lit("old")).alias("members"), F.lit(2).cast("long").alias("memberCount"), F.array(F.lit("a"), F.lit("b")).alias("memberIds"))
    merges = p.where("id % 2 = 0").select("id", F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("new")).alias("members"))
    return tables.merge_members(m, merges).select("id", "memberCount", F.array_join("memberIds", ",").alias("memberIds"), F.col("members")["b"].alias("b"))


@query("SELECT count(*) FILTER (c_custkey % 4 <> 0) AS written, count(*) FILTER (c_custkey % 4 = 0) AS deleted FROM customer")
def synced_counts(spark, sf):
    p = _people(spark, sf)
    _, written, deleted = tables.sync(p, p.where("id % 4 <> 0"))
    return spark.createDataFrame([(written, deleted)], "written long, deleted long")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0")
def fresh_candidates(spark, sf):
    p = _people(spark, sf)
    return stories.fresh_candidates(p, p.where("id % 3 = 0")).select("id")


# -- queue


@query(f"""WITH {views.WORK_SQL}, w AS (SELECT *, CAST(id AS BIGINT) % 4 = 0 AS named FROM work)
SELECT id, CASE WHEN named AND status = 'error' THEN 'pending' ELSE status END AS status, CAST(CASE WHEN named AND status = 'error' THEN 0 ELSE retryCount END AS BIGINT) AS "retryCount",
  CASE WHEN named AND status IN ('pending', 'error') THEN 0 ELSE runAt END AS "runAt", CASE WHEN NOT (named AND status = 'error') THEN finishedAt END AS "finishedAt" FROM w""")
def restarted_items(spark, sf):
    w = views.work_items(spark, sf)
    return work.restart(w, w.where(F.col("id").cast("long") % 4 == 0), 0, ("pending", "error")).select("id", "status", "retryCount", "runAt", "finishedAt")


@query(f"""WITH {views.WORK_SQL} SELECT id, stage, '' AS error, CAST(retryCount AS BIGINT) AS attempts, '{{"id": "' || ref || '", "title": "' || text || '"}}' AS payload FROM work WHERE status = 'error'""")
def diagnosis_reports(spark, sf):
    return work.diagnosis_reports(views.work_items(spark, sf)).select("id", "stage", "error", "attempts", "payload")


@query(f"WITH {views.WORK_SQL} SELECT id, text, (SELECT count(*) FROM work WHERE status = 'error') AS total FROM work WHERE status = 'error' ORDER BY finishedAt, id LIMIT 50")
def errors_with_total(spark, sf):
    return dashboard.errors_page(views.work_items(spark, sf)).select("id", "text", "total")


@query(f"WITH {views.FACTS_SQL} SELECT * FROM facts")
def hourly_counters(spark, sf):
    """The stream's windows over a finished table."""
    f = views.facts(spark, sf)
    return flows.hourly_counters(f.select(F.timestamp_millis("at").alias("ts"), "name", "by", "value"))


# -- stories


@query(f"""WITH {views.ITEMS_SQL} SELECT a.id AS item, CASE WHEN b.id < a.id THEN b.id ELSE a.id END AS story FROM items a LEFT JOIN items b ON b.seq = a.seq - 28""")
def replay_matches(spark, sf):
    """Every story holds its item and that of four weeks later, of the same date."""
    i = views.items(spark, sf).select("id", "seq", "date")
    later = F.concat(F.lit("web/"), (F.col("seq") + 28).cast("string"))
    return stories.replay_match(i, i.select("id", "date", F.array("id", later).alias("memberIds")))


_UNION = "array_to_string(list_sort(list_distinct(list_concat(a.{0}, b.{0})))[1:256], '|')"


@query(f"WITH {views.KEYS_SQL} SELECT a.id, {_UNION.format('e')} AS entities, {_UNION.format('t')} AS title_tokens, {_UNION.format('g')} AS tags FROM keys a JOIN keys b ON CAST(substr(b.id, 5) AS BIGINT) = CAST(substr(a.id, 5) AS BIGINT) + 1")
def united_keys(spark, sf):
    k = stories.with_key(views.items(spark, sf)).select("id", "seq", "key")
    both = k.join(k.select((F.col("seq") - 1).alias("seq"), F.col("key").alias("other")), "seq")
    u = both.select("id", match.union_keys("key", "other").alias("u"))
    return u.select("id", F.array_join("u.entities", "|").alias("entities"), F.array_join("u.titleTokens", "|").alias("title_tokens"), F.array_join("u.tags", "|").alias("tags"))


# -- checks and texts


@query("SELECT CAST(event_id AS VARCHAR) AS id, n FROM events, (VALUES (1), (2)) v(n) WHERE event_id % 10 = 9")
def settled_entries(spark, sf):
    """Both entries of a repeated video count."""
    videos, _ = _fetches(spark, sf)
    playlist = videos.select(F.col("id").alias("videoId"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return captions.settled_entries(playlist, videos).select(F.col("videoId").alias("id"), "n")


@query("SELECT c_custkey AS id, c_custkey % 5 <> 0 AND c_custkey % 4 IN (1, 2) AS may FROM customer")
def allowed_edits(spark, sf):
    """Roles: none known, editor, admin beside one unknown, viewer; a fifth is disabled."""
    roles = F.when(F.col("id") % 4 == 0, F.array(F.lit("x"))).when(F.col("id") % 4 == 1, F.array(F.lit("editor"))).when(F.col("id") % 4 == 2, F.array(F.lit("x"), F.lit("admin"))).otherwise(F.array(F.lit("viewer")))
    return _people(spark, sf).select("id", dashboard.allowed(F.col("id") % 5 != 0, roles, "editor").alias("may"))


@query("""SELECT event_id AS id, event_type AS message, CASE event_id % 3 WHEN 0 THEN 'c' || chr(10) || 'd' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'c' ELSE left(repeat(event_type, 600), 2000) END AS cause FROM events""")
def described_errors(spark, sf):
    """Six causes, none, or no list; stacks longer than what is kept."""
    six = F.array(*[F.lit(c) for c in "cdcdcd"])
    causes = F.when(F.col("id") % 3 == 0, six).when(F.col("id") % 3 == 1, F.array().cast("array<string>"))
    told = console.describe_error("name", causes, F.repeat("name", F.lit(600)))
    return _events(spark, sf).select("id", told.alias("t")).select("id", "t.message", "t.cause")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Unauthorized (check the token of the bot)' WHEN 1 THEN 'Bad Request: chat not found (is @x public, and does the bot belong to it?)' WHEN 2 THEN 'Too Many Requests' ELSE 'Not Found (check the token of the bot)' END AS said FROM events""")
def explained_failures(spark, sf):
    k = F.col("id") % 4
    status = F.when(k == 0, 401).when(k == 1, 400).when(k == 2, 429).otherwise(404)
    said = F.when(k == 0, "Unauthorized").when(k == 1, "Bad Request: chat not found").when(k == 2, "Too Many Requests").otherwise("Not Found")
    return _events(spark, sf).select("id", publish.explanation(status, said, F.lit("@x")).alias("said"))


@query("SELECT event_id AS id, array_to_string(list_filter(['low ' || (event_id % 3), 'nobody ' || (event_id % 2)], lambda x: NOT ends_with(x, ' 0')), ' · ') AS note, 'a' || event_type AS said FROM events")
def notes_and_blocks(spark, sf):
    counts = F.create_map(F.lit("low"), F.col("id") % 3, F.lit("nobody"), F.col("id") % 2)
    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    blocks = F.array(block("text", F.lit("a")), block("image", F.lit("b")), block("text", F.lit(None).cast("string")), block("text", F.col("name")))
    return _events(spark, sf).select("id", text.split_note(counts).alias("note"), text.extract_text(blocks).alias("said"))


@query("SELECT event_id AS id, event_id % 3 <> 0 AND event_id % 2 = 1 AS everything FROM events")
def selected_rows(spark, sf):
    pick = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    visible, selected = F.when(F.col("id") % 3 == 0, pick()).otherwise(pick("a", "b")), F.when(F.col("id") % 2 == 1, pick("c", "b", "a")).otherwise(pick("a"))
    return _events(spark, sf).select("id", grid.all_selected(selected, visible).alias("everything"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'telegram' END AS type, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 0 END AS BIGINT) AS "lastCount", '' AS "lastItemId" FROM supplier""")
def defaulted_sources(spark, sf):
    s = views.load(spark, sf, "supplier").withColumn("id", F.col("s_suppkey"))
    rows = s.select("id", F.when(F.col("id") % 2 == 0, "rss").alias("type"), F.when(F.col("id") % 3 == 0, F.col("s_nationkey").cast("long")).alias("lastCount"), F.lit(None).cast("string").alias("lastItemId"))
    return schemas.with_defaults(rows, "sources")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0")
def broken_messages(spark, sf):
    """Wrong countries, ids, dates and counts."""
    k = F.col("id")
    m = _people(spark, sf).select(
        k.alias("key"), F.concat(F.when(k % 7 == 0, "web-").otherwise("web/"), k.cast("string")).alias("id"), F.when(k % 11 == 0, "soon").otherwise("2024-01-05").alias("date"),
        F.when(k % 5 == 0, "ua").when(k % 2 == 0, "UA").alias("country"), F.create_map(F.lit("a"), F.lit("b")).alias("members"), F.when(k % 13 == 0, 2).otherwise(1).alias("memberCount"),
    )
    return schemas.violations(m).select("key")
