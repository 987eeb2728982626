"""Named queries for publishing with posts, the queue's transitions, the console and
captions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAY_MS, DONE_TTL_MS
from ..functions import text
from ..functions.dates import clock, hour_bucket, is_date_key, iso_timestamp, settle_bucket
from ..functions.spans import clamp_summary
from ..operators import calibrate, captions, console, dashboard, grid, items, metrics, publish, stories, tables, work
from ..streaming import flows
from . import views
from .queries import _BLOCKS_SQL, _HEAD_SQL, _LINE_SQL, _keyed, query
from .views import NOW_MS, SCRAPE_MS

# -- publishing with posts


def _posted(spark, sf):
    """Messages of which some have a recorded post, some a legacy one."""
    m, k = views.messages(spark, sf), F.col("o_orderkey")
    post = F.struct(k.cast("string").alias("tgId"), (F.col("ts") + F.when(k % 8 == 0, 1).otherwise(-1)).alias("tgAt"))
    some = F.create_map(F.concat(F.lit("n"), (k % 25).cast("string")), post)
    m = m.withColumn("posts", F.when(k % 4 == 0, some).otherwise(F.col("posts")))
    m = m.withColumn("tgChannel", F.when(k % 4 == 1, F.concat(F.lit(" @n"), (k % 25).cast("string"), F.lit(", @other"))).otherwise(""))
    return m.withColumn("tgId", F.when(k % 4 == 1, F.concat(F.when(k % 3 == 0, "x").otherwise(""), k.cast("string")))).withColumn("tgAt", F.when(k % 8 == 1, F.col("ts")))


def _receivers(spark, sf):
    """Targets n0 to n24, that receive the messages with their own tag."""
    n = views.load(spark, sf, "nation")
    id = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return n.select(id.alias("id"), F.array(F.upper(F.concat(F.lit("p-"), (F.col("n_nationkey") % 5 + 1).cast("string")))).alias("tags"), F.when(F.col("n_nationkey") % 2 == 0, "{header} {country}{nothing}\n\n\n{body}\n{hashtags}").alias("messageTemplate"), F.lit(False).alias("deleted"))


_POSTED_SQL = f"""{views.MESSAGES_SQL},
posted AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'n' || (o_orderkey % 25) END AS recorded, ts + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE -1 END AS recordedAt,
  CASE WHEN o_orderkey % 4 = 1 THEN 'n' || (o_orderkey % 25) END AS legacy, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || o_orderkey AS legacyId, CASE WHEN o_orderkey % 8 = 1 THEN ts ELSE 0 END AS legacyAt FROM messages),
receivers AS (SELECT m.id AS message, 'n' || n_nationkey AS target, n_nationkey % 2 = 0 AS template FROM messages m JOIN nation ON list_contains(m.tags, 'p-' || (n_nationkey % 5 + 1))),
sent AS (SELECT r.*, p.*, CASE WHEN r.target = p.recorded THEN CAST(o_orderkey AS VARCHAR) WHEN r.target = p.legacy THEN legacyId END AS tg, CASE WHEN r.target = p.recorded THEN recordedAt WHEN r.target = p.legacy THEN legacyAt END AS tgat
  FROM receivers r JOIN posted p ON p.id = r.message)"""


@query(f"""WITH {_POSTED_SQL}, k AS (SELECT message, target FROM receivers UNION SELECT id, recorded FROM posted WHERE recorded IS NOT NULL UNION SELECT id, legacy FROM posted WHERE legacy IS NOT NULL)
SELECT k.message, k.target, CASE WHEN k.target = recorded THEN CAST(o_orderkey AS VARCHAR) WHEN k.target = legacy THEN legacyId END AS "tgId",
  'https://t.me/' || k.target || '/' || CASE WHEN k.target = recorded THEN CAST(o_orderkey AS VARCHAR) WHEN k.target = legacy THEN legacyId END AS url FROM k JOIN posted p ON p.id = k.message""")
def posted_rows(spark, sf):
    return publish.post_rows(_posted(spark, sf), _receivers(spark, sf))


@query(f"""WITH {_POSTED_SQL}, {_BLOCKS_SQL.split('messages AS', 1)[1].split('FROM orders),', 1)[1]}
SELECT id, target, CASE WHEN tg IS NOT NULL THEN 'editMessageText' WHEN image IS NOT NULL AND 2 * length(text) - length(replace(text, '🔘', '')) <= 1012 THEN 'sendPhoto' ELSE 'sendMessage' END AS method, md5(text) AS digest,
  CASE WHEN TRY_CAST(tg AS BIGINT) IS NULL AND tg IS NOT NULL THEN '"' || tg || '"' ELSE tg END AS message_id
FROM (SELECT sent.id, target, tg, image, CASE WHEN template THEN trim(regexp_replace(head || ' ' || coalesce(upper(country), '') || chr(10) || chr(10) || chr(10) || coalesce(body, '') || chr(10) || line, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')
    ELSE head || chr(10) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END || chr(10) || chr(10) || line END AS text
  FROM (SELECT *, {_HEAD_SQL} AS head, {_LINE_SQL} AS line FROM sent WHERE status = 'topublish' AND coalesce(tgat < ts, true)) sent LEFT JOIN blocks ON l_orderkey = o_orderkey)""")
def sends_with_posts(spark, sf):
    """Edits of stale posts, new sends, templates; current posts are left alone."""
    rows = publish.request(publish.sends(_posted(spark, sf), _receivers(spark, sf)))
    number = F.nullif(F.regexp_extract("body", r'"message_id":("?[^",]+"?)', 1), F.lit(""))
    return rows.select("id", "target", "method", F.md5("text").alias("digest"), number.alias("message_id"))


_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


@query(f"""WITH m AS (SELECT doc_id // 5 AS n, doc_id, '🔘 ' || {_ESCAPED.format('text')} || ' - <a href="https://t.me/d/' || doc_id || '">@d</a>' AS block FROM documents WHERE text IS NOT NULL),
p AS (SELECT n, doc_id, row_number() OVER w AS k, string_agg(block, chr(10)) OVER w AS body, sum(1 + {_UNITS.format('block')}) OVER w AS units FROM m WINDOW w AS (PARTITION BY n ORDER BY doc_id)),
s AS (SELECT n, max(k) AS most FROM p GROUP BY n),
f AS (SELECT p.n, p.k, p.body, most, 28 + units AS plain, '#date_2024_01_01 #ts_' || p.n AS tags FROM p JOIN s USING (n)),
c AS (SELECT n, body, tags, most, k, CASE WHEN k = most AND plain + 2 + length(tags) <= 4096 THEN 0 WHEN plain <= 4096 THEN 1 + most - k ELSE 100 - k END AS place FROM f),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY n ORDER BY CASE WHEN place < 50 THEN place ELSE 100 + k END) = 1)
SELECT n AS id, CAST(k AS BIGINT) AS members, md5('<b>⚡️</b> <i>2024-01-01</i>' || chr(10) || chr(10) || body || CASE WHEN place = 0 THEN chr(10) || chr(10) || '#date_2024_01_01 #ts_' || n ELSE '' END) AS digest FROM b""")
def fitted_texts(spark, sf):
    """Five documents a message: many texts pass the length limit."""
    d = views.load(spark, sf, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 5).cast("long").alias("n"), F.col("doc_id").alias("k"), "text")
    none = F.array().cast("array<struct<id: bigint, href: string>>")
    block = F.struct(F.col("text").alias("summary"), none.alias("links"), F.lit("d").alias("channel"), F.col("k").alias("ts"))
    m = d.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("d/"), F.col("k").cast("string")), block))).alias("members"))
    empty = F.lit(None).cast("string")
    m = m.select(F.col("n").alias("id"), "members", F.lit("2024-01-01").alias("date"), F.col("n").alias("ts"), *[empty.alias(c) for c in ("title", "country", "location", "peoples", "image", "messageTemplate")], F.array().cast("array<string>").alias("tags"), F.lit("t").alias("target"), F.lit(None).cast("struct<tgId: string, tgAt: bigint>").alias("post"))
    rows = publish.assemble(m)
    return rows.select("id", (F.size(F.split("text", "<a href=\"https://t.me/d/")) - 1).cast("long").alias("members"), F.md5("text").alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 2 = 0 END AS ok, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN event_id END AS "messageId",
  CASE WHEN event_id % 7 <> 0 AND event_id % 2 <> 0 AND event_id % 3 = 0 THEN CAST(user_id AS DOUBLE) END AS "retryAfter",
  CASE WHEN event_id % 7 = 0 OR event_id % 2 = 0 THEN NULL WHEN event_id % 3 = 0 THEN greatest(user_id * 1000.0, 3000.0) ELSE 60000.0 END AS pause FROM events""")
def send_answers(spark, sf):
    """Answers of the send API: envelopes, retry delays and pauses."""
    e = views.load(spark, sf, "events").select("event_id", "user_id")
    good = F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(F.col("event_id").alias("message_id")).alias("result")))
    slow = F.to_json(F.struct(F.lit(False).alias("ok"), F.lit("Too Many Requests").alias("description"), F.struct(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("retry_after")).alias("parameters")))
    body = F.when(F.col("event_id") % 7 == 0, '{"ok": "maybe"}').when(F.col("event_id") % 2 == 0, good).otherwise(slow)
    rows = e.withColumn("a", publish.envelope(body))
    delay = publish.retry_delay("a.retryAfter", F.lit(429))
    return rows.select("event_id", "a.ok", "a.messageId", "a.retryAfter", F.when(~F.col("a.ok"), publish.pause(delay)).alias("pause"))


@query(f"""WITH {views.MESSAGES_SQL}, r AS (SELECT 'web/' || l_orderkey AS message, 'n' || (l_suppkey % 5) AS target, (epoch_us(l_shipdate) // 1000) * 10 + l_linenumber AS ms, l_returnflag <> 'R' AS ok, l_suppkey, l_linenumber FROM lineitem),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY message, target ORDER BY ms DESC, ok DESC, CAST(l_suppkey AS VARCHAR) DESC) = 1),
d AS (SELECT message, count(*) FILTER (ok) AS posted, string_agg(CASE WHEN NOT ok THEN target || ' (sendMessage): refused' END, '; ' ORDER BY target) AS rejected FROM last GROUP BY message)
SELECT m.id, CASE WHEN m.status = 'topublish' AND rejected IS NULL THEN CASE WHEN coalesce(posted, 0) > 0 THEN 'published' ELSE 'no_target' END ELSE m.status END AS status,
  CAST(CASE WHEN m.status = 'topublish' AND rejected IS NULL THEN {NOW_MS} ELSE ts END AS BIGINT) AS ts, coalesce(posted, 0) AS posts FROM messages m LEFT JOIN d ON d.message = m.id""")
def after_sends(spark, sf):
    """Messages after a round of sends, several to one target among them."""
    li = views.load(spark, sf, "lineitem")
    ok = F.col("l_returnflag") != "R"
    r = li.select(F.concat(F.lit("web/"), F.col("l_orderkey").cast("string")).alias("message"), F.concat(F.lit("n"), (F.col("l_suppkey") % 5).cast("string")).alias("target"), F.lit("sendMessage").alias("method"), ok.alias("ok"), F.col("l_suppkey").cast("string").alias("tgId"), F.when(~ok, "refused").alias("error"), (views.millis(li, "l_shipdate") * 10 + F.col("l_linenumber")).alias("at"))
    return publish.published_state(views.messages(spark, sf), r, NOW_MS).select("id", "status", F.col("ts").cast("long").alias("ts"), F.size("posts").cast("long").alias("posts"))


# -- scrape and analyze

_POST_SQL = f"""p AS (SELECT d.source AS source_id, d.doc_id, d.text AS body, d.doc_id % 11 = 0 AS forwarded, (epoch_us(e.ts) // 1000) AS ms FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id),
k AS (SELECT *, CASE WHEN ms IS NULL OR {SCRAPE_MS} - ms > 259200000 THEN 'obsolete' WHEN forwarded THEN 'forward' WHEN regexp_replace(body, '[\\t\\n\\x0B\\f\\r ]', '', 'g') = '' THEN 'empty' ELSE 'post' END AS kind FROM p)"""


def _channel_posts(spark, sf):
    p = views.posts(spark, sf)
    links = F.array().cast("array<struct<id: bigint, href: string>>")
    return p.select("source_id", "id", "body", links.alias("links"), F.lit(None).cast("string").alias("image"), "forwardedFrom", iso_timestamp("at").alias("postedAt"))


def _feeds(spark, sf):
    """The documents' sources, and one that has yielded nothing for two runs."""
    s = views.load(spark, sf, "documents").select(F.col("source").alias("id")).distinct().withColumn("zeroYieldRuns", F.lit(0).cast("long"))
    s = s.unionByName(spark.createDataFrame([("silent", 2), ("fresh", 0)], "id string, zeroYieldRuns long"))
    last = F.when(F.col("id") == "silent", 7).otherwise(0).cast("long")
    return s.select("id", F.lit("ok").alias("status"), F.lit("c").alias("category"), F.array(F.lit("t")).alias("tags"), F.lit("").alias("teaser"), F.lit("0").alias("lastItemId"), F.lit(5).cast("long").alias("lastCount"), F.lit(1).cast("long").alias("lastUpdated"), "zeroYieldRuns", last.alias("lastNonZeroCount"), F.lit("old").alias("lastError"))


def _scrape(spark, sf):
    """Items with a number divisible by 97 are refused by the queue."""
    posts = _channel_posts(spark, sf)
    refused = posts.where(F.col("id").cast("long") % 97 == 0).select(F.concat_ws("/", "source_id", "id").alias("id"))
    return console.scrape_run(posts, _feeds(spark, sf), refused, "2024-01-05", SCRAPE_MS)


@query(f"WITH {_POST_SQL} SELECT source_id || '/' || doc_id AS id, md5(body) AS digest, '2024-01-05' AS date FROM k WHERE kind = 'post' AND doc_id % 97 <> 0")
def scraped_items(spark, sf):
    return _scrape(spark, sf)[0].select("id", F.md5("body").alias("digest"), "date")


@query(f"""WITH {_POST_SQL}, s AS (SELECT source_id AS id, count(*) AS n, max(doc_id) AS newest, count(*) FILTER (kind = 'post') AS expected, count(*) FILTER (kind = 'post' AND doc_id % 97 = 0) AS lost FROM k GROUP BY 1)
SELECT id, CASE WHEN lost = 0 THEN CAST(newest AS VARCHAR) ELSE '0' END AS "lastItemId", CASE WHEN lost = 0 THEN n ELSE 5 END AS "lastCount", CAST(CASE WHEN lost = 0 THEN {SCRAPE_MS} ELSE 1 END AS BIGINT) AS "lastUpdated", 0 AS "zeroYieldRuns", CASE WHEN lost = 0 THEN n ELSE 0 END AS "lastNonZeroCount",
  CASE WHEN lost > 0 THEN 'enqueued ' || (expected - lost) || ' of ' || expected || ' posts; the next run sends them again' ELSE '' END AS "lastError" FROM s
UNION ALL SELECT 'silent', '0', 0, {SCRAPE_MS}, 3, 7, '' UNION ALL SELECT 'fresh', '0', 0, {SCRAPE_MS}, 1, 0, ''""")
def sources_after_scrape(spark, sf):
    return _scrape(spark, sf)[1].select("id", "lastItemId", "lastCount", "lastUpdated", "zeroYieldRuns", "lastNonZeroCount", "lastError")


@query(f"""WITH {_POST_SQL}, s AS (SELECT source_id, count(*) AS n, count(*) FILTER (kind = 'post') AS expected, count(*) FILTER (kind = 'post' AND doc_id % 97 = 0) AS lost FROM k GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS processed, CAST(sum(expected - lost) AS BIGINT) AS enqueued, count(*) FILTER (lost > 0) AS failed, 1 AS stale FROM s""")
def scrape_totals(spark, sf):
    return _scrape(spark, sf)[2]


@query("""WITH c AS (SELECT source, median(doc_id) AS m FROM documents GROUP BY 1), r AS (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN d.source > 'm' THEN -doc_id ELSE doc_id END) AS k
  FROM documents d JOIN c USING (source) WHERE d.source > 'm' OR doc_id > floor(m)) SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS id FROM r WHERE k <= 20""")
def next_pages(spark, sf):
    """The newest page of sources without a cursor, the page after it of others."""
    d = views.load(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("id"))
    c = d.groupBy("source_id").agg(F.floor(F.median(F.col("id").cast("long"))).cast("long").cast("string").alias("lastItemId"))
    return items.page_after(d, c.withColumn("lastItemId", F.when(F.col("source_id") > "m", "").otherwise(F.col("lastItemId")))).select("source_id", "id")


@query("""WITH t AS (SELECT doc_id, list_distinct([lower(lang), 'site-' || (doc_id % 5), 'own']) AS tags, [lower(lang), 'site-' || (doc_id % 5), 'own'] AS raw FROM documents WHERE lang IS NOT NULL)
SELECT doc_id AS id, upper(lang) AS country, 'politics' AS category, array_to_string([CASE WHEN x = 'site-1' THEN 'first' ELSE x END FOR x IN raw], '|') AS tags FROM documents JOIN t USING (doc_id)""")
def analyzed_items(spark, sf):
    """Scraped items with a classifier's answers."""
    d = views.load(spark, sf, "documents").where("lang is not null")
    scraped = d.select(F.col("doc_id").alias("id"), F.lit("").alias("category"), F.array(F.lit("Own"), F.concat(F.lit(" SITE "), (F.col("doc_id") % 5).cast("string"))).alias("tags"))
    none = F.lit(None).cast("string")
    answers = d.select(F.col("doc_id").alias("id"), *[none.alias(c) for c in ("title", "summary", "location", "importance", "peoples", "properNames")], F.concat(F.lit(" "), "lang").alias("country"), F.lit("politics").alias("category"), F.array(F.upper("lang"), F.concat(F.lit("site  "), (F.col("doc_id") % 5).cast("string")), F.lit("OWN")).alias("tags"))
    words = spark.createDataFrame([("first", ["site-1"], None)], "id string, keywords array<string>, deleted boolean")
    return items.normalize_analyzed(scraped, answers, words).select("id", "country", "category", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {views.SCORES_SQL} SELECT date, item, story, round(score, 6) AS score FROM scores WHERE score > 0.35")
def candidate_pairs(spark, sf):
    k = _keyed(spark, sf)
    return stories.candidate_pairs(k, k).where("item > story").withColumn("score", F.round("score", 6))


# -- the queue

_BASE = f"{views.WORK_SQL}"


@query(f"""WITH {_BASE}, c AS (SELECT id FROM work WHERE stage = 'publish' AND status = 'pending' AND runAt <= {NOW_MS} ORDER BY runAt, id LIMIT 5)
SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM c) THEN {NOW_MS + 300_000} ELSE leaseUntil END AS "leaseUntil" FROM work""")
def claimed_items(spark, sf):
    return work.claim(views.work_items(spark, sf), "publish", NOW_MS, NOW_MS + 300_000, 5).select("id", "status", "leaseUntil")


@query(f"""WITH {_BASE}, o AS (SELECT *, CAST(id AS BIGINT) % 3 AS r, retryCount + 1 >= CASE stage WHEN 'publish' THEN 5 ELSE 3 END AS final FROM work)
SELECT id, CASE r WHEN 0 THEN 'done' WHEN 1 THEN CASE WHEN final THEN 'error' ELSE 'pending' END ELSE status END AS status, CAST(retryCount + CASE r WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS "retryCount",
  CASE WHEN r = 1 AND NOT final THEN {NOW_MS} + CAST(30000 * pow(2, retryCount) AS BIGINT) ELSE runAt END AS "runAt", CASE WHEN r = 1 THEN 'boom' END AS error, CASE WHEN r = 0 THEN {NOW_MS + DONE_TTL_MS} END AS "expireMs" FROM o""")
def settled_items(spark, sf):
    w = views.work_items(spark, sf)
    o = w.where(F.col("id").cast("long") % 3 < 2).select("id", (F.col("id").cast("long") % 3 == 0).alias("ok"), F.lit("boom").alias("error"), F.lit("why").alias("cause"))
    return work.settle(w, o, NOW_MS).select("id", "status", "retryCount", "runAt", "error", F.unix_millis("expireAt").alias("expireMs"))


@query(f"""WITH {_BASE}, e AS (SELECT id FROM work WHERE status = 'error' ORDER BY finishedAt, id LIMIT 20)
SELECT id, CASE WHEN id IN (SELECT id FROM e) THEN 'pending' ELSE status END AS status, CAST(CASE WHEN id IN (SELECT id FROM e) THEN 0 ELSE retryCount END AS BIGINT) AS "retryCount", CASE WHEN id IN (SELECT id FROM e) THEN {NOW_MS} ELSE runAt END AS "runAt" FROM work""")
def replayed_errors(spark, sf):
    return work.replay_errors(views.work_items(spark, sf), 20, NOW_MS).select("id", "status", "retryCount", "runAt")


@query(f"""WITH {_BASE}, p AS (SELECT id FROM work WHERE stage = 'publish' AND status = 'pending' ORDER BY runAt, id LIMIT 30)
SELECT id, CASE WHEN id IN (SELECT id FROM p) AND runAt > 1704500000000 THEN 1704500000000 ELSE runAt END AS "runAt" FROM work""")
def stepped_items(spark, sf):
    return work.run_now(views.work_items(spark, sf), "publish", 1_704_500_000_000, 30).select("id", "runAt")


@query(f"WITH {_BASE} SELECT (SELECT count(*) FROM (SELECT 1 FROM work WHERE stage = 'publish' AND status = 'pending' LIMIT 30)) AS budget, 'publish' AS stage, true AS paused UNION ALL SELECT 0, 'analyze', false UNION ALL SELECT 0, 'aggregate', false")
def step_budgets(spark, sf):
    w = views.work_items(spark, sf)
    controls = work.set_paused(spark.createDataFrame([], "stage string, paused boolean, budget long, requestedAt long"), "publish", True, 5)
    released = console.released(w, "publish", 30).first().released
    return console.step_budget(controls, "publish", released, NOW_MS).select("budget", "stage", "paused")


@query(f"WITH {_BASE} SELECT id, text, status FROM work WHERE contains(lower(ref), 'click') OR contains(lower(text), 'click')")
def item_keyword(spark, sf):
    return console.item_search(views.work_items(spark, sf), " CLICK ").select("id", "text", "status")


@query(f"""WITH {_BASE} SELECT id, ref, CASE WHEN status = 'running' THEN 'running' ELSE 'due ' || strftime(make_timestamp(runAt * 1000), '%H:%M') END || CASE WHEN retryCount > 0 THEN ' · failed ' || retryCount || ' times' ELSE '' END AS meta, status = 'pending' AS "canRun" FROM work""")
def queue_texts(spark, sf):
    return console.queue_rows(views.work_items(spark, sf)).select("id", "ref", "meta", "canRun")


@query(f"WITH {_BASE} SELECT id, stage, 'e/' || id AS ref, 'boom' AS error FROM work WHERE CAST(id AS BIGINT) % 3 = 1")
def failure_audit(spark, sf):
    w = views.work_items(spark, sf)
    o = w.select("id", (F.col("id").cast("long") % 3 != 1).alias("ok"), F.lit("boom").alias("error"), F.lit(None).cast("string").alias("cause"))
    return work.failure_audit(w, o, NOW_MS).select(F.col("itemId").alias("id"), "stage", "ref", "error")


@query(f"WITH {_BASE} SELECT id FROM work WHERE status <> 'error'")
def purged_errors(spark, sf):
    return work.discard_errors(views.work_items(spark, sf)).select("id")


@query(f"""WITH {_BASE} SELECT id, stage, CASE WHEN stage = 'publish' THEN 'missing messageId' WHEN stage = 'analyze' THEN 'missing body, date' ELSE 'missing summary, date' END AS problem FROM work""")
def payload_problems(spark, sf):
    return views.work_items(spark, sf).select("id", "stage", console.payload_problem("stage", "raw").alias("problem"))


@query(f"""WITH {_BASE} SELECT id, stage, status FROM work WHERE status = 'pending' ORDER BY createdAt DESC, id LIMIT 100""")
def item_page(spark, sf):
    return work.item_list(views.work_items(spark, sf), status="pending").select("id", "stage", "status")


@query(f"""WITH {_BASE}, n AS (SELECT stage, count(*) AS n FROM work WHERE status IN ('pending', 'running') GROUP BY 1), s AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['scrape', 'analyze', 'aggregate', 'publish']) AS stage)
SELECT CAST(pos AS INT) AS pos, s.stage, pos > 0 AS arrow, n AS queued, s.stage = 'publish' AS paused FROM s LEFT JOIN n USING (stage)""")
def pipeline_nodes(spark, sf):
    w = views.work_items(spark, sf)
    controls = work.set_paused(spark.createDataFrame([], "stage string, paused boolean, budget long, requestedAt long"), "publish", True, 5)
    return console.pipeline_nodes(console.stage_list(spark), dashboard.queue_depth(w), work.read_controls(controls)).select("pos", "stage", "arrow", "queued", "paused")


# -- the console


@query(f"""WITH {views.FACTS_SQL}, {_BASE}, {views.MESSAGES_SQL}, {views.SOURCES_SQL}
SELECT (SELECT CAST(coalesce(sum(value), 0) AS BIGINT) FROM facts WHERE name = 'view' AND hour >= {(NOW_MS - DAY_MS) // 3_600_000 * 3_600_000} AND hour < {NOW_MS}) AS scraped,
  (SELECT count(*) FROM work WHERE stage = 'publish' AND status IN ('pending', 'running')) AS queued_publish, (SELECT count(*) FROM work WHERE status = 'error') AS errors,
  (SELECT count(*) FROM sources WHERE status = 'ok' AND lastError IS NOT NULL) AS "failingSources", (SELECT count(*) FROM messages WHERE status = 'published') AS messages_published,
  (SELECT count(*) FROM work WHERE status = 'error') + (SELECT count(*) FROM sources WHERE status = 'ok' AND lastError IS NOT NULL) AS failures""")
def overview(spark, sf):
    facts = metrics.facts(views.facts(spark, sf).withColumn("name", F.when(F.col("name") == "view", "ItemsScraped").otherwise(F.col("name"))))
    rows = dashboard.overview(facts, views.work_items(spark, sf), views.sources(spark, sf), views.messages(spark, sf), NOW_MS)
    return rows.select("scraped", "queued_publish", "errors", "failingSources", "messages_published").join(console.failure_total(rows))


@query(f"""WITH {views.FACTS_SQL} SELECT CAST(coalesce(sum(value) FILTER ("by" = '0'), 0) AS BIGINT) AS low, CAST(coalesce(sum(value) FILTER ("by" = '1'), 0) AS BIGINT) AS category, 0 AS nobody,
  CAST(coalesce(sum(value) FILTER ("by" IN ('0', '1')), 0) AS BIGINT) AS total FROM facts WHERE name = 'click' AND hour >= {(NOW_MS - 7 * DAY_MS) // 3_600_000 * 3_600_000} AND hour < {NOW_MS}""")
def skip_reasons(spark, sf):
    by = F.when(F.col("by") == "0", "low").when(F.col("by") == "1", "category").otherwise("else")
    rows = metrics.facts(views.facts(spark, sf).where("name = 'click'").withColumns({"name": F.lit("ItemsSkipped"), "by": by}))
    return dashboard.skip_split(rows, NOW_MS - 7 * DAY_MS, NOW_MS)


@query(f"""WITH {_BLOCKS_SQL} SELECT mid AS "itemId", 'https://t.me/' || mid AS url, ts FROM lines WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)""")
def members_of(spark, sf):
    first = views.load(spark, sf, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return dashboard.members_of(views.messages(spark, sf), f"web/{first}").select("itemId", "url", "ts")


def _audit(spark, sf):
    e = views.load(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.lit("send").alias("kind"), F.concat(F.lit("m/"), (F.col("user_id") % 9).cast("string")).alias("messageId"), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")).alias("target"), F.col("event_id").cast("string").alias("itemId"), F.lit("no").alias("error"), views.millis(e, "ts").alias("at"))


_AUDIT_SQL = "a AS (SELECT 'm/' || (user_id % 9) AS messageId, 't' || (event_id % 4) AS target, CAST(event_id AS VARCHAR) AS itemId, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'error')"


@query(f"""WITH {_AUDIT_SQL} SELECT messageId AS "messageId", target, itemId AS "itemId", ms AS "at" FROM a ORDER BY ms DESC, messageId, target, itemId LIMIT 200""")
def audit_page(spark, sf):
    return dashboard.audit_page(_audit(spark, sf)).select("messageId", "target", "itemId", "at")


@query(f"""WITH {_AUDIT_SQL} SELECT messageId AS "messageId", target, ms AS "at" FROM a WHERE messageId IN ('m/1', 'm/5')""")
def audit_keys(spark, sf):
    return console.audit_keys(_audit(spark, sf), spark.createDataFrame([("m/1",), ("m/5",), ("m/1",), ("none",)], "id string"))


@query(f"WITH {_AUDIT_SQL} SELECT itemId AS \"itemId\", ms + {30 * DAY_MS} AS expires FROM a WHERE ms + {30 * DAY_MS} > {NOW_MS}")
def unexpired_audit(spark, sf):
    return tables.unexpired(tables.audit_rows(_audit(spark, sf)), NOW_MS).select("itemId", F.unix_millis("expireAt").alias("expires"))


@query("""SELECT CAST(0 AS INT) AS pos, 'p_partkey,p_name,p_brand' AS line UNION ALL SELECT 1, p_partkey || ',' || CASE WHEN regexp_matches(p_name, '[",\\n\\r]') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || p_brand FROM part""")
def csv_file(spark, sf):
    return console.csv_table(views.load(spark, sf, "part"), ["p_partkey", "p_name", "p_brand"], "p_partkey")


@query(f"WITH {views.MESSAGES_SQL} SELECT id, status, ts FROM messages WHERE status IN ('topublish', 'published', 'no_target', 'error')")
def every_status(spark, sf):
    return console.all_status_messages(views.messages(spark, sf)).select("id", "status", "ts")


@query(f"""WITH {views.SOURCES_SQL}, n AS (SELECT id FROM due WHERE dueAt <= {NOW_MS} ORDER BY lastUpdated, id LIMIT 10)
SELECT id, CASE WHEN id IN (SELECT id FROM n) THEN 'next run' WHEN dueAt <= {NOW_MS} THEN 'after the next run' ELSE 'due ' || strftime(make_timestamp(dueAt * 1000), '%H:%M') END AS polled FROM due""")
def polled_texts(spark, sf):
    return items.source_previews(views.sources(spark, sf), NOW_MS).select("id", console.polled_text("next", "dueAt", NOW_MS).alias("polled"))


@query(f"""WITH {views.SOURCES_SQL} SELECT id, status, CAST(0 AS BIGINT) AS "lastUpdated" FROM sources""")
def reset_cursors(spark, sf):
    return console.reset_cursors(views.sources(spark, sf)).select("id", "status", "lastUpdated")


@query(f"""WITH {views.MESSAGES_SQL} SELECT id, CASE WHEN o_orderkey % 10 = 0 THEN 'topublish' ELSE status END AS status, CAST(CASE WHEN o_orderkey % 10 = 0 THEN {NOW_MS} ELSE ts END AS BIGINT) AS ts FROM messages""")
def republished(spark, sf):
    m = views.messages(spark, sf)
    return console.republish(m, m.where(F.col("o_orderkey") % 10 == 0).select("id"), NOW_MS)[0].select("id", "status", "ts")


@query("""SELECT lower(n_name) AS id, CASE WHEN k.message IS NOT NULL THEN k.message END AS "lastPostedMessageId" FROM nation LEFT JOIN (SELECT o_custkey % 25 AS n, arg_max('web/' || o_orderkey, o_orderkey) AS message FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) k ON k.n = n_nationkey""")
def last_posts(spark, sf):
    n, o = views.load(spark, sf, "nation"), views.load(spark, sf, "orders").where("o_custkey % 2 = 0")
    name = n.select((F.col("n_nationkey")).alias("k"), F.lower("n_name").alias("target"))
    sent = o.select((F.col("o_custkey") % 25).alias("k"), F.concat(F.lit("web/"), F.col("o_orderkey").cast("string")).alias("message"), F.col("o_orderkey").alias("at")).join(name, "k")
    base = n.select(F.lower("n_name").alias("id"), F.lit(None).cast("string").alias("lastPostedDate"), F.lit(None).cast("string").alias("lastPostedMessageId"))
    return console.last_posts(base, sent).select("id", "lastPostedMessageId")


@query("SELECT event_id AS item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error') AS BIGINT) AS attempt FROM events QUALIFY count(*) OVER (PARTITION BY user_id, ts) = 1")
def attempt_numbers(spark, sf):
    e = views.load(spark, sf, "events")
    log = e.select(F.col("user_id").alias("item"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), "event_id")
    alone = e.groupBy("user_id", "ts").agg(F.count("*").alias("n"), F.first("event_id").alias("event_id")).where("n = 1").select("event_id")
    return console.attempt_numbers(log).join(alone, "event_id", "left_semi").select(F.col("event_id").alias("item"), "attempt")


@query("SELECT c_custkey AS id, 'segment' AS field, 'new' AS value FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'new'")
def changed_fields(spark, sf):
    c = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return tables.changed_fields(c.where("id % 3 = 0").withColumn("segment", F.lit("new")), c, ["segment", "balance"])


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND contains(lower(c_mktsegment), 'build')")
def grid_view(spark, sf):
    return grid.view(views.load(spark, sf, "customer"), ["c_custkey", "c_name"], " 1 ", {"c_name": "customer"}, ("c_name", "desc"), "c_custkey").join(views.load(spark, sf, "customer").where("contains(lower(c_mktsegment), 'build')").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS BIGINT) AS place FROM customer")
def text_sort_rank(spark, sf):
    return grid.ranked(views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment", True).select("id", "place")


@query("SELECT o_custkey AS id, CASE WHEN c_custkey IS NULL THEN 'stranger' WHEN n > 1 THEN 'repeated' END AS problem FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE c_custkey IS NULL OR n > 1 UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def verdict_problems(spark, sf):
    asked = views.load(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return dashboard.verdict_guard(asked, views.load(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


# -- texts, times and captions


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS hour, (epoch_us(ts) // 1000) // 300000 AS bucket,
  CASE WHEN event_id >= 3600 THEN (event_id // 3600) || ':' ELSE '' END || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock,
  event_id % 40 BETWEEN 1 AND 31 AS is_day FROM events""")
def time_texts(spark, sf):
    e = views.load(spark, sf, "events")
    ms = views.millis(e, "ts")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 40).cast("string"), 2, "0"))
    return e.select("event_id", iso_timestamp(ms).alias("iso"), hour_bucket(ms).alias("hour"), settle_bucket(ms).alias("bucket"), clock("event_id").alias("clock"), is_date_key(day).alias("is_day"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'https://t.me/s/' || s_suppkey END AS url, 'b' || s_suppkey || ',c' AS ids, 'key [redacted] for ' || s_name || ' and {other}' AS told,
  CASE WHEN s_suppkey % 3 = 0 THEN 'private' END AS reason, CASE WHEN s_suppkey % 5 = 0 THEN '0%' WHEN s_suppkey % 5 = 1 THEN '<1%' ELSE (s_suppkey % 5 * 10) || '%' END AS share, CASE WHEN s_suppkey % 2 = 0 THEN 'a b' ELSE 'unknown' END AS origin, 'x-y' AS tag FROM supplier""")
def small_texts(spark, sf):
    s, k = views.load(spark, sf, "supplier"), F.col("s_suppkey")
    id = F.concat(F.when(k % 4 == 0, "s/").otherwise("emulated/"), k.cast("string"))
    said = F.when(k % 3 == 0, "x\nERROR: [tool] abc: private \ny").otherwise("fine")
    part = F.when(k % 5 == 1, 0.001).otherwise((k % 5) / 10)
    told = text.redact(text.fill(F.lit("key SECRET for {name} and {other}"), {"name": F.col("s_name")}), F.lit("SECRET"))
    return s.select("s_suppkey", text.post_url(id).alias("url"), F.array_join(text.target_ids(F.concat(F.lit(" @b"), k.cast("string"), F.lit(",@c, c,"))), ",").alias("ids"), told.alias("told"), text.unavailable_reason(said).alias("reason"), text.share(part).alias("share"), text.forward_origin(F.lit(True), F.when(k % 2 == 0, "a b"), F.lit(None)).alias("origin"), console.tag_id(F.lit(" X  y ")).alias("tag"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(CASE WHEN strpos(reverse(left(t, 220)), ' ') BETWEEN 1 AND 219 THEN left(t, 220 - strpos(reverse(left(t, 220)), ' ')) ELSE left(t, 219) END, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') || '…' END AS summary FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def clamped(spark, sf):
    d = views.load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", clamp_summary(F.regexp_replace("text", "[^\\x00-\\x7F]", "?")).alias("summary"))


@query("""SELECT event_id AS id, 'see [🔘](#1) ' || event_type AS body, 'http://x/' || event_id AS href, CASE WHEN event_id % 2 = 0 THEN 'friend' END AS "forwardedFrom" FROM events""")
def chat_posts(spark, sf):
    e = views.load(spark, sf, "events")
    span = F.struct(F.lit(6).alias("offset"), F.lit(2).alias("length"), F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("url"))
    chat = e.select(F.lit("c").alias("source_id"), F.col("event_id").alias("id"), F.concat(F.lit("  see 🔘 "), "event_type").alias("text"), F.array(span).alias("spans"), views.millis(e, "ts").alias("at"), (F.col("event_id") % 2 == 0).alias("forwarded"), F.lit("friend").alias("fromName"), F.lit(None).cast("long").alias("fromPeer"))
    return console.channel_posts(chat).select(F.col("id").cast("long").alias("id"), "body", F.col("links")[0]["href"].alias("href"), "forwardedFrom")


def _fetches(spark, sf):
    """A video for each event: with captions, without, empty, or unavailable."""
    e, k = views.load(spark, sf, "events").select("event_id"), F.col("event_id")
    videos = e.select(k.cast("string").alias("id"), F.concat(F.lit("Talk "), k.cast("string")).alias("title"), F.when(k % 10 == 9, "fetched").otherwise("todo").alias("status"), k.alias("addedAt"), *[F.lit(None).cast("string").alias(c) for c in ("note", "lang", "kind", "transcript")], F.lit(None).cast("boolean").alias("deleted"))
    raw = F.when(k % 4 == 2, '{"events": []}').otherwise('{"events": [{"tStartMs": 0, "segs": [{"utf8": "Hello "}, {"utf8": "there"}]}, {"tStartMs": 30000, "segs": [{"utf8": "again"}]}]}')
    track = F.when(k % 4 != 1, captions.pick_track(F.array(F.lit("de"), F.lit("en")), F.array().cast("array<string>"), F.lit("en"), F.lit("de")))
    fetches = e.select(k.cast("string").alias("id"), track.alias("track"), raw.alias("raw"), F.when(k % 4 == 3, "ERROR: [x] y: gone").otherwise("").alias("said"), F.lit("ch").alias("channel"), F.lit(65).alias("duration"))
    return videos, fetches


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 10 = 9 THEN 'fetched' ELSE ['fetched', 'skipped', 'skipped', 'unavailable'][event_id % 4 + 1] END AS status,
  CASE WHEN event_id % 10 <> 9 THEN [NULL, 'no captions', 'empty captions', 'gone'][event_id % 4 + 1] END AS note, CASE WHEN event_id % 10 <> 9 AND event_id % 4 = 0 THEN 'en' END AS lang,
  CASE WHEN event_id % 10 <> 9 AND event_id % 4 = 0 THEN md5('# Talk ' || event_id || chr(10) || chr(10) || 'https://www.youtube.com/watch?v=' || event_id || chr(10) || chr(10) || '> ch · 01:05 · captions: en' || chr(10) || chr(10) || '- [00:00](https://www.youtube.com/watch?v=' || event_id || '&t=0s) Hello there' || chr(10) || '- [00:30](https://www.youtube.com/watch?v=' || event_id || '&t=30s) again' || chr(10)) END AS digest FROM events""")
def fetched_videos(spark, sf):
    videos, fetches = _fetches(spark, sf)
    return captions.absorb_fetches(videos, fetches).select("id", "status", "note", "lang", F.md5("transcript").alias("digest"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 10 = 9 AND event_id % 3 = 0 THEN 'absorbed' WHEN event_id % 10 = 9 THEN 'fetched' ELSE 'todo' END AS status FROM events""")
def absorbed_videos(spark, sf):
    videos, _ = _fetches(spark, sf)
    return console.video_statuses(console.transcript_files(videos, videos.where(F.col("addedAt") % 3 == 0).select("id"))[1])


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 10 <> 9 ORDER BY event_id, CAST(event_id AS VARCHAR) LIMIT 20")
def next_videos(spark, sf):
    return captions.next_videos(_fetches(spark, sf)[0]).select("id")


@query("SELECT 'v' || user_id AS id, min(event_type) AS title FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def new_videos(spark, sf):
    p = views.load(spark, sf, "events").groupBy("user_id").agg(F.min("event_type").alias("title")).select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("videoId"), "title", "user_id")
    return captions.new_videos(p, p.where("user_id % 5 = 0").select(F.col("videoId").alias("id")), NOW_MS).select("id", "title")


@query(f"""WITH e AS (SELECT (epoch_us(ts) // 1000) AS ms FROM events) SELECT 'ItemsDropped' AS name, 'obsolete' AS "by", count(*) AS value FROM e WHERE {NOW_MS} - ms > {10 * DAY_MS}""")
def obsolete_count(spark, sf):
    e = views.load(spark, sf, "events")
    return flows.late_split(e.select(views.millis(e, "ts").alias("at")), NOW_MS, 10 * DAY_MS)[1].select("name", "by", "value")


@query(f"""WITH {views.KEYS_SQL} SELECT a.id, round(list_aggregate([0.6 * len(list_intersect(a.e, b.e)) / greatest(len(list_distinct(list_concat(a.e, b.e))), 1), 0.25 * len(list_intersect(a.t, b.t)) / greatest(len(list_distinct(list_concat(a.t, b.t))), 1), 0.15 * len(list_intersect(a.g, b.g)) / greatest(len(list_distinct(list_concat(a.g, b.g))), 1)], 'sum'), 6) AS score
FROM keys a JOIN keys b ON CAST(substr(b.id, 5) AS BIGINT) = CAST(substr(a.id, 5) AS BIGINT) + 1""")
def labelled_scores(spark, sf):
    """Scores of labelled pairs: each item with the next."""
    rows = views.items(spark, sf)
    known = rows.select("seq", F.col("id").alias("b"))
    pairs = rows.select("seq", F.col("id").alias("a")).withColumn("seq", F.col("seq") + 1).join(known, "seq").select("a", "b", F.lit(True).alias("same"))
    return calibrate.scored_pairs(pairs, rows).select(F.col("a").alias("id"), F.round("score", 6).alias("score"))
