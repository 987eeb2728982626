"""Named queries of the story merge, the streams and the checks, each with its SQL.

A stream's query writes its log where all tasks can read it, runs what is available
to its end and returns what its sink wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..operators import answers, stories, tables, work
from ..operators.graph import shared_folder
from ..streaming import flows, queue
from ..streaming import stories as merge
from . import views
from .queries import query
from .views import NOW_MS

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _run(spark: SparkSession, log: DataFrame, start: Callable[[DataFrame, str, str], object]) -> str:
    """Writes a log, starts a query over it, start(stream, checkpoint, out), and gives
    the folder it wrote once it has ended.  All files of a log are one batch."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log.write.parquet(f"{root}/log")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        running = start(spark.readStream.schema(log.schema).parquet(f"{root}/log"), f"{root}/check", f"{root}/out")
        running.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    _remove(spark, f"{root}/log")
    _remove(spark, f"{root}/check")
    return f"{root}/out"


def _streamed(spark: SparkSession, log: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a stream over a log gives."""

    def start(stream: DataFrame, check: str, out: str):
        made = make(stream)
        schema.append(made.schema)
        return flows.write_batches(made, check, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))

    schema: list = []
    out = _run(spark, log, start)
    return spark.read.schema(schema[0]).parquet(out).select(schema[0].names)


# -- stories

_J = "CASE WHEN len(list_distinct(list_concat(it.{0}, x.{0}))) = 0 THEN 0.0 ELSE len(list_intersect(it.{0}, x.{0})) / CAST(len(list_distinct(list_concat(it.{0}, x.{0}))) AS DOUBLE) END"
_UNION = "list_sort(list_distinct(list_concat({0}, s[b].{0})))[1:256]"
# the merge, an item of every day at a time: s are the day's stories in the order of their first items
_FOLD_SQL = f"""WITH RECURSIVE {views.KEYS_SQL},
it AS (SELECT k.date, k.id, k.e, k.t, k.g, row_number() OVER (PARTITION BY k.date ORDER BY i.seq, k.id) AS n FROM keys k JOIN items i USING (id)),
st AS (
  SELECT date, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id VARCHAR, e VARCHAR[], t VARCHAR[], g VARCHAR[], m VARCHAR[])[]) AS s, CAST([] AS VARCHAR[]) AS pairs, CAST(0 AS BIGINT) AS capped
  FROM (SELECT DISTINCT date FROM it)
  UNION ALL
  SELECT date, n,
    CASE WHEN coalesce(score, 0) < 0.72 THEN list_append(s, {{'id': id, 'e': e, 't': t, 'g': g, 'm': [id]}})
      WHEN len(s[b].m) >= 20 THEN s
      ELSE list_concat(s[1:b - 1], [{{'id': s[b].id, 'e': {_UNION.format('e')}, 't': {_UNION.format('t')}, 'g': {_UNION.format('g')}, 'm': list_append(s[b].m, id)}}], s[b + 1:]) END,
    CASE WHEN score > 0.35 AND score < 0.72 THEN list_append(pairs, id || '->' || s[b].id) ELSE pairs END,
    capped + CASE WHEN score >= 0.72 AND len(s[b].m) >= 20 THEN 1 ELSE 0 END
  FROM (SELECT *, list_max(scores) AS score, list_position(scores, list_max(scores)) AS b FROM (
    SELECT st.date, it.n, st.s, st.pairs, st.capped, it.id, it.e, it.t, it.g, [0.6 * {_J.format('e')} + 0.25 * {_J.format('t')} + 0.15 * {_J.format('g')} FOR x IN st.s] AS scores
    FROM st JOIN it ON it.date = st.date AND it.n = st.n + 1))),
ended AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC) = 1),
told AS (SELECT date, unnest(s) AS x, generate_subscripts(s, 1) AS pos, len(s) AS n_stories, n, len(pairs) AS n_pairs, capped FROM ended)"""
_STORIES_SQL = _FOLD_SQL + " SELECT date, x.id AS id, CAST(len(x.m) AS BIGINT) AS \"memberCount\", array_to_string(x.m, '|') AS members"


def _stories(rows: DataFrame) -> DataFrame:
    return rows.select("date", "id", "memberCount", F.array_join("memberIds", "|").alias("members"))


@query(
    _STORIES_SQL
    + """, CASE WHEN pos = 1 THEN n_stories ELSE 0 END AS n_created, CASE WHEN pos = 1 THEN n - n_stories - capped ELSE 0 END AS n_merged,
  CASE WHEN pos = 1 THEN capped ELSE 0 END AS n_capped, CASE WHEN pos = 1 THEN n_pairs ELSE 0 END AS n_adjudicated FROM told"""
)
def story_fold(spark, sf):
    return stories.fold_stories(views.items(spark, sf), NOW_MS).select("date", "id", "memberCount", F.array_join("memberIds", "|").alias("members"), "n_created", "n_merged", "n_capped", "n_adjudicated")


@query(_STORIES_SQL + " FROM told")
def story_parts(spark, sf):
    """The same stories, each day folded in parts that cannot meet."""
    return _stories(stories.fold_stories(views.items(spark, sf), NOW_MS, parts=True))


@query(_STORIES_SQL + " FROM told")
def story_stream(spark, sf):
    """The same stories out of the stateful stream."""
    kept = ("id", "seq", "date", "title", "peoples", "properNames", "tags", "category", "image", "country", "location")
    log = views.items(spark, sf).select(*kept)
    return _stories(_streamed(spark, log, lambda s: merge.merge_stories(s, NOW_MS)).where("kind = 'story'"))


@query(_FOLD_SQL.replace("score > 0.35", "score > 0.1") + " SELECT date, p AS id, split_part(p, '->', 1) AS item, split_part(p, '->', 2) AS story FROM (SELECT date, unnest(pairs) AS p FROM ended)")
def story_band_pairs(spark, sf):
    """What an adjudicator is asked under a wider band, as few pairs here score 0.35."""
    return stories.band_pairs(stories.fold(views.items(spark, sf), NOW_MS, band=(0.1, 0.72))).select("date", "id", "item", "story")


@query(_FOLD_SQL + " SELECT x.id AS id, 'topublish' AS status, true AS republish, CAST(len(x.m) AS BIGINT) AS n_blocks, list_sort(x.m)[1] AS first FROM told")
def story_writes(spark, sf):
    """The messages that a first batch writes, with their member blocks."""
    i = views.items(spark, sf).withColumns({"summary": F.substring("body", 1, 100), "links": F.lit(None).cast("array<struct<id: bigint, href: string>>")})
    folded = stories.fold(i, NOW_MS)
    member = "map<string, struct<summary: string, links: array<struct<id: bigint, href: string>>, channel: string, ts: bigint>>"
    none = spark.createDataFrame([], f"id string, status string, members {member}, title string, country string, location string, peoples string, tags array<string>, image string")
    rows = stories.merge_writes(folded, i, none)
    return rows.select("id", "status", "republish", F.size("members").cast("long").alias("n_blocks"), F.array_min(F.map_keys("members")).alias("first"))


# -- queue, sources, counters

_BASE = 1_700_000_000_000
_QUEUE_SQL = f"""c AS (SELECT c_custkey AS k, {_BASE} + c_custkey * 1000 AS t, ['analyze', 'aggregate', 'publish'][c_custkey % 3 + 1] AS stage FROM customer)"""


def _queue_log(spark, sf):
    """Every customer an item: enqueued and, but for a fifth, claimed for a minute; then
    done, failed, silent, or failed too late.  A last row ends all waits."""
    c = views.load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.lit(_BASE) + F.col("c_custkey") * 1000).alias("t"), (F.col("c_custkey") % 5).alias("way"), F.element_at(F.array(F.lit("analyze"), F.lit("aggregate"), F.lit("publish")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("stage"))
    none = F.lit(None)
    row = lambda kind, at, until=none, error=none: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), until.cast("long").alias("until"), error.cast("string").alias("error"))
    t, way = F.col("t"), F.col("way")
    rows = [row("enqueue", t), F.when(way < 4, row("claim", t + 1000, t + 61_000)), F.when(way == 0, row("ok", t + 2000)).when(way == 1, row("fail", t + 2000, none, F.lit("bad"))).when(way == 3, row("fail", t + 70_000, none, F.lit("late")))]
    log = c.select("id", "stage", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("id", "stage", "r.*")
    end = c.agg(F.max("t").alias("t")).select(F.lit("end").alias("id"), F.lit("analyze").alias("stage"), F.lit("enqueue").alias("kind"), (F.col("t") + 10_000_000).alias("at"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("string").alias("error"))
    return log.unionByName(end).select("id", "stage", "kind", F.timestamp_millis("at").alias("ts"), "until", "error")


@query(f"""WITH {_QUEUE_SQL} SELECT CAST(k AS VARCHAR) AS id, stage, CASE WHEN k % 5 = 0 THEN 'done' ELSE 'pending' END AS status, CAST(CASE WHEN k % 5 IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS "retryCount",
  t + CASE k % 5 WHEN 1 THEN 32000 WHEN 2 THEN 91000 WHEN 3 THEN 91000 ELSE 0 END AS "runAt", CAST(NULL AS BIGINT) AS "leaseUntil", CASE WHEN k % 5 = 0 THEN t + 2000 END AS "finishedAt",
  CASE WHEN k % 5 = 1 THEN 'bad' WHEN k % 5 IN (2, 3) THEN '{queue.LEASE_LOST}' END AS error FROM c""")
def queue_stream(spark, sf):
    """Items' states after their log: attempts, backoff and leases by timers."""
    return queue.last_states(_streamed(spark, _queue_log(spark, sf), lambda s: queue.queue_states(s, "0 seconds"))).where("id <> 'end'")


@query(f"WITH {_QUEUE_SQL} SELECT CAST(k AS VARCHAR) AS id, t + CASE k % 5 WHEN 1 THEN 32000 WHEN 4 THEN 0 ELSE 91000 END AS at FROM c WHERE k % 5 <> 0")
def due_wakes(spark, sf):
    """When each pending item's time came, as a timer told it."""
    rows = _streamed(spark, _queue_log(spark, sf), lambda s: queue.queue_states(s, "0 seconds"))
    return rows.where("due and id <> 'end'").groupBy("id").agg(F.max("runAt").alias("at"))


@query("""WITH p AS (SELECT CAST(user_id % 40 AS VARCHAR) AS id, event_id, CASE WHEN event_type = 'purchase' THEN user_id % 9 + 1 ELSE 0 END AS n FROM events),
g AS (SELECT *, count(*) FILTER (n > 0) OVER w AS turn FROM p WINDOW w AS (PARTITION BY id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, count(*) FILTER (n = 0) OVER w AS runs, max(n) OVER w AS most, max(CASE WHEN n > 0 THEN event_id END) OVER w AS newest FROM g WINDOW w AS (PARTITION BY id, turn ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT id, 1000 + 1000 * event_id AS at, CASE WHEN turn > 0 THEN CAST(newest AS VARCHAR) END AS "lastItemId", CAST(n AS BIGINT) AS "lastCount", runs AS "zeroYieldRuns", CAST(CASE WHEN turn > 0 THEN most ELSE 0 END AS BIGINT) AS "lastNonZeroCount", runs >= 3 AND turn > 0 AS stale FROM r""")
def source_alert_stream(spark, sf):
    """Forty sources, a poll for each event; only purchases bring posts."""
    e = views.load(spark, sf, "events")
    n = F.when(F.col("event_type") == "purchase", F.col("user_id") % 9 + 1).otherwise(0).cast("long")
    log = e.select((F.col("user_id") % 40).cast("string").alias("id"), F.timestamp_millis(1000 + 1000 * F.col("event_id")).alias("ts"), n.alias("n"), F.when(n > 0, F.col("event_id").cast("string")).alias("newest"))
    rows = _streamed(spark, log, lambda s: queue.source_alerts(s, 3_600_000))
    return rows.where("not quiet").drop("quiet")


@query(f"WITH {views.FACTS_SQL} SELECT hour, name, CAST(sum(value) AS BIGINT) AS value FROM facts GROUP BY ALL")
def counted_hours(spark, sf):
    """Counters and late rows of the stream add up to the events."""
    log = views.facts(spark, sf).select(F.timestamp_millis("at").alias("ts"), "name", "by", "value")
    facts, late = flows.counted_hours(spark, _run(spark, log, flows.count_hours))
    return facts.unionByName(late).groupBy("hour", "name").agg(F.sum("value").alias("value"))


@query("""SELECT sha1(user_id || '@' || ((epoch_us(ts) // 1000) // 300000)) AS id, CAST(user_id AS VARCHAR) AS message, min((epoch_us(ts) // 1000)) + 300000 AS "runAt" FROM events GROUP BY user_id, (epoch_us(ts) // 1000) // 300000""")
def settled_stream(spark, sf):
    e = views.load(spark, sf, "events")
    log = e.select(F.col("user_id").cast("string").alias("message"), F.timestamp_millis(views.millis(e, "ts")).alias("ts"))
    return flows.settled(spark, _run(spark, log, flows.settle_publishes))


@query(f"""WITH {views.WORK_SQL}, d AS (SELECT id FROM work WHERE stage = 'publish' AND status = 'pending' AND runAt <= {NOW_MS} ORDER BY runAt, id LIMIT 7)
SELECT id, CASE WHEN d.id IS NULL THEN status WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'done' WHEN retryCount + 1 >= 5 THEN 'error' ELSE 'pending' END AS status, CAST(retryCount + CASE WHEN d.id IS NOT NULL AND CAST(id AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS "retryCount"
FROM work LEFT JOIN d USING (id)""")
def drained_items(spark, sf):
    """A paused stage with a budget of seven runs them three at a time."""
    controls = spark.createDataFrame([("publish", True, 7, 0)], "stage string, paused boolean, budget bigint, requestedAt bigint")
    run = lambda rows: rows.select("id", (F.col("id").cast("long") % 2 == 0).alias("ok"), F.lit("odd").alias("error"), F.lit(None).cast("string").alias("cause"))
    items, _, _ = work.drain(views.work_items(spark, sf), controls, "publish", run, lambda: NOW_MS, 3)
    return items.select("id", "status", "retryCount")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'analyze' AS stage, 'pending' AS status, '{\"id\": ' || c_custkey || '}' AS raw, CAST(0 AS BIGINT) AS \"retryCount\", CAST(1500 AS BIGINT) AS \"runAt\", CAST(1000 AS BIGINT) AS \"createdAt\" FROM customer")
def enqueued_items(spark, sf):
    c = F.col("c_custkey").cast("string")
    return work.enqueue("analyze", views.load(spark, sf, "customer").select(c.alias("id"), F.concat(F.lit('{"id": '), c, F.lit("}")).alias("raw")), 1000, 500)


@query(f"WITH {views.TARGETS_SQL} SELECT id, array_to_string(tags, '|') AS tags FROM targets")
def listed_targets(spark, sf):
    return tables.list_all(views.targets(spark, sf)).select("id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {views.WORK_SQL} SELECT id, stage, status FROM work WHERE id = '17'")
def inspected_item(spark, sf):
    return tables.get(views.work_items(spark, sf), "17").select("id", "stage", "status")


# -- checks


@query("""SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 1 THEN 'max: not a whole number' WHEN 2 THEN 'max: at most 10' WHEN 3 THEN 'forbidden' WHEN 4 THEN 'queueName: not one of the known values|paused: missing'
  WHEN 5 THEN 'delta.n' || c_custkey || ': not a known field' WHEN 6 THEN 'not an object' WHEN 7 THEN 'unknown action' WHEN 8 THEN CASE WHEN length(c_mktsegment) > 8 THEN '' ELSE 'messageId: not of the known form' END ELSE '' END AS problems FROM customer""")
def call_problems(spark, sf):
    """A call for each customer, most of them wrong in one way or another."""
    c = views.load(spark, sf, "customer")
    way, id = F.col("c_custkey") % 9, F.col("c_custkey").cast("string")
    texts = [
        ("publishPending", "admin", F.lit('{"max": 10}')), ("publishPending", "admin", F.concat(F.lit('{"max": "'), id, F.lit('"}'))), ("publishPending", "admin", F.concat(F.lit('{"max": '), (F.col("c_custkey") + 10).cast("string"), F.lit("}"))),
        ("runItem", "editor", F.lit("{}")), ("pauseStage", "admin", F.lit('{"queueName": "scrape"}')), ("upsertRecord", "editor", F.concat(F.lit('{"table": "sources", "id": "s", "delta": {"status": "ok", "n'), id, F.lit('": 1}}'))),
        ("inspectItem", "viewer", F.concat(F.lit('{"id": '), id)), ("format", "admin", F.lit("{}")),
        ("loadPosts", "viewer", F.concat(F.lit('{"messageId": "a'), F.when(F.length("c_mktsegment") > 8, "/").otherwise("-"), id, F.lit('"}'))),
    ]
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) if isinstance(t[k], str) else t[k] for t in texts]), (way + 1).cast("int"))
    calls = c.select(F.col("c_custkey").alias("id"), pick(0).alias("action"), pick(1).alias("role"), pick(2).alias("input"))
    return calls.select("id", F.array_join(contracts.call_problems("action", "role", "input"), "|").alias("problems"))


_ANSWER_SQL = """d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents)
SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'not an object' WHEN 1 THEN 'title: not a text' WHEN 2 THEN 'category: not one of the known values' WHEN 3 THEN 'country: missing|tags: not a list of texts' ELSE '' END AS problems,
  CASE WHEN doc_id % 7 > 3 THEN md5(substr(text, 1, 100)) END AS digest, CASE WHEN doc_id % 7 > 3 THEN upper(lang) END AS country FROM d"""


@query("WITH " + _ANSWER_SQL)
def parsed_answers(spark, sf):
    """A classifier's responses about the documents: cut off, mistyped, unknown,
    incomplete, and good ones with more fields than asked for; none is lost."""
    d = views.load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    way = F.col("doc_id") % 7
    fields = [F.when(way == 1, F.to_json(F.struct(F.lit(7).alias("title")))).otherwise(F.to_json(F.struct(F.lit("some title").alias("title")))), F.to_json(F.struct(F.substring("text", 1, 100).alias("summary"), F.lit("").alias("location"), F.lit("high").alias("importance"), F.lit(1).alias("more"), F.when(way == 2, "gossip").otherwise("science").alias("category")))]
    rest = F.when(way == 3, F.lit('{"tags": "one"}')).otherwise(F.concat(F.lit('{"country": "'), F.upper("lang"), F.lit('", "tags": ["one"]}')))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    text = F.concat(F.lit("{"), F.concat_ws(", ", *map(inner, [*fields, rest])), F.lit("}"))
    text = F.when(way == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    response = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))
    good, rejects = answers.classified(d.select(F.col("doc_id").alias("id"), response.alias("response")))
    none = F.lit(None).cast("string")
    return good.select("id", F.lit("").alias("problems"), F.md5("summary").alias("digest"), "country").unionByName(rejects.select("id", F.array_join("problems", "|").alias("problems"), none.alias("digest"), none.alias("country")))


@query("SELECT o_orderkey AS pair, o_orderkey % 2 = 0 AS same FROM orders WHERE o_custkey % 4 <> 0")
def parsed_verdicts(spark, sf):
    """One response for each customer about his orders; those of a fourth leave one out
    and count as nothing."""
    o = views.load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("pair"))
    row = F.struct(F.col("pair").alias("id"), (F.col("pair").cast("long") % 2 == 0).alias("same"))
    asked = o.groupBy("id").agg(F.array_sort(F.collect_list("pair")).alias("pairs"), F.array_sort(F.collect_list(row)).alias("said"))
    said = F.when(F.col("id") % 4 == 0, F.slice("said", F.lit(2), F.size("said"))).otherwise(F.col("said"))
    text = F.to_json(F.struct(said.alias("verdicts")))
    response = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))
    good, _ = answers.adjudicated(asked.select("id", "pairs", response.alias("response")))
    return good.select(F.col("id").cast("long").alias("pair"), "same")
