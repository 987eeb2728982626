"""Named queries over the standard tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY_MS, MAX_AGE_MS, MESSAGE_STATUSES, WEEK_MS, WEIGHTS
from ..functions import match, text
from ..functions.dates import date_key, iso_timestamp
from ..operators import calibrate, captions, dashboard, grid, items, metrics, pairs, publish, stories, tables, work
from . import views
from .views import NOW_MS, SCRAPE_MS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from . import console, edits, live, records  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import console, edits, live, records  # noqa: F401

    return dict(_SQL)


def _keyed(spark, sf):
    return stories.with_key(views.items(spark, sf)).select("id", "date", "key")


def _scores(spark, sf):
    """Pairs of a day, each once; later items look back at earlier ones."""
    return pairs.once(_keyed(spark, sf), WEIGHTS)


@query(f"WITH {views.KEYS_SQL} SELECT id, date, array_to_string(e, '|') AS entities, array_to_string(t, '|') AS title_tokens, array_to_string(g, '|') AS tags FROM keys")
def match_key(spark, sf):
    k = _keyed(spark, sf)
    return k.select("id", "date", F.array_join("key.entities", "|").alias("entities"), F.array_join("key.titleTokens", "|").alias("title_tokens"), F.array_join("key.tags", "|").alias("tags"))


@query(f"WITH {views.SCORES_SQL} SELECT date, item, story, round(score, 6) AS score FROM scores")
def pair_scores(spark, sf):
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


@query(f"WITH {views.SCORES_SQL} SELECT CASE WHEN score >= 0.72 THEN 'merge' WHEN score <= 0.35 THEN 'distinct' ELSE 'adjudicate' END AS verdict, count(*) AS n FROM scores GROUP BY 1")
def band_verdicts(spark, sf):
    return pairs.counts(_keyed(spark, sf), WEIGHTS).groupBy(match.classify("score").alias("verdict")).agg(F.sum("n").alias("n"))


@query(f"WITH {views.SCORES_SQL} SELECT item, story, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, story) = 1")
def best_candidate(spark, sf):
    rows = stories.best_candidate(pairs.best(_keyed(spark, sf), WEIGHTS).withColumn("score", F.round("score", 9)))
    return rows.select("item", "story", F.round("score", 6).alias("score"))


_PAIRS_SQL = f"WITH {views.SCORES_SQL}, pairs AS (SELECT s.score, a.g[2] = b.g[2] AS same FROM scores s JOIN keys a ON a.id = s.item JOIN keys b ON b.id = s.story)"


def _labelled(spark, sf):
    """How many pairs of a day that share a term score so; the same site is the same story."""
    counted = pairs.counts(_keyed(spark, sf), WEIGHTS, F.element_at("key.tags", 2))
    return counted.select(F.round("score", 9).alias("score"), "same", "n")


@query(
    _PAIRS_SQL
    + """, steps AS (SELECT unnest(range(0, 101, 10)) / 100.0 AS v),
grid AS (SELECT CAST(d.v AS DOUBLE) AS d, CAST(m.v AS DOUBLE) AS m FROM steps d JOIN steps m ON d.v <= m.v)
SELECT d AS "distinctThreshold", m AS "mergeThreshold",
  round(sum(CASE WHEN score >= m AND same THEN 1 ELSE 0 END) / CAST(nullif(sum(CASE WHEN score >= m THEN 1 ELSE 0 END), 0) AS DOUBLE), 6) AS "autoMergePrecision",
  round(sum(CASE WHEN score < m AND score <= d AND NOT same THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN NOT same THEN 1 ELSE 0 END) AS DOUBLE), 6) AS "autoSplitRecall",
  round(sum(CASE WHEN score < m AND score > d THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS "bandFraction"
FROM grid CROSS JOIN (SELECT round(score, 9) AS score, coalesce(same, false) AS same FROM pairs) GROUP BY d, m"""
)
def calibration_curve(spark, sf):
    curve = calibrate.sweep(_labelled(spark, sf), 0.1)
    return curve.select("distinctThreshold", "mergeThreshold", *[F.round(c, 6).alias(c) for c in ("autoMergePrecision", "autoSplitRecall", "bandFraction")])


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, bool_and(same) AS same FROM (
  SELECT l_orderkey AS a, l_partkey + 10000000 AS b, true AS same FROM lineitem UNION ALL SELECT l_partkey + 10000000, l_orderkey, true FROM lineitem) GROUP BY 1, 2""")
def distinct_labelled_pairs(spark, sf):
    li = views.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("x"), (F.col("l_partkey") + 10_000_000).alias("y"))
    both = li.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(li.select(F.col("y").alias("a"), F.col("x").alias("b")))
    return calibrate.distinct_pairs(both.withColumn("label", F.lit("same"))).select("a", "b", "same")


@query(f"WITH {views.SOURCES_SQL} SELECT id, dueAt AS \"dueAt\" FROM due WHERE dueAt <= {NOW_MS} ORDER BY lastUpdated, id LIMIT 10")
def due_sources(spark, sf):
    return items.select_sources(views.sources(spark, sf), NOW_MS).select("id", "dueAt")


@query(f"WITH {views.SOURCES_SQL}, nxt AS (SELECT id FROM due WHERE dueAt <= {NOW_MS} ORDER BY lastUpdated, id LIMIT 10) SELECT id, 'telegram' AS type, dueAt AS \"dueAt\", id IN (SELECT id FROM nxt) AS next, lastCount AS \"lastCount\", lastError AS \"lastError\" FROM due")
def source_previews(spark, sf):
    return items.source_previews(views.sources(spark, sf), NOW_MS)


_KIND_SQL = f"""CASE WHEN e.ts IS NULL OR {SCRAPE_MS} - (epoch_us(e.ts) // 1000) > {MAX_AGE_MS} THEN 'obsolete' WHEN d.doc_id % 11 = 0 THEN 'forward'
  WHEN regexp_replace(d.text, '[\\t\\n\\x0B\\f\\r ]', '', 'g') = '' THEN 'empty' ELSE 'post' END"""


def _kinds(spark, sf):
    return views.posts(spark, sf).withColumn("kind", items.item_kind("body", "forwardedFrom", iso_timestamp("at"), SCRAPE_MS))


@query(f"SELECT d.source || '/' || d.doc_id AS id, {_KIND_SQL} AS kind FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id")
def post_kinds(spark, sf):
    return _kinds(spark, sf).select(F.concat_ws("/", "source_id", "id").alias("id"), "kind")


@query(f"SELECT d.source, {_KIND_SQL} AS kind, count(*) AS n FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id GROUP BY 1, 2")
def items_by_kind(spark, sf):
    return _kinds(spark, sf).groupBy(F.col("source_id").alias("source"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT source AS id, CAST(arg_max(CAST(doc_id AS VARCHAR), doc_id) AS VARCHAR) AS "lastItemId", count(*) AS "lastCount", 0 AS "zeroYieldRuns" FROM documents GROUP BY 1""")
def source_cursors(spark, sf):
    p = views.posts(spark, sf)
    known = p.select(F.col("source_id").alias("id")).distinct().selectExpr("id", "'' lastItemId", "0L zeroYieldRuns", "0L lastNonZeroCount")
    return items.cursors(p, known, NOW_MS).select("id", "lastItemId", "lastCount", "zeroYieldRuns")


@query(r"""SELECT doc_id, length(CASE WHEN lang = 'en' THEN trim(replace(text, 'the ', ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') ELSE text END) AS n,
  md5(CASE WHEN lang = 'en' THEN trim(replace(text, 'the ', ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') ELSE text END) AS digest FROM documents""")
def teaser_stripped(spark, sf):
    d = views.load(spark, sf, "documents")
    body = text.strip_teaser("text", F.when(F.col("lang") == "en", "the "))
    return d.select("doc_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("digest"))


_ROUTE_SQL = """SELECT d.doc_id, CASE WHEN regexp_replace(d.text, '[\\t\\n\\x0B\\f\\r ]', '', 'g') = '' THEN 'drop' WHEN d.lang = 'fr' THEN 'retry' WHEN l.quality = 0 THEN 'drop' WHEN d.lang = 'es' THEN 'drop' ELSE 'enqueue' END AS decision,
  CASE WHEN regexp_replace(d.text, '[\\t\\n\\x0B\\f\\r ]', '', 'g') = '' THEN 'nobody' WHEN d.lang = 'fr' THEN 'no-category' WHEN l.quality = 0 THEN 'low' WHEN d.lang = 'es' THEN 'category' END AS reason
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)"""


@query(_ROUTE_SQL)
def route_decisions(spark, sf):
    d = views.load(spark, sf, "documents")
    quality = views.load(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    category = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "es", "crime&law").otherwise("politics")
    rows = d.join(quality, "doc_id", "left").withColumn("r", items.route(category, F.when(F.col("quality") == 0, "low")))
    early = items.prefilter("text")
    return rows.select("doc_id", F.when(early.isNotNull(), "drop").otherwise(F.col("r.decision")).alias("decision"), F.coalesce(early, F.col("r.reason")).alias("reason"))


_TAGS_SQL = """tagged AS (SELECT c_custkey AS id, [lower(trim(c_mktsegment)), 'n' || c_nationkey, 'all-news'] AS tags, CAST(c_nationkey AS VARCHAR) AS date FROM customer),
dict AS (SELECT 'r' || n_regionkey AS id, 'n' || n_nationkey AS word FROM nation UNION ALL SELECT 'home', 'household')"""


def _tagged(spark, sf):
    c = views.load(spark, sf, "customer")
    tags = text.merge_tags(F.array(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))), F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit("All  News"), F.lit("all news"), F.lit("")))
    return c.select(F.col("c_custkey").alias("id"), tags.alias("tags"), F.col("c_nationkey").cast("string").alias("date"))


def _dictionary(spark, sf):
    n = views.load(spark, sf, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.collect_set(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("keywords"))
    more = spark.createDataFrame([("home", ["household"])], "id string, keywords array<string>")
    return n.unionByName(more).withColumns({"deleted": F.lit(None).cast("boolean"), "count": F.lit(0).cast("long"), "lastDate": F.lit(None).cast("string")})


@query(f"WITH {_TAGS_SQL} SELECT id, array_to_string(tags, '|') AS tags FROM tagged")
def merged_tags(spark, sf):
    return _tagged(spark, sf).select("id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {_TAGS_SQL}, one AS (SELECT id, unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM tagged) SELECT one.id, string_agg(coalesce(dict.id, t), '|' ORDER BY pos, coalesce(dict.id, t)) AS tags FROM one LEFT JOIN dict ON dict.word = one.t GROUP BY one.id")
def mapped_tags(spark, sf):
    return items.map_tags(_tagged(spark, sf), _dictionary(spark, sf)).select("id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {_TAGS_SQL} SELECT t AS id, count(*) AS count, max(date) AS \"lastDate\" FROM (SELECT unnest(tags) AS t, date FROM tagged) GROUP BY 1")
def tag_encounters(spark, sf):
    none = _dictionary(spark, sf).where("id is null")
    return items.tag_encounters(_tagged(spark, sf), none).select("id", "count", "lastDate")


_RECEIVE_SQL = f"""WITH {views.MESSAGES_SQL}, {views.TARGETS_SQL},
hits AS (SELECT m.id AS message, t.id AS target FROM messages m JOIN targets t ON len(t.tags) > 0 AND list_has_all(m.tags, [lower(x) FOR x IN t.tags]))"""


@query(_RECEIVE_SQL + " SELECT message, target FROM hits")
def target_receivers(spark, sf):
    return publish.receivers(views.messages(spark, sf), views.targets(spark, sf))


@query(_RECEIVE_SQL + " SELECT id FROM messages WHERE id NOT IN (SELECT message FROM hits)")
def no_target_messages(spark, sf):
    return publish.unmatched(views.messages(spark, sf), views.targets(spark, sf)).select("id")


@query(_RECEIVE_SQL + " SELECT message, target, CAST(NULL AS VARCHAR) AS \"tgId\", CAST(NULL AS VARCHAR) AS url FROM hits")
def post_rows(spark, sf):
    return publish.post_rows(views.messages(spark, sf), views.targets(spark, sf))


_TAG_SQL = "'#' || lower(regexp_replace(regexp_replace({0}, '[\\t\\n\\x0B\\f\\r -]', '_', 'g'), '[.,@!''\"()]', '', 'g'))"
_LINE_SQL = f"""array_to_string(list_filter([{_TAG_SQL.format('x')} FOR x IN list_concat(
    CASE WHEN location IS NULL THEN [] ELSE ['Old Town', 'St. John''s'] END, ['People One'], tags,
    list_filter(string_split(title, ' '), lambda w: length(w) > 4), ['date_' || date, 'ts_' || ts])], lambda x: x <> '#'), ' ')"""


@query(f"WITH {views.MESSAGES_SQL} SELECT id, {_LINE_SQL} AS line FROM messages")
def hashtag_lines(spark, sf):
    return views.messages(spark, sf).select("id", text.hashtag_line("location", "peoples", "tags", "title", "date", "ts").alias("line"))


_HEAD_SQL = """'<b>⚡️</b> <i>' || date || '</i>' || CASE WHEN country IS NULL AND location IS NULL THEN '' ELSE ' <b>' || concat_ws(', ', upper(country), location) || '</b>' END"""


@query(f"WITH {views.MESSAGES_SQL} SELECT id, {_HEAD_SQL} AS header FROM messages")
def headers(spark, sf):
    return views.messages(spark, sf).select("id", text.header("date", "country", "location").alias("header"))


_BLOCKS_SQL = f"""{views.MESSAGES_SQL},
lines AS (
  SELECT l_orderkey, (epoch_us(l_shipdate) // 1000) AS ts, 's' || l_suppkey || '/' || l_partkey || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS mid,
         '🔘 <a href="http://x/?a=1&amp;p=' || l_partkey || '">part</a> &amp; ' || l_returnflag || ' &lt;' || l_linestatus || '&gt; ' || l_suppkey
         || ' - <a href="https://t.me/s' || l_suppkey || '/' || l_partkey || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '">@c' || l_suppkey || '</a>' AS line
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey, l_linenumber ORDER BY l_shipdate, l_returnflag, l_linestatus) = 1),
blocks AS (
  SELECT l_orderkey, string_agg(line, chr(10) ORDER BY ts, mid) AS body, count(*) AS n FROM (
    SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ts, mid) <= 12) GROUP BY 1)"""


@query(f"WITH {_BLOCKS_SQL} SELECT id, coalesce(body, '') AS body FROM messages LEFT JOIN blocks ON l_orderkey = o_orderkey")
def member_blocks(spark, sf):
    return views.messages(spark, sf).select("id", F.coalesce(F.array_join(publish.rendered_members(), "\n"), F.lit("")).alias("body"))


@query(
    f"""WITH {_BLOCKS_SQL}, {views.TARGETS_SQL},
hits AS (SELECT m.id AS message, t.id AS target FROM messages m JOIN targets t ON len(t.tags) > 0 AND list_has_all(m.tags, [lower(x) FOR x IN t.tags])),
full_text AS (
  SELECT m.id, m.image, {_HEAD_SQL} || chr(10) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END || chr(10) || chr(10) || {_LINE_SQL} AS text
  FROM messages m LEFT JOIN blocks ON l_orderkey = o_orderkey WHERE status = 'topublish')
SELECT id, target, md5(text) AS digest, CASE WHEN image IS NOT NULL AND 2 * length(text) - length(replace(text, '🔘', '')) <= 1012 THEN 'sendPhoto' ELSE 'sendMessage' END AS method, '@' || target AS "chatId"
FROM full_text JOIN hits ON message = id"""
)
def assembled_sends(spark, sf):
    """No text here passes the length limit; fitted_texts has many that do.  The
    members' sign is the one character of two UTF-16 units, which the SQL counts."""
    rows = publish.sends(views.messages(spark, sf), views.targets(spark, sf))
    return rows.select("id", "target", F.md5("text").alias("digest"), "method", "chatId")


@query(f"WITH {views.FACTS_SQL} SELECT * FROM facts")
def hourly_metrics(spark, sf):
    return metrics.facts(views.facts(spark, sf))


@query(f"WITH {views.FACTS_SQL} SELECT hour, name, NULL AS \"by\", CAST(sum(value) AS BIGINT) AS value, 1 AS is_total FROM facts GROUP BY 1, 2 UNION ALL SELECT hour, name, \"by\", value, 0 FROM facts")
def metric_splits(spark, sf):
    return metrics.with_splits(metrics.facts(views.facts(spark, sf))).select("hour", "name", "by", "value", F.col("is_total").cast("int").alias("is_total"))


@query(f"WITH {views.FACTS_SQL} SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM facts WHERE name = 'click' AND hour >= {(NOW_MS - DAY_MS) // 3_600_000 * 3_600_000} AND hour < {NOW_MS}")
def metric_day_total(spark, sf):
    return metrics.total(metrics.facts(views.facts(spark, sf)), "click", NOW_MS - DAY_MS, NOW_MS)


@query(f"WITH {views.FACTS_SQL} SELECT \"by\", CAST(sum(value) AS BIGINT) AS total FROM facts WHERE name = 'view' AND hour >= {(NOW_MS - WEEK_MS) // 3_600_000 * 3_600_000} AND hour < {NOW_MS} GROUP BY 1")
def metric_week_by_key(spark, sf):
    return metrics.by_key(metrics.facts(views.facts(spark, sf)), "view", NOW_MS - WEEK_MS, NOW_MS)


@query(f"WITH {views.MESSAGES_SQL} SELECT s.pos, s.status, count(m.id) AS n FROM (SELECT unnest({list(MESSAGE_STATUSES)}) AS status, generate_subscripts({list(MESSAGE_STATUSES)}, 1) - 1 AS pos) s LEFT JOIN messages m USING (status) GROUP BY ALL")
def status_counts(spark, sf):
    return dashboard.status_counts(views.messages(spark, sf))


@query(f"WITH {views.MESSAGES_SQL} SELECT status, count(*) AS n FROM messages GROUP BY ROLLUP (status)")
def status_totals(spark, sf):
    return dashboard.status_totals(views.messages(spark, sf))


@query(f"WITH {views.MESSAGES_SQL} SELECT id, status, ts FROM messages ORDER BY ts DESC, id LIMIT 3")
def recent_messages(spark, sf):
    return dashboard.recent_messages(views.messages(spark, sf)).select("id", "status", "ts")


@query(f"""WITH {views.MESSAGES_SQL}, w AS (SELECT * FROM messages WHERE status IN ('published', 'topublish') QUALIFY row_number() OVER (PARTITION BY status ORDER BY ts DESC, id) <= 200),
h AS (SELECT * FROM w WHERE list_has_any(tags, ['p-1', 'n7'])) SELECT id, ts, (SELECT count(*) FROM h) AS matched FROM h ORDER BY ts DESC, id LIMIT 10""")
def found_by_tags(spark, sf):
    return dashboard.find_by_tags(views.messages(spark, sf), ["P-1", " N7 "]).select("id", "ts", "matched")


@query(f"""WITH {views.MESSAGES_SQL}, a AS (SELECT 'web/' || event_id AS id, (epoch_us(ts) // 1000) AS at FROM events WHERE event_type = 'error')
SELECT id, status, (SELECT count(*) FROM a WHERE a.id = m.id) AS errors FROM messages m WHERE status = 'published'""")
def open_errors(spark, sf):
    e = views.load(spark, sf, "events")
    audit = e.where("event_type = 'error'").select(F.concat(F.lit("web/"), F.col("event_id").cast("string")).alias("messageId"), F.lit("t").alias("target"), views.millis(e, "ts").alias("at"))
    return dashboard.message_list(views.messages(spark, sf), audit, "published").select("id", "status", "errors")


@query(f"WITH {views.WORK_SQL} SELECT stage, count(*) AS n FROM work WHERE status IN ('pending', 'running') GROUP BY 1")
def queue_depth(spark, sf):
    return dashboard.queue_depth(views.work_items(spark, sf)).select("stage", "n")


@query(f"WITH {views.WORK_SQL} SELECT id, status, \"runAt\", ref, text FROM work WHERE stage = 'analyze' AND status IN ('pending', 'running') ORDER BY \"runAt\", id LIMIT 10")
def queue_preview(spark, sf):
    return work.previews(work.waiting(views.work_items(spark, sf), "analyze")).select("id", "status", "runAt", "ref", "text")


@query(f"WITH {views.WORK_SQL} SELECT id, \"runAt\" FROM work WHERE stage = 'publish' AND status = 'pending' AND \"runAt\" <= {NOW_MS} ORDER BY \"runAt\", id LIMIT 5")
def claim_due(spark, sf):
    return work.due(views.work_items(spark, sf), "publish", NOW_MS, 5).select("id", "runAt")


@query(f"WITH {views.WORK_SQL} SELECT id, \"finishedAt\" FROM work WHERE status = 'error' ORDER BY \"finishedAt\", id LIMIT 50")
def error_page(spark, sf):
    return work.errors(views.work_items(spark, sf)).select("id", "finishedAt")


@query(f"""WITH {views.WORK_SQL} SELECT id, CASE WHEN status = 'running' AND "leaseUntil" < {NOW_MS} THEN CASE WHEN "retryCount" + 1 >= CASE stage WHEN 'publish' THEN 5 ELSE 3 END THEN 'error' ELSE 'pending' END ELSE status END AS status,
 CASE WHEN status = 'running' AND "leaseUntil" < {NOW_MS} AND "retryCount" + 1 < CASE stage WHEN 'publish' THEN 5 ELSE 3 END THEN {NOW_MS} + CAST(30000 * pow(2, "retryCount") AS BIGINT) ELSE "runAt" END AS "runAt",
 CAST("retryCount" + CASE WHEN status = 'running' AND "leaseUntil" < {NOW_MS} THEN 1 ELSE 0 END AS BIGINT) AS "retryCount" FROM work""")
def reclaimed_leases(spark, sf):
    return work.reclaim(views.work_items(spark, sf), NOW_MS).select("id", "status", "runAt", "retryCount")


@query("""SELECT sha1(user_id || '@' || ((epoch_us(ts) // 1000) // 300000)) AS id, CAST(user_id AS VARCHAR) AS message, min((epoch_us(ts) // 1000)) + 300000 AS "runAt" FROM events GROUP BY user_id, (epoch_us(ts) // 1000) // 300000""")
def publish_requests(spark, sf):
    e = views.load(spark, sf, "events")
    return work.publish_requests(e.select(F.col("user_id").cast("string").alias("message"), views.millis(e, "ts").alias("at")))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(CAST(p_size AS VARCHAR), 'red')")
def keyword_search(spark, sf):
    return grid.keyword(views.load(spark, sf, "part"), "  RED ", ["p_name", "p_type", "p_size"]).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'ring') AND contains(CAST(p_size AS VARCHAR), '1')")
def column_filter(spark, sf):
    return grid.column_filters(views.load(spark, sf, "part"), {"p_name": "Ring", "p_size": "1", "p_brand": " "}, ["p_name", "p_size"]).select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def table_sort(spark, sf):
    return grid.sort(views.load(spark, sf, "customer"), "c_acctbal", True, "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def table_sort_rank(spark, sf):
    return grid.ranked(views.load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", True, "c_custkey")


@query("SELECT p_partkey || ',' || CASE WHEN regexp_matches(p_name, '[\",\\n\\r]') THEN '\"' || replace(p_name, '\"', '\"\"') || '\"' ELSE p_name END || ',\"' || p_brand || ', ' || p_type || '\"' AS line FROM part")
def csv_export(spark, sf):
    p = views.load(spark, sf, "part").withColumn("both", F.concat_ws(", ", "p_brand", "p_type"))
    return dashboard.csv_lines(p, ["p_partkey", "p_name", "both"])


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS pos, event_type AS label, count(*) AS value FROM events GROUP BY event_type)
SELECT pos, label, value, round(value / CAST(sum(value) OVER () AS DOUBLE), 6) AS fraction, ['#4a9eff', '#3fb950', '#d29922', '#c3cfe0', '#a371f7'][pos + 1] AS color FROM s""")
def pie_slices(spark, sf):
    from pyspark.sql import Window

    s = views.load(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value"))
    s = s.withColumn("pos", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return grid.pie(s).select("pos", "label", "value", F.round("fraction", 6).alias("fraction"), "color")


@query("""SELECT c_custkey AS id, CASE WHEN o.n IS NOT NULL THEN 'buyer' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def upsert_patch(spark, sf):
    base = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    changes = views.load(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("segment", F.lit("buyer")).join(base.select("id"), "id", "left_semi")
    return tables.patch(base, changes)


@query("SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS deleted FROM customer")
def soft_delete(spark, sf):
    base = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(False).alias("deleted"))
    gone = views.load(spark, sf, "orders").select(F.col("o_custkey").alias("id")).join(base, "id", "left_semi")
    return tables.soft_delete(base, gone)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def stale_documents(spark, sf):
    snapshot = views.load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    return tables.stale(views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id")), snapshot)


_TALK_SQL = r"""WITH RECURSIVE l AS (
  SELECT conv_id, start, said, row_number() OVER (PARTITION BY conv_id ORDER BY start, said) AS n
  FROM (SELECT conv_id, 10 * turn AS start, trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS said FROM conversations) WHERE said <> ''),
st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, t VARCHAR)[]) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT st.conv_id, l.n, CASE WHEN len(c) > 0 AND start - c[-1].s < 25 THEN list_append(c[:-2], {'s': c[-1].s, 't': c[-1].t || ' ' || said}) ELSE list_append(c, {'s': start, 't': said}) END
  FROM st JOIN l ON l.conv_id = st.conv_id AND l.n = st.n + 1),
e AS (SELECT conv_id, c, 'https://www.youtube.com/watch?v=' || conv_id AS url FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT conv_id, CAST(len(c) AS BIGINT) AS n_chunks, md5('# Talk ' || conv_id || chr(10) || chr(10) || url || chr(10) || chr(10) || '> channel · 1:02:05 · captions: en' || chr(10) || chr(10) || array_to_string(
  ['- [' || CASE WHEN x.s < 3600 THEN printf('%02d:%02d', x.s // 60, x.s % 60) ELSE printf('%d:%02d:%02d', x.s // 3600, x.s % 3600 // 60, x.s % 60) END || '](' || url || '&t=' || x.s || 's) ' || x.t FOR x IN c], chr(10)) || chr(10)) AS digest FROM e"""


@query(_TALK_SQL)
def transcripts(spark, sf):
    """One transcript for each conversation: a caption line every ten seconds."""
    c = views.load(spark, sf, "conversations").select("conv_id", F.struct((F.col("turn") * 10).cast("long").alias("start"), text.squeeze(F.coalesce("text", F.lit(""))).alias("text")).alias("line"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    rows = rows.withColumn("parts", captions.chunks(F.filter("lines", lambda x: x["text"] != "")))
    body = captions.transcript(F.col("conv_id").cast("string"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")), F.lit("channel"), F.lit(3725), F.lit("en"), "parts")
    return rows.select("conv_id", F.size("parts").cast("long").alias("n_chunks"), F.md5(body).alias("digest"))


@query(f"WITH {views.FACTS_SQL} SELECT strftime(make_timestamp(hour * 1000), '%Y-%m-%d') AS day, CAST(sum(value) AS BIGINT) AS n FROM facts GROUP BY 1")
def events_by_day(spark, sf):
    return metrics.facts(views.facts(spark, sf)).groupBy(date_key("hour").alias("day")).agg(F.sum("value").alias("n"))
