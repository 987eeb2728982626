"""Adapters from the star-schema and text tables to the library's tables.

Each view has one definition here and one as SQL text with the same meaning, so
that results can be compared with any SQL engine.  All rows take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_706_572_800_000  # 2024-01-30T00:00:00Z
SCRAPE_MS = 1_704_412_800_000  # 2024-01-05T00:00:00Z, when some posts are old and some are not


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(df: DataFrame, c: str) -> Column:
    """Epoch milliseconds of a timestamp, with or without a zone."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    return F.unix_millis(c)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyzed items: pages by title, host and language of their address."""
    p = load(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    names = F.array_join(F.regexp_extract_all(title, F.lit(r"([A-Za-z]{7,})"), F.lit(1)), ",")
    return p.select(
        F.concat(F.lit("web/"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").alias("seq"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("date"), title.alias("title"),
        F.lit(None).cast("string").alias("peoples"), names.alias("properNames"), F.array(lang, host).alias("tags"), F.lit("politics").alias("category"),
        F.lit(None).cast("string").alias("image"), F.upper(lang).alias("country"), host.alias("location"), F.col("html").alias("body"),
    )


ITEMS_SQL = r"""items AS (
  SELECT 'web/' || page_id AS id, page_id AS seq, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         array_to_string(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '([A-Za-z]{7,})', 1), ',') AS properNames,
         [regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1), regexp_extract(url, '^https?://([^/]+)/', 1)] AS tags
  FROM pages)"""

_CANON = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\t\n\x0B\f\r -]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'))"
KEYS_SQL = (
    ITEMS_SQL
    + f""",
keys AS (
  SELECT id, date,
    list_sort(list_distinct(list_filter([{_CANON.format('x')} FOR x IN string_split(properNames, ',')], lambda x: x <> '')))[1:256] AS e,
    list_sort(list_distinct(list_filter(string_split({_CANON.format('title')}, ' '), lambda x: x <> '')))[1:256] AS t,
    list_sort(list_distinct(list_filter(tags, lambda x: x <> '')))[1:256] AS g
  FROM items)"""
)
_J = "CASE WHEN len(list_distinct(list_concat(a.{0}, b.{0}))) = 0 THEN 0.0 ELSE len(list_intersect(a.{0}, b.{0})) / CAST(len(list_distinct(list_concat(a.{0}, b.{0}))) AS DOUBLE) END"
SCORES_SQL = (
    KEYS_SQL
    + f""",
scores AS (
  SELECT a.date, a.id AS item, b.id AS story, 0.6 * {_J.format('e')} + 0.25 * {_J.format('t')} + 0.15 * {_J.format('g')} AS score
  FROM keys a JOIN keys b ON a.date = b.date AND a.id > b.id
  WHERE len(list_intersect(a.e, b.e)) + len(list_intersect(a.t, b.t)) + len(list_intersect(a.g, b.g)) > 0)"""
)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel posts: documents with the time of the event of their number."""
    d, e = load(spark, sf_dir, "documents"), load(spark, sf_dir, "events")
    at = millis(e, "ts")
    e = e.select(F.col("event_id").alias("doc_id"), at.alias("at"))
    origin = F.when(F.col("doc_id") % 11 == 0, F.lit("elsewhere"))
    return d.join(e, "doc_id", "left").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), origin.alias("forwardedFrom"), "at", "lang")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories: orders, with their lines as members."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "topublish").otherwise("no_target")
    link = F.struct(F.lit(1).cast("long").alias("id"), F.concat(F.lit("http://x/?a=1&p="), F.col("l_partkey").cast("string")).alias("href"))
    said = F.concat(F.lit("[part](#1) & "), F.col("l_returnflag"), F.lit(" <"), F.col("l_linestatus"), F.lit("> ["), F.col("l_suppkey").cast("string"), F.lit("](#2)"))
    block = F.struct(said.alias("summary"), F.array(link).alias("links"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("channel"), millis(li, "l_shipdate").alias("ts"))
    key = F.concat_ws("/", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.col("l_partkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")))
    member = li.select("l_orderkey", F.struct(key.alias("key"), "l_shipdate", "l_returnflag", "l_linestatus", block.alias("value")).alias("m"))
    # lines that repeat a key count once, the earliest
    lines = member.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("m")).alias("m"))
    first = F.filter("m", lambda x, i: (i == 0) | (F.get("m", i - 1)["key"] != x["key"]))
    members = lines.select("l_orderkey", F.map_from_entries(F.transform(first, lambda x: F.struct(x["key"], x["value"]))).alias("members"))
    base = o.select(
        F.concat(F.lit("web/"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderkey", status.alias("status"), (millis(o, "o_orderdate") + F.col("o_orderkey")).alias("ts"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lower(F.regexp_replace("o_orderpriority", "[0-9]-", "")).alias("title"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string"))).alias("country"), F.when(F.col("o_custkey") % 5 != 0, F.lit("Old Town, St. John's")).alias("location"),
        F.lit("People One, none").alias("peoples"), F.array(F.lower("o_orderstatus"), F.concat(F.lit("p-"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string"))).alias("tags"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("https://img/x.png")).alias("image"), F.lit(False).alias("deleted"), F.lit("").alias("tgChannel"), F.lit(None).cast("string").alias("tgId"), F.lit(None).cast("long").alias("tgAt"),
    )
    rows = base.join(members, base["o_orderkey"] == members["l_orderkey"], "left").drop("l_orderkey")
    return rows.withColumn("posts", F.expr("cast(map() as map<string, struct<tgId: string, tgAt: bigint>>)"))


MESSAGES_SQL = r"""messages AS (
  SELECT 'web/' || o_orderkey AS id, o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'topublish' ELSE 'no_target' END AS status,
         (epoch_us(o_orderdate) // 1000) + o_orderkey AS ts, strftime(o_orderdate, '%Y-%m-%d') AS date,
         lower(regexp_replace(o_orderpriority, '[0-9]-', '', 'g')) AS title,
         CASE WHEN o_custkey % 3 <> 0 THEN 'c' || (o_custkey % 25) END AS country,
         CASE WHEN o_custkey % 5 <> 0 THEN 'Old Town, St. John''s' END AS location,
         [lower(o_orderstatus), 'p-' || substr(o_orderpriority, 1, 1), 'n' || (o_custkey % 25)] AS tags,
         CASE WHEN o_orderkey % 2 = 0 THEN 'https://img/x.png' END AS image
  FROM orders)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations: nations, with one or two tags; region 0's have none."""
    n = load(spark, sf_dir, "nation")
    tag = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    tags = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).when(F.col("n_regionkey") == 1, F.array(tag, F.lit("F"))).otherwise(F.array(tag))
    return n.select(F.lower("n_name").alias("id"), tags.alias("tags"), F.lit(None).cast("string").alias("messageTemplate"), F.lit(False).alias("deleted"))


TARGETS_SQL = """targets AS (
  SELECT lower(n_name) AS id, CASE n_regionkey WHEN 0 THEN [] WHEN 1 THEN ['N' || n_nationkey, 'F'] ELSE ['N' || n_nationkey] END AS tags FROM nation)"""


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue items: events; every user's third of stages, states by type."""
    e = load(spark, sf_dir, "events")
    stage = F.element_at(F.array(F.lit("analyze"), F.lit("aggregate"), F.lit("publish")), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("pending")
    at = millis(e, "ts")
    raw = F.concat(F.lit('{"id": "e/'), F.col("event_id").cast("string"), F.lit('", "title": "'), F.col("event_type"), F.lit('"}'))
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("id"), stage.alias("stage"), status.alias("status"), raw.alias("raw"), (F.col("user_id") % 3).cast("long").alias("retryCount"), at.alias("runAt"),
        F.when(status == "running", at + 600_000).alias("leaseUntil"), none.alias("error"), none.alias("cause"), F.lit(None).cast("struct<summary: string, cause: string, fix: string, at: bigint>").alias("diagnosis"),
        at.alias("createdAt"), F.lit(None).cast("long").alias("startedAt"), F.when(status.isin("error", "done"), at + 1000).alias("finishedAt"), F.lit(None).cast("timestamp").alias("expireAt"),
    )


WORK_SQL = """work AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ['analyze', 'aggregate', 'publish'][event_id % 3 + 1] AS stage,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'pending' END AS status,
         'e/' || event_id AS ref, event_type AS text, user_id % 3 AS retryCount, (epoch_us(ts) // 1000) AS runAt, (epoch_us(ts) // 1000) AS createdAt,
         CASE WHEN event_type IN ('error', 'purchase') THEN (epoch_us(ts) // 1000) + 1000 END AS finishedAt,
         CASE WHEN event_type = 'click' THEN (epoch_us(ts) // 1000) + 600000 END AS leaseUntil
  FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter events: one for each event, split by a tenth of users."""
    e = load(spark, sf_dir, "events")
    return e.select(millis(e, "ts").alias("at"), F.col("event_type").alias("name"), (F.col("user_id") % 10).cast("string").alias("by"), F.lit(1).cast("long").alias("value"))


FACTS_SQL = """facts AS (
  SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS hour, event_type AS name, CAST(user_id % 10 AS VARCHAR) AS "by", CAST(count(*) AS BIGINT) AS value
  FROM events GROUP BY ALL)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds: suppliers, with page sizes and times from their balances."""
    s = load(spark, sf_dir, "supplier")
    n = F.pmod(F.floor("s_acctbal").cast("long"), F.lit(26))
    return s.select(
        F.col("s_name").alias("id"), F.when(F.col("s_nationkey") % 7 == 0, "paused").otherwise("ok").alias("status"), F.lit("telegram").alias("type"), n.alias("lastCount"),
        (F.lit(NOW_MS) - F.floor(F.abs("s_acctbal")).cast("long") * 3000).alias("lastUpdated"), F.when(F.col("s_suppkey") % 4 == 0, "timeout").alias("lastError"), F.lit(None).cast("boolean").alias("deleted"),
    )


SOURCES_SQL = f"""sources AS (
  SELECT s_name AS id, CASE WHEN s_nationkey % 7 = 0 THEN 'paused' ELSE 'ok' END AS status,
         ((CAST(floor(s_acctbal) AS BIGINT) % 26) + 26) % 26 AS lastCount,
         {NOW_MS} - CAST(floor(abs(s_acctbal)) AS BIGINT) * 3000 AS lastUpdated,
         CASE WHEN s_suppkey % 4 = 0 THEN 'timeout' END AS lastError
  FROM supplier),
due AS (
  SELECT *, lastUpdated + CASE WHEN lastCount > 20 THEN 0 WHEN lastCount > 0 THEN 1800000 ELSE 14400000 END AS dueAt FROM sources WHERE status = 'ok')"""
