"""Named queries of edits, readers and endpoints, each with its SQL.

Readers and endpoints work on files that the query writes from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import calibrate, console, tables, work
from ..operators.graph import shared_folder
from ..sinks import sends
from ..sources import readers
from ..sources.channels import ChannelPosts
from ..streaming import flows
from . import views
from .queries import _labelled, _PAIRS_SQL, query
from .records import NEW, _people


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# -- edits


@query(f"SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey + {NEW}, 'new' FROM customer")
def added_rows(spark, sf):
    p = _people(spark, sf).drop("n")
    return tables.put_new(p, p.select((F.col("id") + NEW).alias("id"), F.lit("new").alias("name")))


@query(f"""WITH {views.WORK_SQL} SELECT id, status, CASE WHEN id = '12' AND status IN ('pending', 'error') THEN '{{"id": "e/12", "body": "b", "date": "2024-01-01", "title": "t", "summary": "s"}}'
  ELSE '{{"id": "' || ref || '", "title": "' || text || '"}}' END AS raw FROM work""")
def saved_raw(spark, sf):
    return work.save_raw(views.work_items(spark, sf), "12", '{"id": "e/12", "body": "b", "date": "2024-01-01", "title": "t", "summary": "s"}').select("id", "status", "raw")


@query(f"WITH {views.WORK_SQL}, e AS (SELECT min(CAST(id AS BIGINT)) AS k FROM work WHERE status = 'error') SELECT id, CASE WHEN CAST(id AS BIGINT) = k THEN 'what|why|how|5' END AS told FROM work, e WHERE status = 'error'")
def saved_diagnosis(spark, sf):
    items = views.work_items(spark, sf)
    first = items.where("status = 'error'").agg(F.min(F.col("id").cast("long")).alias("k")).first().k
    rows = work.save_diagnosis(items, str(first), "what", "why", "how", 5).where("status = 'error'")
    return rows.select("id", F.when(F.col("diagnosis").isNotNull(), F.concat_ws("|", "diagnosis.summary", "diagnosis.cause", "diagnosis.fix", F.col("diagnosis.at").cast("string"))).alias("told"))


@query("SELECT CAST(0 AS BIGINT) AS left_over, count(*) AS removed FROM events")
def reset_items(spark, sf):
    rows, n = console.reset_ingest(views.work_items(spark, sf))
    return rows.agg(F.count("*").alias("left_over")).select("left_over", F.lit(n).cast("long").alias("removed"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'k' || c_custkey ELSE '' END AS keywords, CAST(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS BIGINT) AS count, c_custkey % 3 = 0 AND c_custkey % 2 = 1 AS deleted FROM customer
UNION ALL SELECT 'new', 'fresh', 0, false""")
def upserted_tags(spark, sf):
    """Every third tag was deleted; half of all, and a new one, are edited."""
    c = views.load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array().cast("array<string>").alias("keywords"), F.col("c_nationkey").cast("long").alias("count"), F.lit("2024-01-01").alias("lastDate"), (F.col("c_custkey") % 3 == 0).alias("deleted"))
    edits = c.where(F.col("id").cast("long") % 2 == 0).select("id", F.array(F.concat(F.lit("k"), F.col("id"))).alias("keywords"))
    edits = edits.unionByName(spark.createDataFrame([("new", ["fresh"])], edits.schema))
    return console.upsert("tags", c, edits).select("id", F.array_join("keywords", ",").alias("keywords"), "count", F.coalesce("deleted", F.lit(False)).alias("deleted"))


_CURVE_SQL = (
    _PAIRS_SQL
    + """, steps AS (SELECT unnest(range(0, 101, 25)) / 100.0 AS v), g AS (SELECT CAST(d.v AS DOUBLE) AS d, CAST(m.v AS DOUBLE) AS m FROM steps d JOIN steps m ON d.v <= m.v),
s AS (SELECT round(score, 9) AS score, coalesce(same, false) AS same FROM pairs),
c AS (SELECT d, m, count(*) FILTER (score >= m AND same) AS ms, count(*) FILTER (score >= m) AS ma, count(*) FILTER (score < m AND score <= d AND NOT same) AS ok, count(*) FILTER (NOT same) AS dif, count(*) FILTER (score < m AND score > d) AS band, count(*) AS n FROM g CROSS JOIN s GROUP BY d, m)
SELECT 'distinctThreshold,mergeThreshold,autoMergePrecision,autoSplitRecall,bandFraction' AS line UNION ALL
SELECT d || ',' || m || ',' || coalesce(CAST(round(ms / CAST(nullif(ma, 0) AS DOUBLE), 3) AS VARCHAR), '') || ',' || round(ok / CAST(dif AS DOUBLE), 3) || ',' || round(band / CAST(n AS DOUBLE), 3) FROM c"""
)


@query(_CURVE_SQL)
def curve_lines(spark, sf):
    curve = calibrate.sweep(_labelled(spark, sf), 0.25)
    return calibrate.curve_csv(curve.withColumns({c: F.round(c, 3) for c in ("autoMergePrecision", "autoSplitRecall", "bandFraction")}))


@query("SELECT p_partkey AS id, lower(p_type) || '-' || p_size AS tag FROM part")
def tag_ids(spark, sf):
    p = views.load(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), console.tag_id(F.concat(F.lit("  "), F.col("p_type"), F.lit(" \t "), F.col("p_size").cast("string"))).alias("tag"))


@query("SELECT 'feed' || s_suppkey AS id, 'ok' AS status, 'telegram' AS type, false AS is_new FROM supplier UNION ALL SELECT 'freshfeed', 'ok', 'telegram', true")
def added_source(spark, sf):
    """An agent's new source beside those there are."""
    s = views.load(spark, sf, "supplier").select(F.concat(F.lit("feed"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("ok").alias("status"), F.lit("telegram").alias("type"), F.lit(None).cast("string").alias("teaser"))
    return console.add_source(s, {"id": "freshfeed", "teaser": "read more"}).select("id", "status", "type", (F.col("teaser").isNotNull()).alias("is_new"))


@query("SELECT c_name AS email, c_custkey % 2 = 0 AS enabled, lower(c_mktsegment) AS role FROM customer WHERE c_name = 'Customer#000000010'")
def whoami(spark, sf):
    users = views.load(spark, sf, "customer").select(F.col("c_name").alias("email"), (F.col("c_custkey") % 2 == 0).alias("enabled"), F.array(F.lower("c_mktsegment")).alias("roles"))
    return console.whoami(users, "Customer#000000010").select("email", "enabled", F.element_at("roles", 1).alias("role"))


# -- readers


@query("SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, CASE WHEN l_linenumber = 1 THEN 'same' ELSE 'different' END AS label FROM lineitem")
def read_pairs(spark, sf):
    """Labelled pairs, written as lines with blank ones between, read again."""
    li = views.load(spark, sf, "lineitem")
    line = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"), F.when(F.col("l_linenumber") == 1, "same").otherwise("different").alias("label")))
    path = _folder(spark, "pairs")
    li.select(F.concat(line, F.when(F.col("l_linenumber") == 2, "\n  ").otherwise("")).alias("value")).write.text(path)
    return readers.labelled_pairs(spark, path)


def _array_file(spark, rows, label: str) -> str:
    """A table as one JSON array, as calibration files and snapshots are."""
    path = _folder(spark, label)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return path


@query("SELECT 's/' || s_suppkey AS id, s_name AS title, 'n' || s_nationkey AS tag FROM supplier")
def read_items(spark, sf):
    s = views.load(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("tags"))
    return readers.calibration_items(spark, _array_file(spark, rows, "items")).select("id", "title", F.element_at("tags", 1).alias("tag"))


@query("SELECT s_name AS id, s_suppkey % 2 = 0 AS deleted FROM supplier")
def read_snapshot(spark, sf):
    rows = views.load(spark, sf, "supplier").select(F.col("s_name").alias("id"), (F.col("s_suppkey") % 2 == 0).alias("deleted"))
    return readers.snapshot(spark, _array_file(spark, rows, "snapshot"), "id string, deleted boolean")


_POSTS_SQL = "SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents WHERE source IS NOT NULL"


def _archive(spark, sf) -> tuple[str, str, str]:
    """(folder, channels, JSON of their newest ids): the documents as the posts of their sources."""
    posts = views.load(spark, sf, "documents").where("source is not null").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    path = _folder(spark, "archive")
    posts.write.partitionBy("source_id").json(path)
    newest = dict(posts.groupBy("source_id").agg(F.max(F.col("id").cast("long")).cast("string")).collect())  # the channels are what a reader is told
    spark.dataSource.register(ChannelPosts)
    return path, ",".join(sorted(newest)), json.dumps(newest)


@query(_POSTS_SQL)
def channel_archive(spark, sf):
    """Every file of every channel, in one batch."""
    path, channels, _ = _archive(spark, sf)
    rows = spark.read.format("channel_posts").option("channels", channels).option("folder", path).load()
    return rows.select("source_id", "id", F.md5("body").alias("digest"))


@query(_POSTS_SQL)
def channel_stream(spark, sf):
    """The same posts as a stream, which ends when it has read what there is."""
    path, channels, newest = _archive(spark, sf)
    out = _folder(spark, "posts")
    stream = spark.readStream.format("channel_posts").option("channels", channels).option("folder", path).option("until", newest).load()
    save = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    flows.write_batches(stream, _folder(spark, "check"), save).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("source_id", "id", F.md5("body").alias("digest"))


# -- sends


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS message, 'n' || s_nationkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'editMessageText' ELSE 'sendMessage' END AS method, true AS ok, CAST(length('{"chat_id":"@n' || s_nationkey || '","text":"' || s_name || '"}') AS VARCHAR) AS "tgId", CAST(1 AS BIGINT) AS tries FROM supplier""")
def sent_posts(spark, sf):
    """A post for each supplier, the same batch again, and new texts for half of them:
    what was sent is not sent again, a new text edits its post."""
    s = views.load(spark, sf, "supplier")
    told = lambda text: F.to_json(F.struct(F.concat(F.lit("@n"), F.col("s_nationkey").cast("string")).alias("chat_id"), text.alias("text")))
    rows = lambda text: s.select(F.col("s_suppkey").cast("string").alias("message"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("sendMessage").alias("method"), told(text).alias("body"))
    ledger = _folder(spark, "ledger")
    spark.dataSource.register(sends.ChannelSends)
    new = rows(F.concat(F.col("s_name"), F.lit(" again"))).where(F.col("message").cast("long") % 2 == 0)
    for batch in (rows(F.col("s_name")), rows(F.col("s_name")), new):
        writer = batch.repartition("target").write.format("channel_sends").option("sender", "newsloom.sinks.sends:dry_run").option("ledger", ledger).option("pause_ms", "0")
        writer.mode("append").save()
    return spark.read.schema(sends.LEDGER).json(ledger).select("message", "target", "method", "ok", "tgId", "tries")
