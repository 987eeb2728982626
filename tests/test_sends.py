"""Sends against one text for each message and target, and how many texts are composed."""

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import publish
from newsloom.plans import console

from .conftest import DATA

COLUMNS = ("id", "target", "messageTemplate", "post", "text", "method", "photo", "chatId", "noPreview")


def test_sends_compose_a_text_once_for_a_template(spark, monkeypatch):
    sf = f"{DATA}/sf0.001"
    messages, targets = console._posted(spark, sf), console._receivers(spark, sf)
    rows = messages.where(publish.publishable())
    to = publish.receivers(rows, targets).join(targets.select(F.col("id").alias("target"), "messageTemplate"), "target")
    each = rows.join(to, rows["id"] == to["message"]).withColumn("post", publish.post_for("target"))
    each = each.where(~publish.is_current(F.col("post")))
    want = {tuple(r) for r in publish.assemble(each).select(*COLUMNS).collect()}
    composed, texts = publish._composed, []
    monkeypatch.setattr(publish, "_composed", lambda rows: texts.append(rows) or composed(rows))
    got = [tuple(r) for r in publish.sends(messages, targets).select(*COLUMNS).collect()]
    assert set(got) == want and len(got) == len(want)
    assert texts[0].count() == each.select("id", "messageTemplate").distinct().count() < len(want) / 2


def test_current_posts_are_left_alone(spark):
    """A message whose posts are all current is not sent, one with a stale post only there."""
    rows = console._posted(spark, f"{DATA}/sf0.001").where(publish.publishable()).limit(2)
    first = rows.agg(F.min("id")).first()[0]
    post = lambda at: F.struct(F.lit("7").alias("tgId"), at.alias("tgAt"))
    at = F.when(F.col("id") == first, F.col("ts")).otherwise(F.col("ts") - 1)
    rows = rows.withColumn("posts", F.create_map(F.lit("a"), post(at), F.lit("b"), post(F.col("ts")))).withColumn("tags", F.array(F.lit("x")))
    targets = spark.createDataFrame([("a", ["X"], None, False), ("b", ["x"], "{title}", False)], "id string, tags array<string>, messageTemplate string, deleted boolean")
    assert [(r.target, r.method, r.post.tgId) for r in publish.sends(rows.localCheckpoint(), targets).collect()] == [("a", "editMessageText", "7")]


def test_trim_and_hashtag_as_web_text(spark):
    """White space at both ends goes, a next-line sign (none for the web) stays where it is."""
    blank = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
    rows = [(blank + "a b" + blank, "a b"), ("a \x85", "a \x85"), (blank, ""), ("", ""), ("😀 ", "😀"), (None, None)]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(rows)], "k int, a string")
    assert [r.v for r in df.orderBy("k").select(text.trim("a").alias("v")).collect()] == [b for _, b in rows]
    tags = spark.createDataFrame([("a" + blank + "-B.,@!'\"()😀",)], "a string")
    assert tags.select(text.hashtag("a").alias("v")).first().v == "#a" + "_" * (len(blank) + 1) + "b😀"
    assert all(tags.select(F.lit(c).rlike(f"^{text.SPACE}$")).first()[0] for c in text.BLANK) and set(text.BLANK) == set(blank)
