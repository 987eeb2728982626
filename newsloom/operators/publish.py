"""Stage four: stories x targets -> assembled sends, posts and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PHOTO_LIMIT, RENDERED_MEMBERS, TEXT_LIMIT
from ..functions.text import chat_id, col, escape_html, first_fit, hashtag_line, header, member_line, render_template, target_ids, trim, utf16_length
from .items import live


def publishable() -> Column:
    return live() & (F.col("status") == "topublish")


def receivers(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """(message, target): targets all of whose tags the message has, whatever the
    case; a target without tags receives nothing.

    A containment join by the rarest tag: each target waits under the one of its tags
    that the fewest messages have, so only messages with that tag meet it, and those
    are tested whole.  A tag that all messages share pairs nothing but targets that want
    it alone, all of whose pairs are results."""
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    wanted = targets.where(live()).select(F.col("id").alias("target"), lower("tags").alias("wanted")).where(F.size("wanted") > 0)
    each = wanted.select("target", F.explode("wanted").alias("tag"))
    tagged = messages.select(F.col("id").alias("message"), lower("tags").alias("tags"))
    often = tagged.select(F.explode("tags").alias("tag")).join(each.select("tag").distinct(), "tag", "left_semi").groupBy("tag").agg(F.count("*").alias("often"))
    # a target with a tag that no message has receives nothing
    rarest = each.join(often, "tag", "left").groupBy("target").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "tag")).alias("r")).where("r.often > 0")
    waiting = wanted.join(rarest.select("target", F.col("r.tag").alias("tag")), "target")
    asked = waiting.select("tag").distinct()
    met = tagged.select("message", "tags", F.explode("tags").alias("tag")).join(asked, "tag", "left_semi").join(waiting, "tag")
    return met.where(F.size(F.array_except("wanted", "tags")) == 0).select("message", "target")


def unmatched(messages: DataFrame, targets: DataFrame) -> DataFrame:
    return messages.join(receivers(messages, targets).select(F.col("message").alias("id")).distinct(), "id", "left_anti")


def first_legacy() -> Column:
    return F.get(target_ids("tgChannel"), 0)


def post_for(target, first: Column | None = None) -> Column:
    """The recorded post of a target, else the legacy pair for the first legacy
    target (where a caller has it, it is not sought again), else null; for a message row."""
    first = first_legacy() if first is None else first
    legacy = F.when((col(target) == first) & (F.coalesce("tgId", F.lit("")) != ""), F.struct(F.col("tgId"), F.coalesce("tgAt", F.lit(0).cast("long")).alias("tgAt")))
    return F.coalesce(F.try_element_at("posts", col(target)), legacy)


def is_current(post: Column) -> Column:
    return F.coalesce(post["tgAt"] >= F.col("ts"), F.lit(False))


def rendered_members(members="members", most: int = RENDERED_MEMBERS) -> Column:
    """Lines of the oldest members, by time and id."""
    entry = F.transform(F.map_entries(col(members)), lambda e: F.struct(e["value"]["ts"].alias("ts"), e["key"].alias("id"), e["value"].alias("block")))
    first = F.slice(F.array_sort(F.transform(entry, lambda e: F.struct(e["ts"].alias("ts"), e["id"].alias("id"), e["block"]["summary"].alias("summary"), e["block"]["links"].alias("links"), e["block"]["channel"].alias("channel")))), 1, most)
    lines = F.transform(first, lambda e: member_line(e["id"], e["summary"], e["links"], e["channel"]))
    return F.coalesce(lines, F.array().cast("array<string>"))


def _parts(rows: DataFrame) -> DataFrame:
    """Adds what every text of a message is made of, whatever the template."""
    line = hashtag_line("location", "peoples", "tags", "title", "date", "ts")
    return rows.withColumns({"_blocks": rendered_members(), "_tags": line, "_head": header("date", "country", "location")})


def _composed(rows: DataFrame) -> DataFrame:
    """Adds text to rows with their parts and a messageTemplate.

    Candidates fall in size: all members with hashtags, without, then fewer members
    down to one; the first that fits is the text, else the last."""
    built_in = trim(F.coalesce("messageTemplate", F.lit(""))) == ""

    def compose(n: Column, tags: Column) -> Column:
        blocks = F.slice(F.col("_blocks"), F.lit(1), F.greatest(n, F.lit(0)))
        body = F.array_join(blocks, "\n")
        plain = F.concat(F.array_join(F.concat(F.array("_head", F.lit("")), blocks), "\n"), F.when(tags == "", "").otherwise(F.concat(F.lit("\n\n"), tags)))
        values = {
            "header": F.col("_head"), "body": body, "hashtags": tags, "title": escape_html(F.coalesce("title", F.lit(""))),
            "country": escape_html(F.upper(F.coalesce("country", F.lit("")))), "location": escape_html(F.coalesce("location", F.lit(""))), "date": F.col("date"),
        }
        return F.when(built_in, plain).otherwise(render_template("messageTemplate", values))

    n = F.size("_blocks")
    rows = rows.withColumn("_full", compose(n, F.col("_tags")))  # most fit as they are; only others try more
    fewer = F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: compose(k, F.lit("")))).otherwise(F.array().cast("array<string>"))
    text = F.when(utf16_length("_full") <= TEXT_LIMIT, F.col("_full")).otherwise(first_fit(F.concat(F.array(compose(n, F.lit(""))), fewer)))
    return rows.withColumn("text", text).drop("_blocks", "_tags", "_head", "_full")


def _addressed(rows: DataFrame) -> DataFrame:
    """Adds method, photo, chatId, noPreview to rows with their text, target and post."""
    has = lambda c: trim(F.coalesce(col(c), F.lit(""))) != ""
    photo = has("image") & (utf16_length("text") <= PHOTO_LIMIT)
    method = F.when(has("post.tgId"), "editMessageText").when(photo, "sendPhoto").otherwise("sendMessage")
    rows = rows.withColumn("method", method).withColumn("photo", F.when(F.col("method") == "sendPhoto", F.col("image")))
    return rows.withColumn("chatId", chat_id("target")).withColumn("noPreview", has("title") | has("image"))


def assemble(rows: DataFrame) -> DataFrame:
    """Adds text, method, photo, chatId, noPreview to message rows that carry
    target, messageTemplate and post."""
    return _addressed(_composed(_parts(rows)))


def sends(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """Everything to send now: publishable messages for their receivers, unless
    the post there is current.

    A message's parts are made once and its text once for each template, however many
    targets receive it; rows of a target follow from these."""
    rows = messages.where(publishable())
    to = receivers(rows, targets).join(targets.select(F.col("id").alias("target"), "messageTemplate"), "target")
    alike = to.groupBy("message", "messageTemplate").agg(F.collect_list("target").alias("targets"))
    to = alike.groupBy("message").agg(F.collect_list(F.struct("messageTemplate", "targets")).alias("_texts"))
    rows = _parts(rows.join(to, rows["id"] == to["message"]).withColumn("_first", first_legacy())).select("*", F.inline("_texts"))
    posts = F.transform("targets", lambda t: F.struct(t.alias("target"), post_for(t, F.col("_first")).alias("post")))
    rows = _composed(rows.withColumn("_due", F.filter(posts, lambda p: ~is_current(p["post"]))).where(F.size("_due") > 0))
    rows = rows.select("*", F.inline("_due")).select(*messages.columns, "message", "target", "messageTemplate", "post", "text")
    return _addressed(rows)


def request(rows: DataFrame, parse_mode: str = "HTML") -> DataFrame:
    """The sends with the JSON body of each, by method."""
    mode, quiet = F.lit(parse_mode).alias("parse_mode"), F.col("noPreview").alias("disable_web_page_preview")
    chat = F.col("chatId").alias("chat_id")
    edit = lambda number: F.to_json(F.struct(chat, number.alias("message_id"), "text", mode, quiet))
    body = F.when(F.col("method") == "sendPhoto", F.to_json(F.struct(chat, "photo", F.col("text").alias("caption"), mode)))
    body = body.when(F.col("method") == "sendMessage", F.to_json(F.struct(chat, "text", mode, quiet)))
    body = body.when(message_number("post.tgId").isNotNull(), edit(message_number("post.tgId"))).otherwise(edit(F.col("post.tgId")))
    return rows.withColumn("body", body)


def message_number(c) -> Column:
    """The id as a number where it is one, else null (the request then keeps the text)."""
    return col(c).try_cast("long")


def envelope(body) -> Column:
    """A response's ok, description, message_id and retry_after; null when ok is
    no boolean."""
    got = F.from_json(col(body), "ok boolean, description string, result struct<message_id: bigint>, parameters struct<retry_after: double>")
    return F.when(got["ok"].isNotNull(), F.struct(got["ok"].alias("ok"), got["description"].alias("description"), got["result"]["message_id"].alias("messageId"), got["parameters"]["retry_after"].alias("retryAfter")))


def retry_delay(retry_after, status) -> Column:
    return F.coalesce(col(retry_after) * 1000, F.when(col(status) == 429, 60_000.0))


def pause(delay) -> Column:
    return F.greatest(F.coalesce(col(delay), F.lit(0.0)), F.lit(3000.0))


def explanation(status, description, chat) -> Column:
    bad_token = F.concat(col(description), F.lit(" (check the token of the bot)"))
    no_chat = F.concat(col(description), F.lit(" (is "), col(chat), F.lit(" public, and does the bot belong to it?)"))
    return F.when(col(status).isin(401, 404), bad_token).when(col(description) == "Bad Request: chat not found", no_chat).otherwise(col(description))


def published_state(messages: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Messages after a round of sends.  results: message, target, method, ok, tgId,
    error, at; of several for one target the last counts.  Posts are recorded, an
    edited one keeps its id; a message with a rejected send stays to be retried."""
    last = results.groupBy("message", "target").agg(F.max(F.struct("at", "ok", "tgId", "method", "error")).alias("r")).select("message", "target", "r.*")
    done = last.groupBy("message").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("ok"), F.struct("target", F.struct("tgId", F.lit(now_ms).alias("tgAt")))))).alias("new"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat("target", F.lit(" ("), "method", F.lit("): "), "error")))), "; ").alias("rejected"),
    )
    rows = messages.join(done, messages["id"] == done["message"], "left")
    posts = F.when(F.col("new").isNull(), F.col("posts")).otherwise(F.map_concat(F.map_filter("posts", lambda k, _: ~F.coalesce(F.map_contains_key("new", k), F.lit(False))), "new"))
    rows = rows.withColumn("posts", posts).withColumn("_failed", F.coalesce(F.col("rejected") != "", F.lit(False)))
    posted = F.exists(F.map_values("posts"), lambda p: p["tgId"] != "")
    turn = publishable() & ~F.col("_failed")
    rows = rows.withColumn("ts", F.when(turn, now_ms).otherwise(F.col("ts"))).withColumn("status", F.when(turn, F.when(posted, "published").otherwise("no_target")).otherwise(F.col("status")))
    return rows.drop("message", "new", "_failed")


def post_rows(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """(message, target, tgId, url) of each message's matched, recorded and legacy
    targets; unposted ones only where matched."""
    matched = receivers(messages, targets).withColumn("matched", F.lit(True))
    known = messages.select(F.col("id").alias("message"), F.explode(F.array_distinct(F.concat(F.map_keys("posts"), target_ids("tgChannel")))).alias("target"))
    every = known.join(matched, ["message", "target"], "full")
    rows = every.join(messages.select(F.col("id").alias("message"), "posts", "tgChannel", "tgId", "tgAt"), "message")
    rows = rows.select("message", "target", F.coalesce("matched", F.lit(False)).alias("matched"), F.nullif(post_for("target")["tgId"], F.lit("")).alias("tgId"))
    url = F.when(F.col("tgId").isNotNull(), F.concat(F.lit("https://t.me/"), "target", F.lit("/"), "tgId"))
    return rows.where("tgId is not null or matched").select("message", "target", "tgId", url.alias("url"))
