"""Captions: track choice, anchored chunks, transcripts, video states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_SECONDS, VIDEOS_PER_RUN
from ..functions.dates import clock
from ..functions.text import col, squeeze, unavailable_reason, watch_url
from .items import live

JSON3 = "events array<struct<tStartMs: double, segs: array<struct<utf8: string>>>>"
_CHUNKS = "array<struct<start: bigint, text: string>>"


def caption_lines(raw) -> Column:
    """(start, text) of the events of a json3 document; padding is skipped."""
    events = F.coalesce(F.from_json(col(raw), JSON3)["events"], F.array().cast("array<struct<tStartMs: double, segs: array<struct<utf8: string>>>>"))
    said = lambda e: squeeze(F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8: string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    lines = F.transform(events, lambda e: F.struct(F.floor(F.coalesce(e["tStartMs"], F.lit(0.0)) / 1000).cast("long").alias("start"), said(e).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def chunks(lines: Column, seconds: int = CHUNK_SECONDS) -> Column:
    """Lines joined until one starts `seconds` after its chunk's first line.  The fold
    carries the places where chunks begin, no text; each text is joined once."""
    begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("first"))

    def add(done: Column, line: Column) -> Column:
        fresh = done["first"].isNull() | (line["start"] - done["first"] >= seconds)
        at = F.when(fresh, F.concat(done["at"], F.array(done["n"]))).otherwise(done["at"])
        return F.struct(at.alias("at"), (done["n"] + 1).alias("n"), F.when(fresh, line["start"]).otherwise(done["first"]).alias("first"))

    at = F.aggregate(lines, begin, add, lambda done: done["at"])
    size = lambda k, p: F.coalesce(F.get(at, k + 1), F.size(lines)) - p
    text = lambda k, p: F.array_join(F.transform(F.slice(lines, p + 1, size(k, p)), lambda x: x["text"]), " ")
    return F.transform(at, lambda p, k: F.struct(F.get(lines, p)["start"].alias("start"), text(k, p).alias("text"))).cast(_CHUNKS)


def transcript(id, title, channel, duration, lang, parts) -> Column:
    url = watch_url(id)
    meta = F.concat_ws(" · ", F.nullif(col(channel), F.lit("")), F.when(col(duration) > 0, clock(duration)), F.concat(F.lit("captions: "), col(lang)))
    lines = F.transform(col(parts), lambda c: F.concat(F.lit("- ["), clock(c["start"]), F.lit("]("), url, F.lit("&t="), c["start"].cast("string"), F.lit("s) "), c["text"]))
    return F.concat(F.lit("# "), col(title), F.lit("\n\n"), url, F.lit("\n\n> "), meta, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))


def pick_track(manual, auto, preference, language) -> Column:
    """The caption track (lang, kind): original tracks of the preferred, then the
    spoken language; manual before automatic; then any original; then what there is."""
    none = F.array().cast("array<string>")
    manual, auto = F.coalesce(col(manual), none), F.coalesce(col(auto), none)
    stem = F.split(F.coalesce(col(language), F.lit("")), "-")[0]
    names = F.array(F.coalesce(col(preference), F.lit("")), F.coalesce(col(language), F.lit("")), stem)
    wanted = F.flatten(F.transform(F.filter(names, lambda x: x != ""), lambda x: F.array(F.concat(x, F.lit("-orig")), x)))
    original = lambda xs: F.filter(xs, lambda x: F.endswith(x, F.lit("-orig")))
    spoken = F.when(F.size(original(auto)) > 0, F.flatten(F.transform(original(auto), lambda x: F.array(x, F.regexp_replace(x, "-orig$", ""))))).otherwise(auto)
    track = lambda lang, kind: F.when(lang.isNotNull(), F.struct(lang.alias("lang"), kind.alias("kind")))
    named = F.get(F.filter(wanted, lambda x: F.array_contains(manual, x) | F.array_contains(spoken, x)), 0)
    say = lambda x: F.when(F.array_contains(manual, x), "manual").otherwise("auto")
    first = F.coalesce(F.get(original(manual), 0), F.get(original(auto), 0))
    english = F.when(F.array_contains(auto, "en"), F.lit("en"))
    return F.coalesce(track(named, say(named)), track(first, say(first)), track(F.get(manual, 0), F.lit("manual")), track(F.coalesce(english, F.get(auto, 0)), F.lit("auto")))


def new_videos(playlist: DataFrame, videos: DataFrame, now_ms: int) -> DataFrame:
    """Unknown playlist videos, once each, to do."""
    rows = playlist.dropDuplicates(["videoId"]).join(videos.select(F.col("id").alias("videoId")), "videoId", "left_anti")
    return rows.select(F.col("videoId").alias("id"), "title", F.lit("todo").alias("status"), F.lit(now_ms).alias("addedAt"))


def settled_entries(playlist: DataFrame, videos: DataFrame) -> DataFrame:
    """Playlist entries whose video is past todo; both of a repeated one."""
    return playlist.join(videos.where("status <> 'todo'").select(F.col("id").alias("videoId")), "videoId", "left_semi")


def next_videos(videos: DataFrame) -> DataFrame:
    return videos.where(live() & (F.col("status") == "todo")).orderBy("addedAt", "id").limit(VIDEOS_PER_RUN)


def outcome(track, raw, said) -> Column:
    """(status, note) of a caption fetch: unavailable with its reason where the tool
    said so, skipped without a track or without lines, else fetched."""
    lost = unavailable_reason(said)
    reason = lambda status, note: F.struct(F.lit(status).alias("status"), note.alias("note"))
    return (
        F.when(lost.isNotNull(), reason("unavailable", lost))
        .when(col(track).isNull(), reason("skipped", F.lit("no captions")))
        .when(F.size(caption_lines(raw)) == 0, reason("skipped", F.lit("empty captions")))
        .otherwise(reason("fetched", F.lit(None).cast("string")))
    )


def absorb_fetches(videos: DataFrame, fetches: DataFrame) -> DataFrame:
    """Videos after a run.  fetches: id, track (lang, kind), raw, said, channel,
    duration; only videos that were to do change."""
    out = fetches.select("id", F.struct("track", "raw", outcome("track", "raw", "said").alias("o"), "channel", "duration").alias("_f"))
    rows = videos.join(out, "id", "left")
    done = F.col("_f").isNotNull() & (F.col("status") == "todo")
    parts = chunks(caption_lines("_f.raw"))
    body = transcript("id", "title", "_f.channel", "_f.duration", F.col("_f.track.lang"), parts)
    fetched = done & (F.col("_f.o.status") == "fetched")
    new = {"status": F.when(done, F.col("_f.o.status")), "note": F.when(done, F.col("_f.o.note")), "lang": F.when(fetched, F.col("_f.track.lang")), "kind": F.when(fetched, F.col("_f.track.kind")), "transcript": F.when(fetched, body)}
    return rows.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in videos.columns])
