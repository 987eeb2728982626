"""The story merge as a stateful stream.

One key is one day.  Its state is kept by what the merge looks up: terms (the ids of
the stories that hold a term), stories (sets, members and descriptive fields) and
homes (the stories that hold an item).  A micro-batch reads and writes only the terms
of its items and the stories these name, so its cost follows the batch, not the day.

Rows are those of stories.fold: stories touched and pairs inside the band as an
adjudicator is told them, and one row of kind item for each item (its story and
outcome).  With `deferred` pairs wait in the state for verdicts, which are a second
input of the same key; an event-time timer splits what got none within `wait_ms`.
Without an event time nothing is timed and a day's state stays until a row of kind
close ends it: a timer in processing time would run empty batches for ever."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DAY_MS, DISTINCT_THRESHOLD, MERGE_THRESHOLD, SETTLE_MS, WEIGHTS
from ..functions.match import PARTS, match_key, message_tags
from ..operators.stories import _ROW, Day, Story, day_rows

ROW = _ROW + ", story string, outcome string"
_NAMES = [f.split()[0] for f in ROW.split(", ")]
_FIELDS = ("title", "country", "location", "peoples")
_LISTS = (*PARTS, "message_tags", "same")


class KeptDay(Day):
    """A day whose terms, stories and homes come from the state when asked for.
    Stories of earlier batches are stored ones, in the order of their ids."""

    def __init__(self, kept: "_Merge", *args, **named):
        super().__init__(*args, **named)
        self.kept, self.absent = kept, set()
        self.had: dict[str, set[str]] = {}  # the members of stories as they came from the state

    def ids_of(self, part: str, term: str) -> set[str]:
        if (part, term) not in self.index:
            found = self.kept.terms.getValue((part, term))
            self.index[part, term] = set(found[0]) if found else set()
        return self.index[part, term]

    def story(self, id: str) -> Story | None:
        if id not in self.stories and id not in self.absent:
            found = self.kept.stories.getValue((id,))
            if found is None:
                self.absent.add(id)
            else:
                e, t, g, tags, image, members, *last = found
                self.had[id] = set(members)
                self.stories[id] = Story(id, 0, dict(zip(PARTS, (set(e), set(t), set(g)))), list(tags), image, dict.fromkeys(members, self.now), dict(zip(_FIELDS, last)), stored=True)
        return self.stories.get(id)

    def home(self, item: str) -> str | None:
        if item not in self.member_of:
            found = self.kept.homes.getValue((item,))
            of = [name for name in sorted(found[0]) if (s := self.story(name)) is not None and item in s.members] if found else []
            if not of:
                return None
            self.member_of[item] = of[0]
        return self.member_of[item]

    def forget(self, id: str) -> None:
        super().forget(id)
        self.absent.add(id)  # what the state still holds is void
        self.had.pop(id, None)

    def save(self) -> None:
        for s in self.stories.values():
            if s.touched:
                self.kept.stories.updateValue((s.id,), (*[sorted(s.sets[p]) for p in PARTS], list(s.tags), s.image, list(s.members), *[s.last.get(f) for f in _FIELDS]))
                for item in s.members.keys() - self.had.get(s.id, set()):
                    found = self.kept.homes.getValue((item,))
                    of = set(found[0]) if found else set()
                    if s.id not in of:
                        self.kept.homes.updateValue((item,), (sorted(of | {s.id}),))
        for part, term in self.changed:
            if ids := self.index[part, term]:
                self.kept.terms.updateValue((part, term), (sorted(ids),))
            else:
                self.kept.terms.removeKey((part, term))


class _Merge(StatefulProcessor):
    def __init__(self, now_ms: int, band: tuple[float, float], weights: dict[str, float], deferred: bool, timed: bool, wait_ms: int, keep_ms: int):
        self.now_ms, self.band, self.weights, self.deferred = now_ms, band, weights, deferred
        self.timed, self.wait_ms, self.keep_ms = timed, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        story = "entities array<string>, titleTokens array<string>, tags array<string>, labels array<string>, image string, members array<string>, title string, country string, location string, peoples string"
        self.stories = handle.getMapState("stories", "id string", story)
        self.terms = handle.getMapState("terms", "part string, term string", "ids array<string>")
        self.homes = handle.getMapState("homes", "item string", "ids array<string>")
        self.waiting = handle.getListState("waiting", "item string, story string, until long")
        self.early = handle.getMapState("early", "pair string", "same boolean")
        self.last = handle.getValueState("last", "until long")

    def _day(self) -> KeptDay:
        return KeptDay(self, self.band, self.weights, self.now_ms, self.deferred)

    def _rows(self, date: str, day: KeptDay, done: list[tuple[dict, str | None, str]]) -> pd.DataFrame:
        more = [{"kind": "item", "id": item["id"], "item": item["id"], "story": story, "outcome": outcome} for item, story, outcome in done]
        frame = day_rows(date, day, self.now_ms, False, more, _NAMES)
        day.save()
        return frame

    def _keep(self, held: list[tuple[dict, str, int]]) -> None:
        if held:
            self.waiting.put([(json.dumps(item), story, until) for item, story, until in held])
        else:
            self.waiting.clear()

    def _clear(self) -> None:
        for state in (self.stories, self.terms, self.homes, self.waiting, self.early, self.last):
            state.clear()

    @staticmethod
    def _settled(day: KeptDay, item: dict, story: str, same: bool) -> tuple[dict, str, str]:
        outcome = day.absorb(item, story if same else None, "adjudicated" if same else "created")
        return item, story if same else item["id"], outcome

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, done = self._day(), []
        batch = pd.concat(rows)  # one day's rows of one micro-batch, which the source's rate limit bounds
        at = int(batch["ms"].max()) if self.timed else 0
        said = {r["id"]: bool(r["verdict"]) for r in batch[batch["kind"] == "verdict"].to_dict("records")}
        held = [(json.loads(item), story, until) for item, story, until in self.waiting.get()] if self.deferred else []
        left = []
        for item, story, until in held:  # in the order in which they came
            pair = f"{item['id']}->{story}"
            if pair in said:
                done.append(self._settled(day, item, story, said[pair]))
            else:
                left.append((item, story, until))
        answered = {f"{item['id']}->{story}" for item, story, _ in held}
        for row in batch[batch["kind"] == "item"].sort_values(["seq", "id"]).to_dict("records"):
            lists = {p: list(row[p]) for p in _LISTS}
            item = {c: None if row[c] is None or row[c] != row[c] else row[c] for c in ("id", "image", *_FIELDS)}
            item |= {"key": {p: lists[p] for p in PARTS}, "message_tags": lists["message_tags"], "same": lists["same"]}
            outcome = day.take(item)
            if outcome != "waiting":
                home = day.home(item["id"]) if not self.deferred else None
                done.append((item, home or next((s.id for s in day.stories.values() if item["id"] in s.members), None), outcome))
        for item, story in day.waiting:
            day.pairs.append(day.describe(item, day.story(story)))
        for item, story in day.waiting:
            pair = f"{item['id']}->{story}"
            if pair not in said and self.deferred and (early := self.early.getValue((pair,))):
                said[pair] = early[0]
                self.early.removeKey((pair,))
            if pair in said:
                answered.add(pair)
                done.append(self._settled(day, item, story, said[pair]))
            else:
                done.append((item, None, "waiting"))
                left.append((item, story, at + self.wait_ms))
        day.waiting = []
        for pair in set(said) - answered:
            self.early.updateValue((pair,), (said[pair],))
        yield self._rows(key[0], day, done)
        if self.deferred:
            self._keep(left)
        if (batch["kind"] == "close").any():
            self._clear()
        elif self.timed:
            for until in {until for *_, until in left} | {at + self.keep_ms}:
                self.handle.registerTimer(until)
            before = self.last.get()
            self.last.update((max(at + self.keep_ms, before[0] if before else 0),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        day, done, left = self._day(), [], []
        for text, story, until in self.waiting.get() if self.deferred else []:
            if until <= now:
                done.append(self._settled(day, json.loads(text), story, False))
            else:
                left.append((json.loads(text), story, until))
        if done:
            yield self._rows(key[0], day, done)
            self._keep(left)
        last = self.last.get()
        if last and last[0] <= now and not left:
            self._clear()

    def close(self) -> None:
        pass


def merge_stories(
    items: DataFrame,
    now_ms: int,
    band: tuple[float, float] = (DISTINCT_THRESHOLD, MERGE_THRESHOLD),
    weights: dict[str, float] = WEIGHTS,
    verdicts: DataFrame | None = None,
    closed: DataFrame | None = None,
    deferred: bool = False,
    lateness: str = "1 hour",
    wait_ms: int = SETTLE_MS,
    keep_ms: int = 30 * DAY_MS,
) -> DataFrame:
    """Rows of ROW for a stream of analyzed items.

    items: id, seq, date and the fields of an analyzed item; with a timestamp column
    `ts` days end keep_ms after their last row.  verdicts: without `deferred` a static
    table of pair id (item->story) and whether it is one story; with it a stream of
    date, ts, id, same.  closed: a stream of the dates whose state ends.  An item that
    arrives again is a replay, whichever batch holds it."""
    timed = "ts" in items.columns
    if deferred and not timed:
        raise ValueError("deferred pairs need an event time (ts) to wait in")
    none = F.array().cast("array<string>")
    items = items.withColumn("same", none)
    if verdicts is not None and not deferred:
        said = verdicts.where("same").select(F.split("id", "->", 2).alias("p")).groupBy(F.col("p")[0].alias("id")).agg(F.collect_set(F.col("p")[1]).alias("said"))
        items = items.join(said, "id", "left").withColumn("same", F.coalesce("said", none))
    key = match_key("title", "peoples", "properNames", "tags")
    ts = F.col("ts") if timed else F.lit(None).cast("timestamp").alias("ts")
    rows = items.select("date", ts, F.lit("item").alias("kind"), F.col("seq").cast("long").alias("seq"), "id", F.lit(None).cast("boolean").alias("verdict"), message_tags("category", "tags").alias("message_tags"), "image", *_FIELDS, "same", key.alias("k"))
    rows = rows.select("*", "k.*").drop("k")
    blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns}
    if deferred and verdicts is not None:
        rows = rows.unionByName(verdicts.select(*[{"date": F.col("date"), "ts": F.col("ts"), "kind": F.lit("verdict"), "id": F.col("id"), "verdict": F.col("same")}.get(c, blank[c]).alias(c) for c in rows.columns]))
    if closed is not None:
        rows = rows.unionByName(closed.select(*[{"date": F.col("date"), "ts": F.col("ts") if timed else blank["ts"], "kind": F.lit("close")}.get(c, blank[c]).alias(c) for c in rows.columns]))
    if timed:
        rows = rows.withWatermark("ts", lateness)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    merge = _Merge(now_ms, band, weights, deferred, timed, wait_ms, keep_ms)
    return rows.groupBy("date").transformWithStateInPandas(merge, ROW, "append", "eventTime" if timed else "none").where("kind <> 'count'")
