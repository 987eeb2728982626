"""Stage three: reports of one event become one story.

Blocking is an inverted-index join: pairs of one day that share no term score 0
and are distinct under any band whose lower threshold is at least 0, so only
pairs that share a term are scored; pairs above a threshold are found by prefixes
of rare terms.  The sequential merge keeps one day's stories (identities and keys,
no texts) as state and streams the day's items past it; member blocks are joined
afterwards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISTINCT_THRESHOLD, KEY_CAP, MAX_MEMBERS, MERGE_THRESHOLD, WEIGHTS
from ..functions.match import PARTS, match_key, match_score, message_tags
from ..functions.text import col
from . import pairs
from .graph import components

TITLE = 0.4  # likeness of titles from which prefixes of titles find a pair; below, entities must


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("key", match_key("title", "peoples", "properNames", "tags"))


def _terms(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, date, part, term, size of the part's set), one row for each term."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"key.{p}").alias("terms")) for p in PARTS])
    one = rows.select(*ids, "date", F.explode(parts).alias("p"))
    return one.select(*ids, "date", "p.part", F.size("p.terms").alias("size"), F.explode("p.terms").alias("term"))


def pair_scores(left: DataFrame, right: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """date, item, story, score of the pairs of one day that share a term; left and
    right have id, date and key.  No pair is shuffled (see pairs)."""
    return pairs.across(left, right, weights)


def candidate_pairs(left: DataFrame, right: DataFrame, least: float = DISTINCT_THRESHOLD, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """date, item, story, score of the pairs of one day that score above `least`.

    Exact prefix blocking: such a pair has titles alike to TITLE or entities alike
    to what the score then still lacks, and two sets that are alike to t share one
    of the |x| - ceil(t |x|) + 1 rarest terms of each.  So a tag, or a word that all
    of a day's reports have, pairs nothing by itself."""
    need = _needs(least, weights)
    if need["entities"] <= 0:  # tags and half a title would do: every shared term counts
        return pair_scores(left, right, weights).where(F.col("score") > least)
    terms = _terms(left.unionByName(right).select("id", "date", "key").distinct(), "id").where(F.col("part").isin(*need))
    often = terms.groupBy("date", "part", "term").agg(F.count("*").alias("often"))
    share = F.when(F.col("part") == "titleTokens", need["titleTokens"]).otherwise(need["entities"])
    place = F.row_number().over(Window.partitionBy("id", "date", "part").orderBy("often", "term"))
    kept = terms.join(often, ["date", "part", "term"]).withColumn("place", place)
    kept = kept.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).select("id", "date", "part", "term")
    side = lambda rows, name: kept.join(rows.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", name)
    met = side(left, "item").join(side(right, "story"), ["date", "part", "term"]).select("date", "item", "story").distinct()
    a, b = left.select(F.col("id").alias("item"), F.col("key").alias("ka")), right.select(F.col("id").alias("story"), F.col("key").alias("kb"))
    scored = met.join(a, "item").join(b, "story").select("date", "item", "story", match_score("ka", "kb", weights).alias("score"))
    return scored.where(F.col("score") > least)


def best_candidate(scores: DataFrame) -> DataFrame:
    """The best story of each item; ties go to the first by id."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "story")
    return scores.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def all_pairs(left: DataFrame, right: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The plain blocking join, for bands whose thresholds reach 0."""
    l, r = left.select(F.col("id").alias("item"), "date", F.col("key").alias("ka")), right.select(F.col("id").alias("story"), "date", F.col("key").alias("kb"))
    return l.join(r, "date").select("date", "item", "story", match_score("ka", "kb", weights).alias("score"))


def replay_match(items: DataFrame, stories: DataFrame) -> DataFrame:
    """(item, story): the first stored story of the day that already has the item."""
    members = stories.select(F.col("id").alias("story"), "date", F.explode("memberIds").alias("item"))
    return items.select(F.col("id").alias("item"), "date").where("date <> ''").join(members, ["date", "item"]).groupBy("item").agg(F.min("story").alias("story"))


def fresh_candidates(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored stories that the batch does not hold in a newer form."""
    return stored.join(batch.select("id"), "id", "left_anti")


def publish_changed(new: str, old: str) -> Column:
    """Whether rendered content differs; maps compare by sorted entries."""
    n, o = col(new), col(old)
    members = ~F.array_sort(F.map_entries(n["members"])).eqNullSafe(F.array_sort(F.map_entries(o["members"])))
    rest = [~n[f].eqNullSafe(o[f]) for f in ("title", "country", "location", "peoples", "tags", "image")]
    out = o.isNull() | members
    for r in rest:
        out = out | r
    return out


@dataclass
class Story:
    """What the merge needs to know of a story."""

    id: str
    order: int
    sets: dict[str, set]
    tags: list
    image: str | None
    members: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)
    stored: bool = False
    touched: bool = False


class Day:
    """One day's stories, with an index from term to stories.

    Serial: every item sees what the ones before it did, and a pair inside the band
    is settled at once.  Deferred: only stored members count as replays, and pairs
    inside the band are settled after all other items (finish)."""

    def __init__(self, band: tuple[float, float], weights: dict[str, float], now_ms: int, deferred: bool = False):
        self.stories: dict[str, Story] = {}
        self.index: dict[tuple[str, str], set[str]] = defaultdict(set)
        self.member_of: dict[str, str] = {}
        self.distinct, self.merge = band
        self.weights, self.now, self.deferred = weights, now_ms, deferred
        self.counts = {"created": 0, "merged": 0, "capped": 0, "adjudicated": 0}
        self.waiting: list[tuple[dict, str]] = []
        self.pairs: list[tuple] = []
        self.changed: set[tuple[str, str]] = set()  # terms whose stories are others than before
        self.steps = 0

    # A subclass may bring these in as they are asked for.
    def ids_of(self, part: str, term: str) -> set[str]:
        return self.index[part, term]

    def story(self, id: str) -> Story | None:
        return self.stories.get(id)

    def home(self, item: str) -> str | None:
        return self.member_of.get(item)

    def enter(self, story: Story) -> None:
        """A stored story; the first that has an item keeps it."""
        self.stories[story.id] = story
        for member in story.members:
            self.member_of.setdefault(member, story.id)
        for part, terms in story.sets.items():
            for term in terms:
                self.index[part, term].add(story.id)

    def best(self, sets: dict[str, set]) -> tuple[str, float] | None:
        """The best story; on a tie touched ones come first, in the order of their
        first touch, then stored ones.

        Terms are looked up by how few stories they bring for what they weigh, until
        those left cannot lift a story that was not met above the lower threshold or
        the best one.  So a term that a whole day shares is seldom looked up; the best
        is exact where it scores above the lower threshold, else it may be another
        such story or none."""
        gain = {p: self.weights[p] / len(sets[p]) for p in PARTS if sets[p]}
        terms = sorted(((len(ids) / (gain[p] or 1e-9), p, term, ids) for p in gain for term in sets[p] if (ids := self.ids_of(p, term))), key=lambda t: t[:3])
        left = sum(gain[p] for _, p, _, _ in terms)  # an upper bound of what a story not met scores
        found, met = None, set()
        for _, part, _, ids in terms:
            if left < max(self.distinct, found[2] if found else 0.0) - 1e-9:
                break
            left -= gain[part]
            for name in ids - met:
                story, score = self.story(name), 0.0
                for p in PARTS:
                    both = len(sets[p] & story.sets[p])
                    union = len(sets[p]) + len(story.sets[p]) - both
                    score += self.weights[p] * (both / union if union else 0.0)
                if found is None or score >= found[2]:
                    rank = (-score, not story.touched, story.order, name)
                    if found is None or rank < found[0]:
                        found = (rank, name, score)
            met |= ids
        return found and (found[1], found[2])

    def take(self, item: dict) -> str:
        into = self.home(item["id"])
        if into is not None:
            return self.absorb(item, into, "replayed")
        best = self.best({p: set(item["key"][p]) for p in PARTS})
        if best is None or best[1] <= self.distinct:
            return self.absorb(item, None, "created")
        if best[1] >= self.merge:
            return self.absorb(item, best[0], "merged")
        self.counts["adjudicated"] += 1
        if self.deferred:
            self.waiting.append((item, best[0]))
            return "waiting"
        return self.settle(item, best[0])

    def settle(self, item: dict, story: str) -> str:
        """A pair inside the band: described, then merged where its verdict says so."""
        self.pairs.append(self.describe(item, self.story(story)))
        same = story in item["same"]
        return self.absorb(item, story if same else None, "adjudicated" if same else "created")

    def finish(self) -> None:
        for item, story in self.waiting:
            self.pairs.append(self.describe(item, self.story(story)))
        for item, story in self.waiting:
            same = story in item["same"]
            self.absorb(item, story if same else None, "adjudicated" if same else "created")
        self.waiting = []

    def describe(self, item: dict, story: Story) -> tuple:
        """What an adjudicator is told: no bodies; a title that is missing is its
        sorted tokens."""
        said = lambda title, sets: title if title is not None else " ".join(sorted(sets["titleTokens"]))
        mine = {p: set(item["key"][p]) for p in PARTS}
        return (
            f"{item['id']}->{story.id}", item["id"], story.id,
            said(item["title"], mine), sorted(mine["entities"]), item["message_tags"], item["location"],
            said(story.last.get("title"), story.sets), sorted(story.sets["entities"]), story.tags, story.last.get("location"),
        )

    def absorb(self, item: dict, into: str | None, outcome: str) -> str:
        sets = {p: set(item["key"][p]) for p in PARTS}
        story = self.story(into) if into else None
        if story is None:
            # a repeated id starts its story anew, as a write of the same key does
            self.forget(item["id"])
            story = self.stories[item["id"]] = Story(item["id"], 0, {p: set() for p in PARTS}, [], None)
            self.counts["created"] += 1
        elif len(story.members) >= MAX_MEMBERS and item["id"] not in story.members:
            self.counts["capped"] += 1
            return "capped"
        else:
            self.counts["merged"] += 1
        for part in PARTS:
            grown = set(sorted(story.sets[part] | sets[part])[:KEY_CAP])
            for term in story.sets[part] - grown:
                self.ids_of(part, term).discard(story.id)
            for term in grown - story.sets[part]:
                self.ids_of(part, term).add(story.id)
            self.changed |= {(part, term) for term in story.sets[part] ^ grown}
            story.sets[part] = grown
        story.members[item["id"]] = story.members.get(item["id"], self.now)
        story.tags = list(dict.fromkeys([*item["message_tags"], *story.tags]))
        story.image = story.image if story.image is not None else item["image"]
        story.last = item
        if not story.touched:
            self.steps += 1
            story.touched, story.order = True, self.steps
        if not self.deferred:
            self.member_of[item["id"]] = story.id
        return outcome

    def forget(self, id: str) -> None:
        old = self.story(id)
        if old is None:
            return
        del self.stories[id]
        for part, terms in old.sets.items():
            for term in terms:
                self.ids_of(part, term).discard(id)
                self.changed.add((part, term))


_ROW = "kind string, date string, id string, stored boolean, memberIds array<string>, memberCount long, title string, country string, location string, peoples string, tags array<string>, image string, keyEntities array<string>, keyTitle array<string>, keyTags array<string>, ts long, n_created long, n_merged long, n_capped long, n_adjudicated long, item string, itemTitle string, itemEntities array<string>, itemTags array<string>, itemLocation string"
_STATE = ("id", "date", "keyEntities", "keyTitle", "keyTags", "memberIds", "tags", "image", "title", "country", "location", "peoples")


def day_rows(date: str, day: Day, now_ms: int, finish: bool = True, more: list[dict] | None = None, names: list[str] | None = None) -> pd.DataFrame:
    """The touched stories and described pairs of a day as rows of fold()."""
    if finish:
        day.finish()
    out = list(more or [])
    for s in day.stories.values():
        if s.touched:
            out.append({"kind": "story", "id": s.id, "stored": s.stored, "memberIds": list(s.members), "memberCount": len(s.members), "tags": s.tags, "image": s.image, "ts": now_ms, **{f: s.last.get(f) for f in ("title", "country", "location", "peoples")}, **{k: sorted(s.sets[p]) for k, p in zip(("keyEntities", "keyTitle", "keyTags"), PARTS)}})
    for pair, item, story, title, entities, tags, location, *other in day.pairs:
        out.append({"kind": "pair", "id": pair, "item": item, "itemTitle": title, "itemEntities": entities, "itemTags": tags, "itemLocation": location, "title": other[0], "keyEntities": other[1], "tags": other[2], "location": other[3]})
    out = out or [{"kind": "count"}]
    for k, row in enumerate(out):
        row |= {"date": date, **{f"n_{c}": n if k == 0 else 0 for c, n in day.counts.items()}}
    names = names or [f.split()[0] for f in _ROW.split(", ")]
    frame = pd.DataFrame([[row.get(c) for c in names] for row in out], columns=names, dtype=object)
    return frame.astype({"memberCount": "Int64", "ts": "Int64", "stored": "boolean"})


def _needs(least: float, weights: dict[str, float]) -> dict[str, float]:
    """How alike titles or else entities are, at least, where a score is above `least`."""
    return {"titleTokens": TITLE, "entities": (least - weights["titleTokens"] * TITLE - weights["tags"]) / weights["entities"]}


def day_parts(items: DataFrame, stored: DataFrame, least: float, weights: dict[str, float]) -> DataFrame:
    """(date, id, part): the parts of a day that the merge may fold apart.

    items: id, date, key; stored: the same with memberIds.  An item that joins a story
    shares ceil(t |x|) of its |x| title terms or entities with the union of the story's
    keys (t by _needs), so at least one of its |x| - ceil(t |x|) + 1 rarest with some
    member or stored story.  All holders of such a term are connected, as are a stored
    story and its members, and rows of one id; parts are the connected components.
    A pair across parts scores `least` at most, as tags alone do."""
    need = _needs(least, weights)
    if need["entities"] <= 0:
        raise ValueError("parts need a lower threshold above the weight of tags and what titles add to it")
    node = lambda id: F.xxhash64("date", F.lit("id"), id)
    rows = items.select("id", "date", "key", F.lit(True).alias("asks")).unionByName(stored.select("id", "date", "key", F.lit(False).alias("asks"))).distinct()
    terms = _terms(rows.withColumn("row", F.xxhash64("key")), "id", "row", "asks")  # rows that repeat an id have their own keys each
    terms = terms.where(F.col("part").isin(*need)).withColumn("node", node("id"))
    often = terms.groupBy("date", "part", "term").agg(F.count("*").alias("often"))
    share = F.when(F.col("part") == "titleTokens", need["titleTokens"]).otherwise(need["entities"])
    place = F.row_number().over(Window.partitionBy("node", "row", "part").orderBy("often", "term"))
    rare = terms.where("asks").join(often, ["date", "part", "term"]).withColumn("place", place)
    rare = rare.where((F.col("often") > 1) & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1))
    rare = rare.select("date", "part", "term").distinct()
    held = terms.join(rare, ["date", "part", "term"], "left_semi").select(F.col("node").alias("a"), F.xxhash64("date", "part", "term").alias("b"))
    members = stored.select("date", "id", F.explode("memberIds").alias("member")).select(node("id").alias("a"), node("member").alias("b"))
    found = components(held.unionByName(members))
    every = items.select("date", "id").unionByName(stored.select("date", "id")).distinct().withColumn("node", node("id"))
    return every.join(found, "node", "left").select("date", "id", F.coalesce("component", "node").alias("part"))


def fold(
    items: DataFrame,
    now_ms: int,
    stored: DataFrame | None = None,
    verdicts: DataFrame | dict[str, bool] | None = None,
    band: tuple[float, float] = (DISTINCT_THRESHOLD, MERGE_THRESHOLD),
    weights: dict[str, float] = WEIGHTS,
    deferred: bool = False,
    parts: bool = False,
) -> DataFrame:
    """The sequential merge: each item of a day, by (seq, id), joins the best story or
    starts one.  Rows of kind story are the stories touched, of kind pair the pairs
    inside the band as an adjudicator is told them (id item->story), of kind count a
    day without either; counts stand in a day's first row.

    stored: stories of earlier batches (id, date, key and descriptive fields,
    memberIds).  verdicts: table (or dict) of pair id and whether it is one story; a
    pair without one splits.  Days are independent and run in parallel; a day's rows
    stream past its state, so the rows themselves are never held together.  The limit
    is one day's stories: their keys must fit a task.  With `parts` a day is folded in
    parts that cannot meet (day_parts), each of which must fit; the result is the same,
    but for counts, which then stand in the first row of each part."""
    spark = items.sparkSession
    if not isinstance(verdicts, DataFrame):
        verdicts = spark.createDataFrame(list((verdicts or {}).items()), "id string, same boolean")
    said = verdicts.where("same").select(F.split("id", "->", 2).alias("p")).groupBy(F.col("p")[0].alias("id")).agg(F.collect_set(F.col("p")[1]).alias("same"))
    none = F.array().cast("array<string>")
    rows = with_key(items).withColumn("message_tags", message_tags("category", "tags")).join(said, "id", "left")
    rows = rows.select("date", F.lit(1).alias("side"), F.col("seq").cast("long").alias("seq"), "id", "key.*", "message_tags", "image", "title", "country", "location", "peoples", F.coalesce("same", none).alias("same"), none.alias("members"))
    if stored is not None:
        old = stored.where(F.col("date") != "").select(*_STATE)
        old = old.select("date", F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq"), "id", *[F.coalesce(k, none).alias(p) for k, p in zip(("keyEntities", "keyTitle", "keyTags"), PARTS)], F.coalesce("tags", none).alias("message_tags"), "image", "title", "country", "location", "peoples", none.alias("same"), F.coalesce("memberIds", none).alias("members"))
        rows = old.unionByName(rows)
    day = ["date"]
    if parts:
        rows = rows.withColumn("_day", F.coalesce("date", F.lit("")))
        keyed = rows.select(F.col("_day").alias("date"), "side", "id", F.struct(*PARTS).alias("key"), "members")
        of = day_parts(keyed.where("side = 1").select("id", "date", "key"), keyed.where("side = 0").select("id", "date", "key", F.col("members").alias("memberIds")), band[0], weights)
        rows, day = rows.join(of.toDF("_day", "id", "_part"), ["_day", "id"]), ["date", "_part"]
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, day = None, None
        for batch in batches:
            for row in batch.to_dict("records"):
                if day is None or (row["date"], row.get("_part")) != key:
                    if day is not None:
                        yield day_rows(key[0], day, now_ms)
                    key, day = (row["date"], row.get("_part")), Day(band, weights, now_ms, deferred)
                row = {k: None if v is None or v is pd.NA or v != v else v for k, v in row.items() if k not in (*PARTS, "message_tags", "same", "members")} | {k: list(row[k]) for k in (*PARTS, "message_tags", "same", "members")}
                if row["side"] == 0:
                    day.enter(Story(row["id"], len(day.stories), {p: set(row[p]) for p in PARTS}, row["message_tags"], row["image"], dict.fromkeys(row["members"], now_ms), row, stored=True))
                else:
                    day.take(row | {"key": {p: row[p] for p in PARTS}})
        if day is not None:
            yield day_rows(key[0], day, now_ms)

    return rows.repartition(*day).sortWithinPartitions(*day, "side", "seq", "id").mapInPandas(run, _ROW)


def fold_stories(items: DataFrame, now_ms: int, verdicts: DataFrame | dict[str, bool] | None = None, band: tuple[float, float] = (DISTINCT_THRESHOLD, MERGE_THRESHOLD), weights: dict[str, float] = WEIGHTS, stored: DataFrame | None = None, deferred: bool = False, parts: bool = False) -> DataFrame:
    """The stories that a batch touches (see fold)."""
    return fold(items, now_ms, stored, verdicts, band, weights, deferred, parts).where("kind = 'story'").drop("kind", "item", "itemTitle", "itemEntities", "itemTags", "itemLocation")


def band_pairs(folded: DataFrame) -> DataFrame:
    """The pairs to adjudicate of a fold, both sides described."""
    both = [F.col(c).alias(n) for c, n in (("title", "storyTitle"), ("keyEntities", "storyEntities"), ("tags", "storyTags"), ("location", "storyLocation"))]
    return folded.where("kind = 'pair'").select("id", "date", "item", "itemTitle", "itemEntities", "itemTags", "itemLocation", F.substring_index("id", "->", -1).alias("story"), *both)


def merge_writes(folded: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """The messages that a fold writes: member blocks (of a batch's item the new text,
    of a known member the time it was added), and status topublish where what readers
    see has changed; `republish` tells."""
    now = folded.where("kind = 'story'").drop("kind", "item", "itemTitle", "itemEntities", "itemTags", "itemLocation")
    # a story's row goes with its first member, so that the fold runs once
    of = now.select("id", "date", "ts", F.struct(*now.columns).alias("row"), F.posexplode("memberIds").alias("pos", "member"))
    of = of.withColumn("row", F.when(F.col("pos") == 0, F.col("row")))
    fresh = items.groupBy(F.col("id").alias("member")).agg(F.max_by(F.struct("summary", "links"), "seq").alias("new"))
    known = stored.select("id", F.explode("members").alias("member", "old"))
    both = of.join(fresh, "member", "left").join(known, ["id", "member"], "left")
    channel, at = F.substring_index("member", "/", 1), F.coalesce("old.ts", "ts")
    block = F.when(F.col("new").isNotNull(), F.struct(F.col("new.summary").alias("summary"), F.col("new.links").alias("links"), channel.alias("channel"), at.alias("ts"))).otherwise(F.struct("old.summary", "old.links", "old.channel", "old.ts"))
    blocks = both.select("id", "date", "row", F.struct("pos", "member", block.alias("block")).alias("e")).groupBy("id", "date")
    blocks = blocks.agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list("e")).alias("e"))  # at most MAX_MEMBERS each
    members = F.map_from_entries(F.transform("e", lambda x: F.struct(x["member"], x["block"])))
    rows = blocks.select("row.*", members.alias("members"))
    content = ["members", "title", "country", "location", "peoples", "tags", "image"]
    old = stored.select("id", F.col("status").alias("_status"), F.struct(*content).alias("_old"))
    rows = rows.join(old, "id", "left").withColumn("_new", F.struct(*content))
    rows = rows.withColumn("republish", publish_changed("_new", "_old"))
    return rows.withColumn("status", F.when(F.col("republish"), "topublish").otherwise(F.col("_status"))).drop("_new", "_old", "_status")
