"""The story merge against a plain replay of its rules and its outputs."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import stories

ITEM = "id string, seq long, date string, title string, peoples string, properNames string, tags array<string>, category string, image string, country string, location string, summary string, links array<struct<id: bigint, href: string>>"
BAND, WEIGHTS = (0.35, 0.72), {"e": 0.6, "t": 0.25, "g": 0.15}


def batch(n, seed, start=0):
    """Items with few words, so that all verdicts occur, and some repeated ids."""
    rng, rows = random.Random(seed), []
    for k in range(start, start + n):
        title = " ".join(rng.sample(["storm", "city", "vote", "fire", "team"], rng.randrange(1, 4)))
        names = ",".join(rng.sample(["Ann", "Bob", "Cyd"], rng.randrange(1, 3)))
        id = f"s/{k}" if rng.random() < 0.9 or not rows else rng.choice(rows)[0]
        rows.append((id, k, rng.choice(["2024-01-01", "2024-01-02"]), title, "", names, ["news", rng.choice("xy")], "war", None, "UA", None, f"said {k}", None))
    return rows


def replayed(rows, stored, same, deferred):
    """{story id: members in order}, {pair ids}: every rule item by item."""
    key = lambda r: {"e": set(r[5].lower().split(",")), "t": set(r[3].split()), "g": set(r[6])}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    known = {i: (d, k, list(m)) for i, d, k, m in stored}
    pending, pairs, late = {}, [], []

    def absorb(r, into):
        if into is None:
            pending.pop(r[0], None)
            pending[r[0]] = (r[2], key(r), [r[0]])
            return
        date, k, members = pending.get(into) or known[into]
        if len(members) >= 20 and r[0] not in members:
            return
        merged = {p: k[p] | key(r)[p] for p in k}
        pending[into] = (date, merged, members if r[0] in members else [*members, r[0]])

    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        of_day = [i for i, v in known.items() if v[0] == r[2]]
        home = next((i for i in sorted(of_day) if r[0] in known[i][2]), None)
        if not deferred and home is None:
            home = next((i for i, v in reversed(pending.items()) if v[0] == r[2] and r[0] in v[2]), None)
        if home:
            absorb(r, home)
            continue
        best = None
        for i in [*(i for i, v in pending.items() if v[0] == r[2]), *sorted(i for i in of_day if i not in pending)]:
            k = (pending.get(i) or known[i])[1]
            score = 0.6 * like(key(r)["e"], k["e"]) + 0.25 * like(key(r)["t"], k["t"]) + 0.15 * like(key(r)["g"], k["g"])
            if best is None or score > best[0]:
                best = (score, i)
        if best is None or best[0] <= BAND[0]:
            absorb(r, None)
        elif best[0] >= BAND[1]:
            absorb(r, best[1])
        else:
            pairs.append(f"{r[0]}->{best[1]}")
            if deferred:
                late.append((r, best[1]))
            else:
                absorb(r, best[1] if pairs[-1] in same else None)
    for r, i in late:
        absorb(r, i if f"{r[0]}->{i}" in same else None)
    return {i: v[2] for i, v in pending.items()}, pairs


def as_stored(folded, spark):
    """Folded stories as stored messages."""
    return folded.withColumns({"status": F.lit("published")})


@pytest.mark.parametrize("deferred", [False, True])
def test_fold_by_replay(deferred, spark):
    first = batch(60, 1)
    rows = spark.createDataFrame(first, ITEM).repartition(5)
    whole = stories.fold(rows, 5, deferred=deferred).cache()
    want, pairs = replayed(first, [], set(), deferred)
    got = {r.id: r.memberIds for r in whole.where("kind = 'story'").collect()}
    assert got == want
    told = stories.band_pairs(whole).collect()
    assert sorted(r.id for r in told) == sorted(pairs) and len(pairs) > 5
    assert all(r.itemTitle and r.storyTags and r.itemTags[0] == "war" for r in told)
    # a second batch meets the stored stories, with verdicts for its pairs
    stored = whole.where("kind = 'story'")
    held = [(r.id, r.date, {"e": set(r.keyEntities), "t": set(r.keyTitle), "g": set(r.keyTags)}, r.memberIds) for r in stored.collect()]
    second = batch(40, 2, 60) + [(*r[:3], "Nothing alike", *r[4:]) for r in first[:5]]
    _, asked = replayed(second, held, set(), deferred)
    same = {p for k, p in enumerate(asked) if k % 2}
    verdicts = spark.createDataFrame([(p, p in same) for p in asked], "id string, same boolean")
    again = stories.fold_stories(spark.createDataFrame(second, ITEM), 9, verdicts, stored=stored, deferred=deferred)
    assert {r.id: r.memberIds for r in again.collect()} == replayed(second, held, same, deferred)[0]


def test_writes_keep_times_and_tell_changes(spark):
    member = "map<string, struct<summary: string, links: array<struct<id: bigint, href: string>>, channel: string, ts: bigint>>"
    first = spark.createDataFrame(batch(1, 3), ITEM)
    made = stories.fold(first, 5)
    none = spark.createDataFrame([], f"id string, status string, members {member}, title string, country string, location string, peoples string, tags array<string>, image string")
    (one,) = stories.merge_writes(made, first, none).collect()
    assert one.republish and one.status == "topublish" and one.members["s/0"].ts == 5 and one.members["s/0"].channel == "s"
    stored = stories.merge_writes(made, first, none).drop("republish").withColumn("status", F.lit("published"))
    (same,) = stories.merge_writes(stories.fold(first, 9, stored), first, stored).collect()
    assert not same.republish and same.status == "published" and same.members["s/0"].ts == 5
    changed = first.withColumn("summary", F.lit("corrected"))
    (new,) = stories.merge_writes(stories.fold(changed, 9, stored), changed, stored).collect()
    assert new.republish and new.members["s/0"].summary == "corrected" and new.members["s/0"].ts == 5


def test_candidate_pairs_are_exact(spark):
    rows = spark.createDataFrame(batch(150, 4), ITEM).dropDuplicates(["id"])
    keyed = stories.with_key(rows).select("id", "date", "key")
    for least in (0.35, 0.5, 0.2):
        got = {(r.item, r.story): round(r.score, 9) for r in stories.candidate_pairs(keyed, keyed, least).collect()}
        want = {(r.item, r.story): round(r.score, 9) for r in stories.pair_scores(keyed, keyed).where(F.col("score") > least).collect()}
        assert got == want and got
    # a day whose items share one tag, or one word beside others, makes no pairs
    odd = [(f"s/{k}", k, "2024-01-03", f"today {k} a{k} b{k}", "", f"N{k}", ["news"], "war", None, "", "", "", None) for k in range(300)]
    lone = stories.with_key(spark.createDataFrame(odd, ITEM)).select("id", "date", "key")
    assert stories.candidate_pairs(lone, lone).where("item <> story").count() == 0


def busy(n, seed, start=0):
    """Items over some hundred words and names, so that a day has many parts."""
    rng, rows = random.Random(seed), []
    for k in range(start, start + n):
        event = rng.randrange(30)
        words = [f"w{event}_{j}" for j in rng.sample(range(6), rng.randrange(2, 6))] + rng.sample(["today", "city"], rng.randrange(2))
        names = [f"N{event} {j}" for j in rng.sample(range(4), rng.randrange(1, 4))] + ([f"N{rng.randrange(30)} 0"] if rng.random() < 0.1 else [])
        id = f"s/{k}" if rng.random() < 0.9 or not rows else rng.choice(rows)[0]
        rows.append((id, k, rng.choice(["2024-01-01", None]), " ".join(words), "", ",".join(names), ["news", rng.choice("xy")], "war", None, "UA", None, f"said {k}", None))
    return rows


@pytest.mark.parametrize("deferred", [False, True])
def test_parts_of_a_day_give_the_same_stories(deferred, spark):
    """Folded in parts or whole: the same stories, pairs and counts, stored ones too."""
    first, second = busy(250, 7), busy(150, 8, 250) + [(*r[:3], "w1_1 w2_2", *r[4:]) for r in busy(250, 7)[:20]]
    stored = None
    for rows in (first, second):
        df = spark.createDataFrame(rows, ITEM).repartition(4)
        whole, apart = (stories.fold(df, 5, stored, deferred=deferred, parts=p) for p in (False, True))
        content = lambda rows: sorted((r.kind, r.date or "", r.id, tuple(r.memberIds or ()), tuple(r.keyEntities or ()), tuple(r.tags or ()), r.title or "") for r in rows if r.kind != "count")
        held, parts = whole.collect(), apart.collect()
        assert content(parts) == content(held) and len(held) > 40
        for n in ("n_created", "n_merged", "n_capped", "n_adjudicated"):
            assert sum(r[n] for r in parts) == sum(r[n] for r in held)
        keep = [c for c in whole.columns if not c.startswith("n_")]
        stored = spark.createDataFrame([tuple(r[c] for c in keep) for r in held if r.kind == "story"], whole.select(*keep).schema)
    keyed = stories.with_key(spark.createDataFrame(first, ITEM)).withColumn("date", F.coalesce("date", F.lit(""))).select("id", "date", "key")
    none = keyed.limit(0).withColumn("memberIds", F.array("id"))
    parts = stories.day_parts(keyed, none, *[0.35, {"entities": 0.6, "titleTokens": 0.25, "tags": 0.15}])
    sizes = sorted((r["count"] for r in parts.groupBy("date", "part").count().collect()), reverse=True)
    assert len(sizes) > 20 and sizes[0] < 100  # a word of the whole day joins nothing
    with pytest.raises(ValueError):
        stories.day_parts(keyed, none, 0.2, {"entities": 0.6, "titleTokens": 0.25, "tags": 0.15})


def test_the_best_story_is_found_without_the_words_of_a_whole_day():
    """Of a day of unlike stories few meet an item, and none that could be the best is missed."""
    looked = []

    class Counted(stories.Day):
        def story(self, id):
            looked.append(id)
            return super().story(id)

    weights = {"entities": 0.6, "titleTokens": 0.25, "tags": 0.15}
    rng = random.Random(5)
    for band, most in (((0.35, 0.72), 3), ((0.1, 0.72), 120)):
        day = Counted(band, weights, 5)
        for k in range(600):
            sets = {"entities": {f"N{k}"} if k % 2 else set(), "titleTokens": {"the", "city", *(f"w{rng.randrange(k + 9)}" for _ in range(5))}, "tags": {"en", f"h{k % 40}"}}
            looked.clear()
            got = day.best(sets)
            assert k < 50 or len(looked) < most * 10
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
            every = [(-sum(w * like(sets[p], s.sets[p]) for p, w in weights.items()), not s.touched, s.order, s.id) for s in day.stories.values()]
            if every and -min(every)[0] > band[0]:
                assert got[0] == min(every)[3] and got[1] == pytest.approx(-min(every)[0])
            else:
                assert got is None or got[1] <= band[0]
            item = {"id": f"s/{k}", "key": {p: sorted(x) for p, x in sets.items()}, "message_tags": [], "same": [], "image": None, "title": None, "location": None}
            day.take(item)
    assert len(day.stories) > 100


def test_writes_fold_once(spark):
    """The fold of a batch stands once in the plan of its writes."""
    member = "map<string, struct<summary: string, links: array<struct<id: bigint, href: string>>, channel: string, ts: bigint>>"
    none = spark.createDataFrame([], f"id string, status string, members {member}, title string, country string, location string, peoples string, tags array<string>, image string")
    rows = spark.createDataFrame(batch(30, 3), ITEM)
    plan = stories.merge_writes(stories.fold(rows, 5), rows, none)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
