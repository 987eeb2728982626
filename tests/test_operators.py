"""Operators on small tables: hand-computed values, boundaries, re-runs."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import text
from newsloom.functions.dates import backoff, clock, date_key
from newsloom.functions.match import classify, jaccard
from newsloom.functions.spans import clamp, tokenise
from newsloom.operators import calibrate, console, grid, publish, stories, tables, work
from newsloom.streaming import flows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scores_and_verdicts(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    assert value(spark, jaccard(a, a)) == 1 and value(spark, jaccard(none, none)) == 0
    assert abs(value(spark, jaccard(a, b)) - 1 / 3) < 1e-12
    assert [value(spark, classify(F.lit(x))) for x in (0.72, 0.35, 0.5)] == ["merge", "distinct", "adjudicate"]


def test_curve_by_hand(spark):
    """Scores 0.6, 0.3, 0, 0.3: at (0.3, 0.6) all is right, at (0.2, 0.5) half the splits."""
    rows = spark.createDataFrame([(0.6, True), (0.3, False), (0.0, False), (0.3, False)], "score double, same boolean")
    got = {(r[0], r[1]): r[2:] for r in calibrate.sweep(rows, 0.1).collect()}
    assert len(got) == 66
    assert got[0.3, 0.6] == (1.0, 1.0, 0.0)
    assert got[0.2, 0.5] == (1.0, pytest.approx(1 / 3), 0.5)
    for step in (0, -1, float("nan"), 0.003, 0.3):
        with pytest.raises(ValueError):
            calibrate.threshold_grid(step)


def test_texts(spark):
    assert value(spark, text.canonical(F.lit("  It's  A-Test, ÄÖ\t№ "))) == "its a-test äö"
    assert value(spark, text.escape_html(F.lit('<a&"b">'))) == "&lt;a&amp;&quot;b&quot;&gt;"
    assert value(spark, text.hashtag(F.lit("St. John's-Town"))) == "#st_johns_town"
    assert value(spark, text.render_template(F.lit("{a}\n\n\n\n{b}{zz}"), {"a": F.lit("{b}"), "b": F.lit("x")})) == "{b}\n\nx"
    assert value(spark, text.utf16_length(F.lit("🔘a"))) == 3
    assert value(spark, text.csv_cell(F.lit('a"b,c'))) == '"a""b,c"'
    assert value(spark, date_key(F.lit(1_706_572_799_999))) == "2024-01-29"
    assert [value(spark, backoff(F.lit(n))) for n in (1, 2, 3)] == [30_000, 60_000, 120_000]
    assert [value(spark, clock(F.lit(s))) for s in (65, 3725)] == ["01:05", "1:02:05"]
    assert clamp("x" * 220) == "x" * 220 and clamp("word " * 60).endswith("word…")
    assert tokenise("see 🔘 here", [{"offset": 4, "length": 2, "url": "u"}]) == ("see [🔘](#1) here", [{"id": 1, "href": "u"}])


def test_first_candidate_that_fits(spark):
    options = F.array(F.lit("x" * 4097), F.lit("y" * 4096), F.lit("z"))
    assert value(spark, text.first_fit(options))[0] == "y"
    assert value(spark, text.first_fit(F.array(F.lit("x" * 5000), F.lit("w" * 4100))))[0] == "w"


ITEM = "id string, seq long, date string, title string, peoples string, properNames string, tags array<string>, category string, image string, country string, location string"


def items(spark, rows):
    return spark.createDataFrame([(i, n, "2024-01-01", t, "", p, ["News"], "war", None, "UA", "") for n, (i, t, p) in enumerate(rows)], ITEM)


def test_fold_merges_and_replays(spark):
    rows = [("s/1", "Storm hits city", "Ann, Bob"), ("s/2", "Storm hits city", "Ann, Bob"), ("s/3", "Other event here", "Cyd"), ("s/1", "Storm hits city", "Ann, Bob")]
    got = {r.id: r for r in stories.fold_stories(items(spark, rows), 5).collect()}
    assert {k: v.memberIds for k, v in got.items()} == {"s/1": ["s/1", "s/2"], "s/3": ["s/3"]}
    assert got["s/1"].tags == ["war", "news"]
    many = [(f"s/{k}", "Storm hits city", "Ann") for k in range(25)]
    (one,) = stories.fold_stories(items(spark, many), 5).collect()
    assert (one.memberCount, one.n_capped) == (20, 5)


def test_band_needs_a_verdict(spark):
    rows = items(spark, [("s/1", "Storm hits city", "Ann, Bob"), ("s/2", "Storm ends", "Ann, Cyd")])
    keyed = stories.with_key(rows).select("id", "date", "key")
    (score,) = [r.score for r in stories.pair_scores(keyed, keyed).where("item > story").collect()]
    assert 0.35 < score < 0.72 and score == pytest.approx(stories.all_pairs(keyed, keyed).where("item > story").first().score)
    assert stories.fold_stories(rows, 5).count() == 2
    assert stories.fold_stories(rows, 5, {"s/2->s/1": True}).count() == 1


def test_receivers_need_every_tag(spark):
    m = spark.createDataFrame([("m/1", ["war", "ua"]), ("m/2", ["war"])], "id string, tags array<string>")
    t = spark.createDataFrame([("a", ["War", "UA"], False), ("b", [], False), ("c", ["war"], None), ("d", ["war"], True)], "id string, tags array<string>, deleted boolean")
    assert {tuple(r) for r in publish.receivers(m, t).collect()} == {("m/1", "a"), ("m/1", "c"), ("m/2", "c")}


def test_receivers_same_as_the_containment_of_sets(spark):
    rng = random.Random(6)
    tags = [f"T{k}" for k in range(12)]
    m = [(f"m/{k}", ["all", *rng.sample(tags, rng.randrange(0, 6))] if k else None) for k in range(80)] + [("m/x", ["ALL", None, "t1", "T1"])]
    t = [(f"t{k}", rng.sample(["ALL", *tags, "none"], rng.randrange(0, 4)), rng.choice([None, False, True])) for k in range(60)]
    got = publish.receivers(spark.createDataFrame(m, "id string, tags array<string>"), spark.createDataFrame(t, "id string, tags array<string>, deleted boolean")).collect()
    low = lambda x: {y.lower() for y in x or [] if y}
    assert sorted(map(tuple, got)) == sorted((a, b) for a, x in m for b, y, gone in t if y and not gone and low(y) <= low(x))


def test_curve_by_bins_same_as_by_rows(spark):
    """Scores on, between and beyond the thresholds."""
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 0.1, 0.25, 0.3, 0.35, 0.999, 1.0, rng.random()]), rng.random() < 0.4) for _ in range(400)]
    got = {(r[0], r[1]): r[2:] for r in calibrate.sweep(spark.createDataFrame(rows, "score double, same boolean"), 0.05).collect()}
    values = calibrate.threshold_grid(0.05)
    assert set(got) == {(d, m) for d in values for m in values if d <= m}
    for (d, m), (precision, recall, band) in got.items():
        merged = [same for x, same in rows if x >= m]
        split = [same for x, same in rows if x < m and x <= d]
        assert precision == (pytest.approx(sum(merged) / len(merged)) if merged else None)
        assert recall == pytest.approx(split.count(False) / sum(not s for _, s in rows))
        assert band == pytest.approx((len(rows) - len(merged) - len(split)) / len(rows))


def test_upserts(spark):
    tags = spark.createDataFrame([("a", ["x"], 5, "2024-01-01", False), ("gone", ["y"], 7, "2024-01-02", True)], schemas.TAGS)
    edit = spark.createDataFrame([("a", ["z"]), ("gone", ["w"]), ("new", None)], "id string, keywords array<string>")
    got = {r.id: (r.keywords, r["count"], r.lastDate, r.deleted) for r in console.upsert("tags", tags, edit).collect()}
    assert got == {"a": (["z"], 5, "2024-01-01", False), "gone": (["w"], 0, None, None), "new": ([], 0, None, None)}
    sources = spark.createDataFrame([("s", "ok")], "id string, status string").select("id", "status", *[F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("lastCount", "long"), ("deleted", "boolean"))])
    made = {r.id: (r.status, r.type, r.lastCount) for r in console.upsert("sources", sources, spark.createDataFrame([("s", "off"), ("n", "ok")], "id string, status string")).collect()}
    assert made == {"s": ("off", None, None), "n": ("ok", "telegram", 0)}
    messages = spark.createDataFrame([("m/1", "t")], "id string, title string")
    with pytest.raises(ValueError, match="no such message: m/2"):
        console.upsert("messages", messages, spark.createDataFrame([("m/2", "u")], messages.schema))
    with pytest.raises(ValueError, match="not writable"):
        console.upsert("sources", sources, spark.createDataFrame([("s", 1)], "id string, lastCount long"))


def test_edited_items(spark):
    row = ("i", "publish", "pending", "{}", 0, 1, None, None, None, None, 1, None, None, None)
    items = spark.createDataFrame([row, ("r", "publish", "running", *row[3:])], schemas.INGEST)
    new = '{"messageId": "m/1"}'
    assert {r.id: r.raw for r in console.edit_item(items, "i", new).collect()} == {"i": new, "r": "{}"}
    for id, raw, why in (("i", "{}", "messageId: missing"), ("i", "x", "not an object"), ("r", new, "no longer"), ("no", new, "no such item")):
        with pytest.raises(ValueError, match=why):
            console.edit_item(items, id, raw)


def test_tables(spark):
    base = spark.createDataFrame([(1, "x", None), (2, "y", False)], "id long, s string, deleted boolean")
    got = tables.patch(base, spark.createDataFrame([(1, ""), (3, "z")], "id long, s string"))
    assert {tuple(r) for r in got.collect()} == {(1, "", None), (2, "y", False), (3, "z", None)}
    assert {tuple(r) for r in tables.list_all(tables.soft_delete(base, base.where("id = 2"))).select("id").collect()} == {(1,)}
    with pytest.raises(ValueError):
        tables.put_new(base, base)
    with pytest.raises(ValueError):
        schemas.check_writable("sources", ["nope"])


def test_queue_transitions(spark):
    row = ("i", "analyze", "running", "{}", 0, 1, 50, None, None, None, 1, 1, None, None)
    rows = spark.createDataFrame([row, ("k", *row[1:4], 2, *row[5:])], schemas.INGEST)
    got = {r.id: (r.status, r.retryCount, r.runAt) for r in work.reclaim(rows, 100).collect()}
    assert got == {"i": ("pending", 1, 30_100), "k": ("error", 3, 1)}
    ok = spark.createDataFrame([("i", True, None, None)], "id string, ok boolean, error string, cause string")
    assert {r.id: r.status for r in work.settle(rows, ok, 100).collect()} == {"i": "done", "k": "running"}


def test_sort_puts_blanks_last(spark):
    df = spark.createDataFrame([(1, "b"), (2, ""), (3, "ä"), (4, None), (5, "a")], "id long, s string")
    assert [r.id for r in grid.sort(df, "s", False).collect()] == [5, 3, 1, 2, 4]
    assert [r.id for r in grid.sort(df, "s", True).collect()] == [1, 3, 5, 2, 4]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("m", "2024-01-01 00:01:00"), ("m", "2024-01-01 00:02:00"), ("m", "2024-01-01 00:06:00"), ("n", "2024-01-02 00:00:00")], "message string, ts string")
    rows.select("message", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = flows.settled_publishes(spark.readStream.schema("message string, ts timestamp").parquet(str(tmp_path / "in")))
    got = []
    flows.write_batches(stream, str(tmp_path / "check"), lambda batch, epoch: got.extend(batch.collect())).awaitTermination(120)
    assert sorted(r.runAt for r in got if r.message == "m") == [1704067560000, 1704067860000]


def test_ranked_gives_every_row_its_place(spark):
    """More than 100 rows, over many partitions, with ties and blanks."""
    rows = [(k, None if k % 97 == 0 else float(k * 7919 % 500), ["", None, "b", "a"][k % 4]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, n double, s string").repartition(13)
    for column, at, descending in (("n", 1, True), ("n", 1, False), ("s", 2, False)):
        flip = -1 if descending else 1
        order = lambda r: (r[at] in (None, ""), (flip * r[1] if at == 1 else r[2]) if r[at] else 0, r[0])
        got = grid.ranked(df, column, descending).collect()
        assert [(r.id, r.place) for r in sorted(got, key=lambda r: r.place)] == [(r[0], k) for k, r in enumerate(sorted(rows, key=order), 1)]
