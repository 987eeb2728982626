"""Operators no query can show well: readers, records, single edits, errors, streams."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.config import WEIGHTS
from newsloom.operators import calibrate, console, grid, items, publish, tables, work
from newsloom.sources import readers
from newsloom.streaming import flows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# -- readers


def test_labelled_pairs(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": "x/1", "b": "x/2", "label": "same"}\n\n  \n{"a": "x/1", "b": "x/3", "label": "different"}\n')
    assert {tuple(r) for r in readers.labelled_pairs(spark, str(good)).collect()} == {("x/1", "x/2", "same"), ("x/1", "x/3", "different")}
    for line in ('{"a": "x/1", "b": "x/2", "label": "maybe"}', '{"a": "x/1", "label": "same"}', "no json"):
        bad.write_text(good.read_text() + line + "\n")
        with pytest.raises(ValueError, match="line 5 is not a labelled pair"):
            readers.labelled_pairs(spark, str(bad))


def test_calibration_items(spark, tmp_path):
    path, item = tmp_path / "items.json", {"id": "x/1", "title": "T", "peoples": "", "properNames": "", "tags": ["a"]}
    path.write_text(json.dumps([item, {**item, "id": "x/2"}], indent=1))
    assert readers.calibration_items(spark, str(path)).count() == 2
    path.write_text(json.dumps([item, item]))
    with pytest.raises(ValueError, match="repeated item: x/1"):
        readers.calibration_items(spark, str(path))


def test_emulated_posts(spark):
    rows = readers.emulated_posts(spark, 1000, ["a", "b"], 20, 3).collect()
    assert [r.id for r in rows] == [str(1000 + k) for k in range(20)] and {r.body for r in rows} == {"a", "b"}


# -- calibration records


def test_calibration_record(tmp_path):
    path = tmp_path / "record.json"
    assert calibrate.read_record(str(path)) is None and calibrate.production_blocker(None)
    record = {"mergeThreshold": 0.72, "distinctThreshold": 0.35, "weights": WEIGHTS, "autoMergePrecision": 1, "autoSplitRecall": 1, "bandFraction": 0, "adjudicatorAccuracy": 1, "labelledSetHash": "sha256:", "pairs": 100, "recordedAt": "2024"}
    path.write_text(json.dumps(record))
    assert calibrate.read_record(str(path)) == record and calibrate.production_blocker(record) is None
    for change in ({"pairs": 99}, {"mergeThreshold": 0.8}, {"weights": {**WEIGHTS, "tags": 0.5}}):
        assert calibrate.production_blocker({**record, **change})
    for change in ({"pairs": -1}, {"bandFraction": 1.5}, {"distinctThreshold": 0.9}, {"more": 1}, {"weights": {}}):
        path.write_text(json.dumps({**record, **change}))
        with pytest.raises(ValueError):
            calibrate.read_record(str(path))
    assert calibrate.labelled_set_hash("a", "b") == calibrate.labelled_set_hash("ab", "") == "sha256:fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"


def test_curve_lines(spark):
    curve = spark.createDataFrame([(0.5, 0.6, None, 0.5, 0.25), (0.1, 0.6, 1.0, 0.5, 0.25)], "distinctThreshold double, mergeThreshold double, autoMergePrecision double, autoSplitRecall double, bandFraction double")
    assert [r.line for r in calibrate.curve_csv(curve).collect()] == ["distinctThreshold,mergeThreshold,autoMergePrecision,autoSplitRecall,bandFraction", "0.1,0.6,1.0,0.5,0.25", "0.5,0.6,,0.5,0.25"]


# -- queue edits


@pytest.fixture
def queue(spark):
    row = lambda id, status: (id, "analyze", status, "{}", 2, 500, None, "boom", "why", None, 1, 1, 9, None)
    return spark.createDataFrame([row(s[0], s) for s in ("pending", "running", "error", "done")], schemas.INGEST)


def test_one_item_now(queue):
    """Pending and failed items may run now; failed ones start anew; others stay."""
    seen = {}
    for id in "pred":
        seen[id] = {r.id: (r.status, r.retryCount, r.runAt, r.error) for r in work.run_item_now(queue, id).collect()}[id]
    assert seen == {"p": ("pending", 2, 0, "boom"), "r": ("running", 2, 500, "boom"), "e": ("pending", 0, 0, None), "d": ("done", 2, 500, "boom")}


def test_payloads_and_diagnoses(queue):
    for id, changed in zip("pred", (True, False, True, False)):
        assert work.save_raw(queue, id, "new").where("raw = 'new'").count() == changed
    for id, changed in zip("pred", (False, False, True, False)):
        got = work.save_diagnosis(queue, id, "s", "c", "f", 7).where("diagnosis is not null").collect()
        assert [tuple(r.diagnosis) for r in got] == [("s", "c", "f", 7)] * changed
    left, n = console.reset_ingest(queue)
    assert (left.count(), n) == (0, 4)


def test_who_may_run(spark):
    controls = spark.createDataFrame([("analyze", True, 0, 1), ("publish", True, 2, 1)], "stage string, paused boolean, budget long, requestedAt long")
    assert {r.stage for r in console.may_run(controls).collect()} == {"aggregate", "publish"}


# -- users, new rows, edits


def test_whoami(spark):
    users = spark.createDataFrame([("a@x", True, ["admin"])], "email string, enabled boolean, roles array<string>")
    assert tuple(console.whoami(users, "a@x").first()) == ("a@x", True, ["admin"])
    assert tuple(console.whoami(users, "b@x").first()) == ("b@x", False, [])


def test_new_sources_and_targets(spark):
    sources, targets = spark.createDataFrame([], schemas.SOURCES), spark.createDataFrame([], schemas.TARGETS)
    one = console.add_source(sources, {"id": " @news ", "tags": ["a", "b"]})
    got = one.first()
    assert (got.id, got.status, got.type, got.tags, got.lastCount) == ("news", "ok", "telegram", ["a", "b"], None)
    with pytest.raises(ValueError, match="already exists: news"):
        console.add_source(one, {"id": "news"})
    for row in ({}, {"id": 5}, {"id": "x", "color": "red"}):
        with pytest.raises(ValueError, match="bad input"):
            console.add_source(sources, row)
    with pytest.raises(Exception, match="exactly one id"):
        console.add_source(sources, {"id": "a, b"}).collect()
    assert console.add_target(targets, {"id": "@out"}).first().id == "out"


def test_edits():
    schemas.check_writable("tags", [])
    schemas.check_writable("sources", ["status", "tags"])
    with pytest.raises(ValueError, match="at least one"):
        schemas.check_writable("messages", [])
    with pytest.raises(ValueError, match="not writable: posts, ts"):
        schemas.check_writable("messages", ["title", "ts", "posts"])


def test_republishing_lost_messages(spark):
    m = spark.createDataFrame([("m/1", "published", 1, False), ("m/2", "published", 1, True)], "id string, status string, ts long, deleted boolean")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    for lost in ("m/2", "m/3"):
        with pytest.raises(ValueError, match=f"no such message: {lost}"):
            console.republish(m, ids("m/1", lost), 50)


def test_audited_jobs():
    told = []
    with pytest.raises(RuntimeError), console.audited_job("nightly", told.append, 5):
        raise RuntimeError("boom")
    assert len(told) == 1
    with console.audited_job("nightly", told.append, 5):
        pass
    assert len(told) == 1


# -- small values


def test_console_texts(spark):
    assert value(spark, console.export_name("tags", 1_706_572_799_999)) == "tags-2024-01-29.csv"
    assert console.seed_text([{"b": "ä", "a": 1}]) == '[\n  {\n    "a": 1,\n    "b": "ä"\n  }\n]\n'
    assert [grid.next_sort(c, "n") for c in (None, ("n", "asc"), ("n", "desc"), ("m", "desc"))] == [("n", "asc"), ("n", "desc"), None, ("n", "asc")]
    blank = [value(spark, grid.is_blank(F.lit(t).cast("string"))) for t in (None, "", " \t", "0")]
    assert blank == [True, True, True, False]


def test_published_state_keeps_the_last_result(spark):
    """Two results for one target: the later one counts."""
    m = spark.createDataFrame([("m/1", "topublish", {}, 10, False)], f"id string, status string, posts map<string, {schemas.POST}>, ts long, deleted boolean")
    results = spark.createDataFrame([("m/1", "t", "sendMessage", True, "7", None, 20), ("m/1", "t", "sendMessage", True, "8", None, 30)], "message string, target string, method string, ok boolean, tgId string, error string, at long")
    got = publish.published_state(m, results, 40).first()
    assert (got.status, got.ts, got.posts["t"].tgId) == ("published", 40, "8")


def test_empty_tables(spark):
    base = spark.createDataFrame([], "id string, n long")
    one = spark.createDataFrame([("a", None)], "id string, n long")
    assert tables.put(base, one).count() == tables.put_absent(base, one).count() == tables.patch(base, one).count() == 1
    assert tables.put(one, base).count() == 1 and tables.stale(base, one).count() == 0
    assert tables.pick_in_order(one, [], "n").count() == 0
    assert items.select_sources(spark.createDataFrame([], schemas.SOURCES), 5).count() == 0


def test_counters_in_a_stream(spark, tmp_path):
    """What arrives in two files counts once an hour is past the watermark."""
    schema = "ts timestamp, name string, by string, value long"
    for k, rows in enumerate([[("2024-01-01 00:10:00", "n", "", 1), ("2024-01-01 00:50:00", "n", "", 2)], [("2024-01-01 00:20:00", "n", "", 4), ("2024-01-01 05:00:00", "n", "", 8)]]):
        spark.createDataFrame(rows, "ts string, name string, by string, value long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.hourly_counters(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = []
    flows.write_batches(stream, str(tmp_path / "check"), lambda batch, epoch: got.extend(batch.collect())).awaitTermination(120)
    assert [(r.hour, r.value) for r in got if r.hour == 1704067200000] == [(1704067200000, 7)]
