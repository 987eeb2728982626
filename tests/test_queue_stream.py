"""Queue states, source alerts and counters as streams, against plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import items as stage_one
from newsloom.operators import work
from newsloom.streaming import flows, queue

LOG = "id string, stage string, kind string, ts timestamp, until long, error string"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def log(spark, rows):
    df = spark.createDataFrame(rows, "id string, stage string, kind string, at long, until long, error string")
    return df.select("id", "stage", "kind", F.timestamp_millis("at").alias("ts"), "until", "error")


def events(seed, n=25):
    """(rows, end): items that are claimed and end well, badly, or not at all."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        stage, at = rng.choice(["analyze", "aggregate", "publish"]), rng.randrange(1000, 9000)
        rows.append((f"i{k}", stage, "enqueue", at, None, None))
        for _ in range(rng.randrange(6)):
            at += rng.choice([10, 40_000, 90_000, 900_000])
            rows.append((f"i{k}", stage, "claim", at, at + 60_000, None))
            at += rng.choice([5, 59_000, 60_000, 70_000])
            if rng.random() < 0.8:
                rows.append((f"i{k}", stage, rng.choice(["ok", "fail", "fail"]), at, None, "bad"))
    return rows, max(r[3] for r in rows) + 10_000_000


def replayed(rows, end):
    """Status, attempts, runAt, lease of each item, by the rules one by one."""
    most, out = {"analyze": 3, "aggregate": 3, "publish": 5}, {}

    def fail(s, at):
        s["n"] += 1
        s |= {"status": "error"} if s["n"] >= most[s["stage"]] else {"status": "pending", "run": at + 30_000 * 2 ** (s["n"] - 1)}
        s["lease"] = None

    for id, stage, kind, at, until, _ in sorted(rows, key=lambda r: (r[3], r[2])) + [(i, None, "end", end, None, None) for i in {r[0] for r in rows}]:
        s = out.setdefault(id, {"stage": stage, "status": "pending", "n": 0, "run": at, "lease": None}) if kind == "enqueue" else out[id]
        if s["status"] == "running" and s["lease"] < at:
            fail(s, s["lease"])
        if kind == "claim" and s["status"] == "pending" and s["run"] <= at:
            s |= {"status": "running", "lease": until}
        elif kind == "ok" and s["status"] == "running":
            s |= {"status": "done", "lease": None}
        elif kind == "fail" and s["status"] == "running":
            fail(s, at)
    return {i: (s["status"], s["n"], s["run"], s["lease"]) for i, s in out.items()}


def run(spark, path, schema, make, check):
    out = []
    stream = make(spark.readStream.schema(schema).parquet(str(path)))
    assert flows.write_batches(stream, str(check), lambda b, epoch: out.extend(b.collect())).awaitTermination(120)
    return out


def test_queue_states_by_replay(spark, tmp_path):
    """In one batch and in three with restarts: the same states as the replay."""
    rows, end = events(3)
    rows.append(("tick", "analyze", "enqueue", end, None, None))
    want = replayed(rows, end)
    rows.sort(key=lambda r: r[3])
    for name, cuts in (("one", [rows]), ("three", [rows[:30], rows[30:55], rows[55:]])):
        got = []
        for part in cuts:
            log(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            got += run(spark, tmp_path / name, LOG, lambda s: queue.queue_states(s, "0 seconds"), tmp_path / f"check-{name}")
        states = queue.last_states(spark.createDataFrame(got, queue.ITEM))
        held = {r.id: (r.status, r.retryCount, r.runAt, r.leaseUntil) for r in states.collect()}
        assert held == want
        assert {r.error for r in states.where("retryCount > 0 and status <> 'done'").collect()} <= {"bad", queue.LEASE_LOST}
        due = {r.id for r in got if r.due}
        assert due >= {i for i, s in want.items() if s[0] == "pending" and i != "tick"}
        waked = queue.wakes(spark.createDataFrame(got, queue.ITEM), spark.createDataFrame([("publish",), ("other",)], "stage string"))
        assert {r.stage for r in waked.collect()} <= {"analyze", "aggregate", "publish"} and waked.count() == 3


def test_queue_states_same_as_the_table_transitions(spark, tmp_path):
    """One claim each: work.settle and work.reclaim at the same times."""
    rng = random.Random(9)
    rows, ended = [], {}
    for k in range(20):
        rows += [(f"i{k}", "analyze", "enqueue", 1000, None, None), (f"i{k}", "analyze", "claim", 2000, 62_000, None)]
        if (kind := rng.choice(["ok", "fail", None])) is not None:
            ended[f"i{k}"] = kind == "ok"
            rows.append((f"i{k}", "analyze", kind, 3000, None, "bad" if kind == "fail" else None))
    rows.append(("tick", "analyze", "enqueue", 62_002, None, None))
    log(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path / "in", LOG, lambda s: queue.queue_states(s, "0 seconds"), tmp_path / "check")
    stream = {r.id: (r.status, r.retryCount, r.runAt, r.leaseUntil, r.error) for r in queue.last_states(spark.createDataFrame(got, queue.ITEM)).collect() if r.id != "tick"}
    schema = "id string, stage string, status string, raw string, retryCount bigint, runAt bigint, leaseUntil bigint, error string, cause string, finishedAt bigint, expireAt timestamp"
    table = spark.createDataFrame([(f"i{k}", "analyze", "running", "{}", 0, 1000, 62_000, None, None, None, None) for k in range(20)], schema)
    outcomes = spark.createDataFrame([(i, ok, None if ok else "bad", None) for i, ok in ended.items()], "id string, ok boolean, error string, cause string")
    after = work.settle(table, outcomes, 3000)
    lost = work.expired_leases(after, 62_001).select("id", F.lit(False).alias("ok"), F.lit(queue.LEASE_LOST).alias("error"), F.lit(None).cast("string").alias("cause"))
    after = work.settle(after, lost, 62_000)
    assert stream == {r.id: (r.status, r.retryCount, r.runAt, r.leaseUntil, r.error) for r in after.collect()}


def test_drain_until_nothing_is_due(spark):
    schema = "id string, stage string, status string, raw string, retryCount bigint, runAt bigint, leaseUntil bigint, error string, cause string, createdAt bigint, startedAt bigint, finishedAt bigint, expireAt timestamp"
    table = spark.createDataFrame([(f"i{k}", "analyze", "pending", "{}", 0, 10 * k, None, None, None, 0, None, None, None) for k in range(9)], schema)
    fails = lambda rows: rows.select("id", (F.col("id") != "i3").alias("ok"), F.lit("bad").alias("error"), F.lit(None).cast("string").alias("cause"))
    none = spark.createDataFrame([], "stage string, paused boolean, budget bigint, requestedAt bigint")
    ticks = iter(range(1000, 9000, 10))
    items, _, ran = work.drain(table, none, "analyze", fails, lambda: next(ticks), 4)
    assert ran == 9 and {r.id: r.status for r in items.collect()} == {f"i{k}": "pending" if k == 3 else "done" for k in range(9)}
    paused = spark.createDataFrame([("analyze", True, 5, 0)], none.schema)
    items, controls, ran = work.drain(table, paused, "analyze", fails, lambda: next(ticks), 4)
    assert ran == 5 and [r.budget for r in controls.where("stage = 'analyze'").collect()] == [0]
    slow = iter(range(10_000, 10_000_000, 100_000))  # each look at the clock is 100 s later
    assert work.drain(table, none, "analyze", fails, lambda: next(slow), 4)[2] == 4


def test_source_alerts_same_as_cursors(spark, tmp_path):
    rng = random.Random(2)
    polls = [(f"s{k}", 1000 * t + k, n := rng.choice([0, 0, 0, 3]), f"{t}{k}" if n else None) for k in range(6) for t in range(1, 9)]
    polls.append(("tick", 10_000_000, 0, None))
    df = spark.createDataFrame(polls, "id string, at long, n long, newest string").withColumn("ts", F.timestamp_millis("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path / "in", df.schema, lambda s: queue.source_alerts(s, 50_000, "0 seconds"), tmp_path / "check")
    known = spark.createDataFrame([(f"s{k}", None, 0, 0) for k in range(6)], "id string, lastItemId string, zeroYieldRuns long, lastNonZeroCount long")
    for t in range(1, 9):
        posts = spark.createDataFrame([(i, f"{new}{j}" if j else new) for i, at, n, new in polls if at // 1000 == t for j in range(n)] or [("none", "1")], "source_id string, id string")
        posts = posts.withColumn("id", F.when(F.length("id") > 2, F.lit("0")).otherwise(F.col("id")))
        rows = stage_one.cursors(posts, known, 0).collect()
        want = {r.id: (r.lastItemId, r.lastCount, r.zeroYieldRuns, r.lastNonZeroCount, r.stale) for r in rows}
        assert {r.id: (r.lastItemId, r.lastCount, r.zeroYieldRuns, r.lastNonZeroCount, r.stale) for r in got if not r.quiet and r.at // 1000 == t} == want
        known = spark.createDataFrame([(i, *v[:1], v[2], v[3]) for i, v in want.items()], known.schema)
    assert sorted(r.id for r in got if r.quiet) == [f"s{k}" for k in range(6)]


def test_late_rows_are_counted(spark, tmp_path):
    """Events in = counted + late, whatever the batches, and a failed batch counts once."""
    hour = 3_600_000
    parts = [[(10 * hour + 5, "a", "x", 1), (10 * hour + 9, "a", "x", 2)], [(12 * hour, "a", "y", 1), (9 * hour, "b", "x", 4)], [(10 * hour, "a", "x", 1), (None, "a", "x", 1), (13 * hour, "b", "x", 1)]]
    schema = "at long, name string, by string, value long"
    for part in parts:
        df = spark.createDataFrame(part, schema).select(F.timestamp_millis("at").alias("ts"), "name", "by", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert flows.count_hours(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(60)
    facts, late = (r.collect() for r in flows.counted_hours(spark, str(tmp_path / "out")))
    assert {(r.hour // hour, r.name, r.by): r.value for r in facts} == {(10, "a", "x"): 3, (12, "a", "y"): 1, (13, "b", "x"): 1}
    assert sorted((r.hour // hour if r.hour else None, r.name, r.value) for r in late if r.hour) == [(9, "b", 4), (10, "a", 1)]
    assert sum(r.rows for r in facts + late) == sum(map(len, parts))


def test_late_changes_find_their_request(spark, tmp_path):
    parts = [[("m", 600_000), ("n", 10)], [("m", 500_000), ("m", 650_000), ("m", 1_900_000)], [("n", 20), ("n", 5)]]
    for part in parts:
        df = spark.createDataFrame(part, "message string, at long").select("message", F.timestamp_millis("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert flows.settle_publishes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(60)
    every = spark.createDataFrame([r for p in parts for r in p], "message string, at long")
    want = sorted(map(tuple, work.publish_requests(every).select("id", "message", "runAt").collect()))
    assert sorted(map(tuple, flows.settled(spark, str(tmp_path / "out")).collect())) == want


def test_an_item_takes_rows_not_frames():
    """A key's few rows and states go without a frame for each key."""
    from pyspark.sql import Row

    class Kept:
        value, timers = None, []

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

    kept, item = Kept(), queue._Queue()
    item.state = item.handle = kept
    log = [Row(kind=k, ms=at, stage="analyze", until=until, error=None) for k, at, until in (("ok", 30, None), ("claim", 20, 60), ("enqueue", 10, None))]
    got = list(item.handleInputRows(("a",), iter(log), None))
    assert [(r.id, r.at, r.status, r.due) for r in got] == [("a", 10, "pending", False), ("a", 20, "running", False), ("a", 30, "done", False)]
    assert kept.value[1] == "done" and kept.timers == []
