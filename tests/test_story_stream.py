"""The story stream against the batch fold."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import stories
from newsloom.streaming import flows
from newsloom.streaming import stories as stream

from .test_stories import ITEM, batch


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(spark, rows, schema=ITEM):
    return spark.createDataFrame(rows, schema)


class Run:
    """A stream that is started anew, from its checkpoint, for each batch."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.where, self.options, self.got = spark, tmp_path, options, []

    def stream(self, name, schema):
        (self.where / name).mkdir(exist_ok=True)
        return self.spark.readStream.schema(schema).parquet(str(self.where / name))

    def __call__(self, schema, **sides):
        items = self.stream("items", schema)
        more = {name: self.stream(name, kind) for name, kind in sides.items()}
        out = []
        query = flows.write_batches(stream.merge_stories(items, 5, **more, **self.options), str(self.where / "check"), lambda b, epoch: out.extend(b.collect()))
        assert query.awaitTermination(60)  # ends by itself
        self.got += out
        return out

    def stories(self):
        """The last state of each story."""
        return {r.id: list(r.memberIds) for r in self.got if r.kind == "story"}


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_three_batches_with_restarts_equal_the_batch_fold(spark, tmp_path):
    run, stored, want = Run(spark, tmp_path), None, {}
    for k in range(3):
        rows = batch(40, 20 + k, 40 * k)
        if k:
            rows += [(*r[:3], "Nothing alike", *r[4:]) for r in batch(40, 20)[:4]]  # replays under another title
        df = rows_of(spark, rows)
        write(df, tmp_path / "items")
        out = run(df.schema)
        assert sorted(r.id for r in out if r.kind == "item") == sorted(r[0] for r in rows)
        folded = stories.fold_stories(df, 5, stored=stored)
        now = {r.id: r for r in folded.collect()}
        want |= {i: list(r.memberIds) for i, r in now.items()}
        keep = [c for c in folded.columns if not c.startswith("n_")]
        fresh = rows_of(spark, [tuple(r[c] for c in keep) for r in now.values()], folded.select(*keep).schema)
        stored = fresh if stored is None else stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
        stored = rows_of(spark, stored.collect(), stored.schema)
        assert {r.id: list(r.memberIds) for r in out if r.kind == "story"} == {i: list(r.memberIds) for i, r in now.items()}
    assert run.stories() == want
    assert run(df.schema) == []  # nothing new from the checkpoint
    # an item that comes again changes no story
    write(rows_of(spark, batch(40, 22, 80)[:7]), tmp_path / "items")
    again = run(df.schema)
    assert {r.outcome for r in again if r.kind == "item"} == {"replayed"} and run.stories() == want


TIMED = ITEM + ", ts timestamp"


def timed(df, at):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(at)))


def test_verdicts_that_come_later(spark, tmp_path):
    """Deferred pairs wait in the state; items first, verdicts in the next batch."""
    items = rows_of(spark, batch(60, 1))
    whole = stories.fold(items, 5, deferred=True)
    pairs = sorted(r.id for r in stories.band_pairs(whole).collect())
    said = {p: k % 2 == 0 for k, p in enumerate(pairs)}
    date = {r.id: r.date for r in stories.band_pairs(whole).collect()}
    verdicts = rows_of(spark, [(date[p], p, s) for p, s in said.items()], "date string, id string, same boolean")
    want = {r.id: list(r.memberIds) for r in stories.fold_stories(items, 5, verdicts.select("id", "same"), deferred=True).collect()}
    run = Run(spark, tmp_path, deferred=True)
    write(timed(items, 1000), tmp_path / "items")
    kind = timed(verdicts, 0).schema
    first = run(timed(items, 0).schema, verdicts=kind)
    assert sorted(r.id for r in first if r.kind == "pair") == pairs and len(pairs) > 5
    assert sorted(r.id for r in first if r.kind == "item" and r.outcome == "waiting") == sorted(p.split("->")[0] for p in pairs)
    write(timed(verdicts, 1010), tmp_path / "verdicts")
    second = run(timed(items, 0).schema, verdicts=kind)
    assert len([r for r in second if r.kind == "item"]) == len(pairs)
    assert run.stories() == want


def test_pairs_without_a_verdict_split_in_time(spark, tmp_path):
    items = rows_of(spark, batch(60, 1))
    want = {r.id: list(r.memberIds) for r in stories.fold_stories(items, 5, deferred=True).collect()}
    run = Run(spark, tmp_path, deferred=True, lateness="0 seconds", wait_ms=60_000)
    write(timed(items, 1000), tmp_path / "items")
    waiting = [r for r in run(timed(items, 0).schema) if r.outcome == "waiting"]
    assert len(waiting) > 5
    other = rows_of(spark, [("z/1", 1, "2024-02-02", "else", "", "", [], "war", None, None, None, None, None)])
    write(timed(other, 1100), tmp_path / "items")  # the watermark passes the wait
    later = run(timed(items, 0).schema)
    assert sorted(r.id for r in later if r.outcome == "created") == sorted([*(r.id for r in waiting), "z/1"])
    assert {k: v for k, v in run.stories().items() if k != "z/1"} == want


def test_a_closed_day_starts_anew(spark, tmp_path):
    items = rows_of(spark, batch(5, 3))
    run = Run(spark, tmp_path)
    write(items, tmp_path / "items")
    end = rows_of(spark, [("2024-01-01",), ("2024-01-02",)], "date string")
    outcomes = lambda rows: sorted((r.id, r.outcome) for r in rows if r.kind == "item")
    first = outcomes(run(items.schema, closed=end.schema))
    write(end, tmp_path / "closed")
    run(items.schema, closed=end.schema)
    write(items, tmp_path / "items")
    assert first and outcomes(run(items.schema, closed=end.schema)) == first


def test_logs_are_written_by_many_tasks(spark, monkeypatch):
    """No log goes through one task."""
    from newsloom.plans import live, views

    logs, items = [], views.items
    monkeypatch.setattr(views, "items", lambda *a: items(*a).repartition(4))
    monkeypatch.setattr(live, "_streamed", lambda spark, log, make: logs.append(log) or make_none(spark))
    make_none = lambda spark: spark.createDataFrame([], stream.ROW)
    live.story_stream(spark, "/root/testdata/sf0.001")
    assert logs[0].rdd.getNumPartitions() == 4
