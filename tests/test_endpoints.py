"""Channel posts as a stream, sends with a ledger: kills lose and double nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators import publish
from newsloom.sinks import sends
from newsloom.sources import channels
from newsloom.sources.channels import ChannelPosts
from newsloom.streaming import flows


@pytest.fixture
def place(tmp_path, monkeypatch, spark):
    where = tmp_path / "fakes"
    where.mkdir()
    monkeypatch.setenv("NEWSLOOM_TEST", str(where))
    spark.sparkContext.environment["NEWSLOOM_TEST"] = str(where)  # of the workers
    spark.dataSource.register(ChannelPosts)
    spark.dataSource.register(sends.ChannelSends)
    return where


def post(where, channel, *ids):
    with open(where / f"{channel}.jsonl", "a") as f:
        for i in ids:
            f.write(json.dumps({"id": i, "body": f"{channel} says {i}"}) + "\n")


def test_batch_reader_pages_through(spark, place):
    post(place, "a", 1, 2, 9, 10, 11)
    post(place, "b", 7)
    rows = spark.read.format("channel_posts").option("channels", "a, b, none").option("reader", "tests.fakes:page").option("after", '{"a": "2"}').load()
    assert sorted((r.source_id, int(r.id)) for r in rows.collect()) == [("a", 9), ("a", 10), ("a", 11), ("b", 7)]


@pytest.mark.parametrize("newest", [False, True])
def test_stream_moves_its_offset_on_commit_only(spark, place, tmp_path, newest):
    """The first batch fails after it was read; the next run writes it whole."""
    out, fail = str(tmp_path / "out"), [True]

    def save(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if fail[0]:
            raise OSError("killed between write and commit")

    def run():
        stream = spark.readStream.format("channel_posts").option("channels", "a,b,none").option("reader", "tests.fakes:page")
        stream = (stream.option("newest", "tests.fakes:newest") if newest else stream).load()
        return flows.write_batches(stream, str(tmp_path / "check"), save)

    post(place, "a", 1, 2, 3)
    post(place, "b", 5)
    with pytest.raises(Exception, match="killed between"):
        run().awaitTermination(60)
    post(place, "a", 4)  # comes after the first batch was planned
    fail[0] = False
    assert run().awaitTermination(60)
    post(place, "b", 6, 7)
    assert run().awaitTermination(60)
    assert run().awaitTermination(60)
    got = sorted((r.source_id, int(r.id), r.body) for r in spark.read.parquet(out).collect())
    assert got == sorted((c, i, f"{c} says {i}") for c, i in [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", 6), ("b", 7)])


def calls(where):
    return [json.loads(line) for line in (where / "calls").read_text().splitlines()] if (where / "calls").exists() else []


def requests(spark, n=4, said="text"):
    rows = [(f"m/{k}", f"t{k % 2}", "sendMessage", json.dumps({"chat_id": f"@t{k % 2}", "text": f"{said} {k}"})) for k in range(n)]
    return spark.createDataFrame(rows, "message string, target string, method string, body string")


def send(rows, where, sender="bot"):
    (rows.repartition("target").sortWithinPartitions("message").write.format("channel_sends").option("sender", f"tests.fakes:{sender}").option("ledger", str(where / "ledger")).option("pause_ms", "1").mode("append").save())


def test_a_batch_run_twice_sends_once(spark, place):
    rows = requests(spark)
    send(rows, place)
    send(rows, place)
    assert len(calls(place)) == 4
    held = {r.message: r for r in sends.results(spark, str(place / "ledger")).collect()}
    assert {m: r.ok for m, r in held.items()} == {f"m/{k}": True for k in range(4)}
    # a text that changed is an edit of its post
    send(requests(spark, said="new"), place)
    edits = calls(place)[4:]
    assert {c["method"] for c in edits} == {"editMessageText"} and sorted(str(c["message_id"]) for c in edits) == sorted(r.tgId for r in held.values())
    after = {r.message: r for r in sends.results(spark, str(place / "ledger")).collect()}
    assert {m: r.tgId for m, r in after.items()} == {m: r.tgId for m, r in held.items()}


def test_a_killed_task_sends_no_post_twice(spark, place):
    """The worker dies after three sends; the batch is run again."""
    rows = requests(spark, 6)
    (place / "dies").write_text("3")
    with pytest.raises(Exception):
        send(rows, place)
    (place / "dies").unlink()
    send(rows, place)
    texts = [c["text"] for c in calls(place)]
    assert sorted(texts) == sorted(f"text {k}" for k in range(6))


def test_rejected_sends_are_kept_and_sent_again(spark, place):
    (place / "rejects").write_text("@t1")
    (place / "limits").write_text("@t0")
    rows = requests(spark)
    send(rows, place)
    ledger = sends.results(spark, str(place / "ledger"))
    bad = {r.message: (r.error, r.tries) for r in ledger.where("not ok").collect()}
    assert bad == {"m/1": ("Bad Request: no", 1), "m/3": ("Bad Request: no", 1)}
    assert len(calls(place)) == 5  # one was limited and tried again at once
    at = ledger.agg(F.max("at")).first()[0]
    assert sends.resend(rows, ledger, at).count() == 0
    due = sends.resend(rows, ledger, at + 60_000)
    assert sorted(r.message for r in due.collect()) == ["m/1", "m/3"]
    (place / "rejects").unlink()
    send(due, place)
    done = sends.results(spark, str(place / "ledger"))
    assert done.where("ok").count() == 4
    # the messages after the round
    message = spark.createDataFrame([(f"m/{k}", "topublish", 5, False, None) for k in range(4)], "id string, status string, ts long, deleted boolean, posts map<string, struct<tgId: string, tgAt: bigint>>").withColumn("posts", F.expr("cast(map() as map<string, struct<tgId: string, tgAt: bigint>>)"))
    assert {r.status for r in publish.published_state(message, done, 9).collect()} == {"published"}


@pytest.mark.parametrize("sender, error", [("broken", "no route"), ("garbled", "not an answer (HTTP 502)")])
def test_failures_that_are_no_answers(spark, place, sender, error):
    send(requests(spark, 1), place, sender)
    (row,) = sends.results(spark, str(place / "ledger")).collect()
    assert not row.ok and row.error == error


def test_the_sink_of_a_stream(spark, place, tmp_path):
    rows = requests(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("channel_sends").option("sender", "tests.fakes:bot").option("ledger", str(place / "ledger")).option("pause_ms", "1").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert sorted(c["text"] for c in calls(place)) == [f"text {k}" for k in range(4)]
    assert os.listdir(place / "ledger")


@pytest.mark.parametrize("until", [None, 2500])
def test_an_archive_is_read_file_by_file_once(spark, place, tmp_path, monkeypatch, until):
    """Of 3000 posts in three files each is opened once for its rows; a second run reads what is new."""
    where, out, opened = tmp_path / "archive" / "source_id=a b", str(tmp_path / "out"), []
    where.mkdir(parents=True)

    def lines(name, ids):
        (where / name).write_text("".join(json.dumps({"id": str(i), "body": f"says {i}"}) + "\n" for i in ids))

    for k in range(3):
        lines(f"part-{k}.json", range(k + 1, 3001, 3))
    options = {"channels": "a b,none", "folder": str(tmp_path / "archive")} | ({"until": json.dumps({"a b": str(until)})} if until else {})

    def run():
        stream = spark.readStream.format("channel_posts").options(**options).load()
        assert flows.write_batches(stream, str(tmp_path / "check"), lambda b, epoch: b.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).awaitTermination(60)
        return sorted((r.source_id, int(r.id), r.body) for r in spark.read.parquet(out).collect())

    want = lambda n: [("a b", i, f"says {i}") for i in range(1, n + 1)]
    assert run() == want(until or 3000)
    lines("part-3.json", range(3001, 3101))
    if until:
        options["until"] = json.dumps({"a b": "3050"})
    assert run() == want(3050 if until else 3100)
    reader = ChannelPosts({**options}).reader(None)
    assert len(reader.partitions()) == 4  # one for each file
    kept = channels.archived
    monkeypatch.setattr(channels, "archived", lambda folder, file, *a: opened.append(file) or kept(folder, file, *a))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == (3050 if until else 3100) and len(opened) == len(set(opened)) == 4
