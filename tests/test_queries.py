"""Every registered query against its SQL; those without SQL against plain Python."""

import hashlib

import duckdb
import pytest

from newsloom.plans import queries as plans

from .conftest import DATA, TABLES


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(plans.queries()[name], plans.oracle_sql()[name], f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql_has_rows(name):
    """No comparison of nothing with nothing."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.01/{t}.parquet')")
    assert con.execute(f"SELECT count(*) FROM ({plans.oracle_sql()[name]})").fetchone()[0] > 0


def test_transcripts_by_hand(spark):
    """Lines every ten seconds, joined until one starts 25 seconds after its chunk."""
    table = spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet")
    talks = {}
    for r in table.collect():
        if said := " ".join((r.text or "").split()):
            talks.setdefault(r.conv_id, []).append((10 * r.turn, said))
    clock = lambda s: f"{s // 60:02}:{s % 60:02}" if s < 3600 else f"{s // 3600}:{s % 3600 // 60:02}:{s % 60:02}"
    for r in plans.queries()["transcripts"](spark, f"{DATA}/sf0.001").collect():
        parts = []
        for start, said in sorted(talks.get(r.conv_id, [])):
            if parts and start - parts[-1][0] < 25:
                parts[-1][1] += " " + said
            else:
                parts.append([start, said])
        url = f"https://www.youtube.com/watch?v={r.conv_id}"
        lines = "\n".join(f"- [{clock(s)}]({url}&t={s}s) {said}" for s, said in parts)
        want = f"# Talk {r.conv_id}\n\n{url}\n\n> channel · 1:02:05 · captions: en\n\n{lines}\n"
        assert (r.n_chunks, r.digest) == (len(parts), hashlib.md5(want.encode()).hexdigest())


def test_story_fold_by_replay(spark):
    """The registered query against the plain replay of the rules."""
    from newsloom.operators import stories
    from newsloom.plans import views

    from .test_stories import replayed

    sf = f"{DATA}/sf0.001"
    rows = stories.with_key(views.items(spark, sf)).select("id", "seq", "date", "key").collect()
    # the replay reads sets from text; these have no commas or blanks within terms
    plain = [(r.id, r.seq, r.date, " ".join(r.key.titleTokens), "", ",".join(r.key.entities), r.key.tags) for r in rows]
    want, _ = replayed(plain, [], set(), False)
    got = {r.id: r.members.split("|") for r in plans.queries()["story_fold"](spark, sf).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["verdict", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
