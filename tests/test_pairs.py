"""Pairs of a day against brute force, and what they shuffle."""

from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from newsloom.config import WEIGHTS
from newsloom.operators import calibrate, pairs, stories

from .test_stories import ITEM, batch


def shuffled(spark, df):
    """The rows that all shuffles of a plan wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found, it = {}, store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        while it.hasNext():
            s = it.next()
            found[s.stageId()] = s.shuffleWriteRecords()
        return found

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def keyed(spark, rows):
    return stories.with_key(spark.createDataFrame(rows, ITEM)).select("id", "date", "key")


def copies(spark, n=400):
    """A day of reports that are alike: almost n * n / 2 pairs."""
    return keyed(spark, [(f"s/{k}", k, "2024-01-03", "today the city votes", "", "Ann,Bob", ["news", f"h{k % 2}"], "war", None, "", "", "", None) for k in range(n)])


def brute(rows):
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    rows, out = [(r.id, r.date, {p: set(r.key[p]) for p in WEIGHTS}) for r in rows.collect()], {}
    for (a, d, x), (b, e, y) in product(rows, rows):
        if d == e and any(x[p] & y[p] for p in WEIGHTS):
            out[a, b] = WEIGHTS["entities"] * like(x["entities"], y["entities"]) + WEIGHTS["titleTokens"] * like(x["titleTokens"], y["titleTokens"]) + WEIGHTS["tags"] * like(x["tags"], y["tags"])
    return out


def test_pairs_by_brute_force(spark, monkeypatch):
    """Every pair once, whatever the number of blocks and the work done at a time."""
    rows = batch(150, 4)
    rows += [(f"e/{k}", k, "2024-01-01", "", "", "", [] if k % 2 else ["news"], "war", None, None, None, None, None) for k in range(9)]  # empty sets
    df = keyed(spark, rows).dropDuplicates(["id"]).cache()
    every = brute(df)
    want = {k: v for k, v in every.items() if k[0] > k[1]}
    for blocks, work in ((1, 1 << 19), (3, 700), (16, 50)):
        monkeypatch.setattr(pairs, "BLOCKS", blocks)
        monkeypatch.setattr(pairs, "WORK", work)
        got = pairs.once(df, WEIGHTS).collect()
        assert len(got) == len(want) and {(r.item, r.story): r.score for r in got} == want
        left, right = df.where("id < 's/5'"), df.where("id > 's/3'")
        ids = lambda x: {r.id for r in x.collect()}
        a, b = ids(left), ids(right)
        got = stories.pair_scores(left, right).collect()
        assert {(r.item, r.story): r.score for r in got} == {k: v for k, v in every.items() if k[0] in a and k[1] in b} and got


def test_pairs_are_not_shuffled(spark):
    df = copies(spark)
    assert pairs.once(df, WEIGHTS).count() == 400 * 399 // 2
    assert shuffled(spark, pairs.once(df, WEIGHTS)) < 400 * (pairs.BLOCKS + 3)


def test_best_of_ties_without_a_shuffle_of_pairs(spark, monkeypatch):
    """The first story of those that round to the best score; few pairs leave a task."""
    df = keyed(spark, batch(150, 4)).dropDuplicates(["id"]).cache()
    want = {}
    for (a, b), score in brute(df).items():
        if a > b and (a not in want or (-round(score, 9), b) < want[a]):
            want[a] = (-round(score, 9), b)
    for blocks, work in ((1, 1 << 19), (4, 300)):
        monkeypatch.setattr(pairs, "BLOCKS", blocks)
        monkeypatch.setattr(pairs, "WORK", work)
        got = stories.best_candidate(pairs.best(df, WEIGHTS).withColumn("score", F.round("score", 9))).collect()
        assert {r.item: (-r.score, r.story) for r in got} == want and len(got) == len(want)
    monkeypatch.undo()
    assert shuffled(spark, stories.best_candidate(pairs.best(copies(spark), WEIGHTS))) < 400 * (2 * pairs.BLOCKS + 5)


def test_counts_of_scores_and_their_curve(spark):
    """Counted pairs give the curve of the pairs themselves."""
    df = keyed(spark, batch(150, 4)).dropDuplicates(["id"]).cache()
    host = {r.id: r.h for r in df.select("id", F.element_at("key.tags", 2).alias("h")).collect()}
    want = Counter((score, host[a] == host[b]) for (a, b), score in brute(df).items() if a > b)
    counted = pairs.counts(df, WEIGHTS, F.element_at("key.tags", 2)).cache()
    assert {(r.score, r.same): r.n for r in counted.collect()} == want
    each = spark.createDataFrame([k for k, n in want.items() for _ in range(n)], "score double, same boolean")
    assert sorted(calibrate.sweep(counted, 0.1).collect()) == sorted(calibrate.sweep(each, 0.1).collect())
    assert {r.same for r in pairs.counts(df, WEIGHTS).collect()} == {False}
    assert shuffled(spark, pairs.counts(copies(spark), WEIGHTS)) < 400 * (pairs.BLOCKS + 3)
