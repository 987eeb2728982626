"""Near-duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from newsloom.llm import neardup

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, DOC_ID string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted((d, len(shingles(t)), root(d), root(d) == d) for d, t in rows)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed):
    rng, rows = random.Random(seed), []
    for group in range(25):
        base = words(rng, rng.choice([6, 20, 60, 200, 900]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += ["", " \n\t", None, "one", "One", "two words", "a b c d", "a b c d e", "A b C d e", "ß Ünïcode   words here now"]
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("seed", [1])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "x") for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark, df.repartition(5)).collect())
    assert got == brute(rows)


def test_mixed_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Copies of one text with different edits: many share buckets, few link."""
    rng = random.Random(5)
    base, rows = words(rng, 60), []
    for k in range(160):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            copy[at] = f"y{k}_{at}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in neardup.near_duplicates(spark, df).collect()) == brute(rows)


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text, None, None), (1, "z y x w v u", None, None), (2, "z y x w v u", None, None), (None, text, None, None), (None, "alone in the whole wide world", None, None)], SCHEMA)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect()}
    assert got == {(1, 4, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 4, 1, True), (None, 2, None, True)}
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0
    kept = neardup.keep_one(spark, df)
    assert kept.columns == df.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 0, 1]


def test_null_ids_join_nothing_but_their_texts(spark):
    """Groups touched by rows without an id stay apart, whether these are exact or
    near copies; texts without any id link what is near to them."""
    rng = random.Random(8)
    five, nine, lone, bridge = (words(rng, 60) for _ in range(4))
    near = lambda t, k: " ".join([*t[: 20 * k], f"x{rng.randrange(10**6)}", *t[20 * k + 1 :]])
    ends = [" ".join([*(f"y{k}" for k in range(4)), *bridge[4:]]), " ".join([*bridge[:-4], *(f"z{k}" for k in range(4))])]
    big = (1 << 63) - 9
    rows = [(5, " ".join(five)), (6, near(five, 1)), (9, " ".join(nine)), (None, " ".join(five)), (None, " ".join(nine)), (None, near(five, 2)), (None, near(nine, 1)), (None, near(nine, 2)), (None, near(nine, 2)), (None, " ".join(lone)), (None, None)]
    rows += [(big, ends[0]), (big + 1, ends[1]), (None, " ".join(bridge)), (None, " ".join(bridge))]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = neardup.near_duplicates(spark, df.repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id} == {5: (5, True), 6: (5, False), 9: (9, True), big: (big, True), big + 1: (big, False)}
    assert sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0, 0, 5, 5, 9, 9, 9, 9, big, big]
    assert all(r.kept for r in got if r.doc_id is None)
    assert sorted(r.doc_id or 0 for r in neardup.keep_one(spark, df).collect()) == [0] * 10 + [5, 9, big]
    unnamed = spark.createDataFrame([(d, t, None, None) for d, t in rows if d is None], SCHEMA)
    none = neardup.near_duplicates(spark, unnamed).collect()
    assert {(r.component_id, r.kept) for r in none} == {(None, True)}


def test_rows_without_an_id_reach_no_strangers(spark):
    """A text that shares nothing with any other stays alone, and the stage agrees."""
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue white black brown")
    df = spark.createDataFrame([(5, a, None, None), (None, a, None, None), (None, b, None, None), (9, c, None, None)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect()), key=str)
    assert got == [(0, 5, True), (0, None, True), (5, 5, True), (9, 9, True)]
    assert sorted(r.text for r in neardup.keep_one(spark, df).collect()) == sorted([a, a, b, c])


def test_repeated_ids_keep_the_longest_text(spark):
    rows = [(1, "short one"), (1, None), (1, "the longest text of the three"), (2, "other words"), (3, None), (3, "")]
    for k in (1, 3, 6):
        df = spark.createDataFrame([(d, t, None, None) for d, t in rows[k:] + rows[:k]], SCHEMA).coalesce(1)
        kept = neardup.keep_one(spark, df)
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, rows[2][1]), (2, "other words"), (3, "")]


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(3)
    bounds = neardup.least_matches()
    for s, least in ((0.75, 0.999), (0.9, 1.0)):
        a = rng.integers(0, 256, (4000, neardup.HASHES)).astype(np.uint8)
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape).astype(np.uint8))
        assert len(neardup.likely(a, b, bounds)[0]) >= least * 4000
    c = rng.integers(0, 256, a.shape).astype(np.uint8)
    assert len(neardup.likely(a, c, bounds)[0]) == 0


def test_samples_keep_linked_pairs():
    """The last batch drops no pair whose sets reach the threshold."""
    rng = np.random.default_rng(4)
    ((_, least),) = neardup.least_matches(batches=[neardup.HASHES + neardup.SAMPLE])
    low = np.full((2, neardup.SAMPLE), neardup.NO_HASH)
    for n, both, want in ((40, 35, True), (40, 33, False), (512, 439, True), (512, 437, False), (4000, 3600, True), (4000, 2400, False)):
        x = np.unique(rng.integers(1, 1 << 63, 2 * n - both).astype(np.uint64))
        rng.shuffle(x)
        pair = [np.sort(x[:n]), np.sort(x[n - both :])]
        low[:] = neardup.NO_HASH
        for row, p in zip(low, pair):
            row[: min(n, neardup.SAMPLE)] = neardup.smallest(p)
        matches = np.array([round(neardup.HASHES * both / (2 * n - both))])
        got = neardup.sampled(low[:1], low[1:], np.array([n]), np.array([n]), matches, least)
        assert len(got) == want


def test_no_link_of_the_query_set_is_missed(spark):
    """Every row whose id is divisible by 100 against all rows, on full sets."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets, held = {}, {}
    for r in rows:
        sets[r.doc_id] = shingles(r.text)
        for s in sets[r.doc_id]:
            held.setdefault(s, []).append(r.doc_id)
    component = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, docs).collect()}
    links = found = 0
    for a in (r.doc_id for r in rows if r.doc_id % 100 == 0):
        common = {}
        for s in sets[a]:
            for b in held[s]:
                common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if b != a and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                links += 1
                found += component[a] == component[b]
    assert links > 20 and found == links
