"""SimHash components, ranked search and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from newsloom.llm import lexical, periodic, queries, simhash
from newsloom.llm._spark import Scratch

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, DOC_ID string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)


# SimHash


def simhash_of(text):
    words = WORD.findall(lower(text))
    said = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """The smallest place that each fingerprint reaches."""
    values = np.array(prints, np.uint64)
    out = np.arange(len(values))
    while True:
        new = np.array([out[np.bitwise_count(values ^ v) <= 4].min() for v in values])
        new = new[new]
        if (new == out).all():
            return out
        out = new


def test_simhash_same_as_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        base = [f"W{rng.randrange(900)}" for _ in range(rng.choice([1, 3, 4, 5, 40, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = f"é{rng.randrange(10**6)}"
            rows.append("  ".join(copy))
    rows += ["", None, " \n", "One two", "one TWO", "a " * 70_000, "b c " * 400_000]
    rows = list(enumerate(rows, 5))
    rng.shuffle(rows)
    rows.sort()
    prints = [simhash_of(t) for _, t in rows]
    want = [(d, f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, components_of(prints))]
    got = simhash.near_duplicates(spark, frame(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("cell", [1 << 15, 40])
def test_range_join_links_what_brute_force_links(spark, monkeypatch, cell):
    """Dense, sparse and edge fingerprints; small cells are split and dealt."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(7)
    far = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    parts = [far, np.zeros(1, np.uint64), ~np.zeros(1, np.uint64)]
    for center in far[:40]:
        flips = [np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, False)]) for n in rng.integers(1, 7, 8)]
        parts.append(center ^ np.array(flips, np.uint64))
    parts.append(far[0] ^ rng.integers(0, 1 << 8, 90).astype(np.uint64))  # one dense cell
    values = np.unique(np.concatenate(parts))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    found = simhash.links(Scratch(spark, "test"), df).collect()
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert (int(r.a) ^ int(r.b)) & (1 << 64) - 1 and bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
        a, b = sorted((root(at[r.a]), root(at[r.b])))
        parent[b] = a
    assert [root(k) for k in range(len(values))] == components_of(values).tolist()


def test_popcounts_bound_the_distance_from_below():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(2))
    apart = sum(np.abs(((simhash.embed(a) >> np.uint64(2 * k)) & np.uint64(3)).astype(int) - ((simhash.embed(b) >> np.uint64(2 * k)) & np.uint64(3)).astype(int)) for k in range(32))
    assert (apart <= np.bitwise_count(a ^ b)).all()


def test_simhash_null_and_repeated_ids(spark):
    rows = [(4, "a b c d e"), (None, "A b c d e"), (None, "not like any other text"), (4, None), (9, ""), (None, None), (9, "")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(spark, frame(spark, rows)).collect())
    assert got == sorted([("4", "4"), ("None", "4"), ("None", "None"), ("4", "4"), ("9", "4"), ("9", "4"), ("None", "4")])
    assert simhash.near_duplicates(spark, frame(spark, rows).limit(0)).count() == 0


# search


def searched(docs, items, k=20):
    terms = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if t in c)
            if score:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [256, 2])
def test_search_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "ITEMS", block)
    monkeypatch.setattr(lexical, "ROWS", 64)
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["The", "of", f"t{rng.randrange(40)}", f"r{rng.randrange(3000)}", "ÄÖ", "x-y"]) for _ in range(n))
    docs = [(k, say(rng.choice([1, 5, 30, 200]))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(60)]  # copies tie
    docs += [(None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1]), (2000, None), (2001, ""), (2002, "--"), (2003, "the " * 300_000)]
    items = [(k, say(rng.choice([1, 4, 50]))) for k in range(9)] + [(20, docs[7][1]), (20, docs[3][1]), (None, "of the"), (21, None), (22, "nowhere-said"), (23, "the the the of")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, ITEM_ID int")
    got = lexical.search(spark, frame(spark, docs).repartition(5), asked)
    assert sorted(map(tuple, got.collect()), key=repr) == searched(docs, items)
    assert lexical.search(spark, frame(spark, docs).limit(0), asked).count() == 0
    assert lexical.search(spark, frame(spark, docs), asked.limit(0)).count() == 0


def test_byte_impacts_bound_the_impacts():
    tf = np.arange(1, 5000)
    exact = lexical.impacts(tf, 75)
    steps = -(-exact // lexical.STEP)
    assert steps.max() <= 255 and (steps * lexical.STEP >= exact).all() and ((steps - 1) * lexical.STEP < exact).all()


# runs


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return list(words)
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_of(words):
    """All stretches by period, least periods only."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - i >= max(24, 3 * p):
                best.setdefault((i, e + p - i), p)
            i = e
    return sorted((s, n, p) for (s, n), p in best.items())


def reported(doc_id, words):
    found = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    lines, kept = "".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_runs_same_as_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.choice([1, 2, 5])):
            words += [rng.choice("abc") for _ in range(rng.choice([0, 3, 20]))]
            words += ([rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 7, 12, 20]))] * 30)[: rng.choice([23, 24, 25, 60, 61, 90])]
        rows.append((k, rng.choice([" ", "\n\t"]).join(words)))
    rows += [(900, None), (901, ""), (902, "x"), (903, "y " * 23), (904, "y " * 24), (905, "ab ab " * 3000), (None, "z " * 40), (904, "y " * 24)]
    want = sorted((reported(d, WORD.findall(t or "")) for d, t in rows), key=repr)
    df = frame(spark, rows).repartition(3)
    assert sorted(map(tuple, periodic.report(df).collect()), key=repr) == want
    spans = sorted(map(tuple, periodic.spans(df).where("doc_id < 900").collect()))
    assert spans == sorted((d, *r) for d, t in rows if d is not None and d < 900 for r in runs_of(WORD.findall(t)))
    out = {r[0]: r[1] for r in periodic.collapse(df).where("lang = 'x'").collect() if r[0] in (900, 902, 904, 905)}
    assert out == {900: None, 902: "x", 904: "y", 905: "ab"} and periodic.collapse(df).columns == df.columns
    assert periodic.report(df.limit(0)).count() == 0


def test_runs_of_the_documents_same_as_brute_force(spark):
    """All documents of the smallest table with up to 800 words, planted as the query does."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    words = {r.doc_id: WORD.findall(r.text or "") for r in docs}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == len(docs)
    some = [d for d in words if len(words[d]) <= 800]
    assert len(some) > 150 and sum(got[d][1] for d in some) > 5
    for d in some:
        assert got[d] == reported(d, planted(d, words[d]))


def test_runs_in_one_very_long_text(spark):
    text = " ".join(["w"] * 300_000 + [f"u{k}" for k in range(100)] + [f"v{k}" for k in range(5000)] * 4)
    (got,) = periodic.report(frame(spark, [(1, text)])).collect()
    assert (got.n_runs, got.start, got.length, got.period) == (2, 0, 300_000, 1)
