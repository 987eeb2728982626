"""Texts longer than a slice (1 MB), beside short ones, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from newsloom.llm import decontam, langid, neardup, packing, pii, quality, toxicity
from newsloom.llm._text import SLICE_BYTES

from .test_neardup import shingles
from .test_text_operators import DATA, VOCABULARY, brute_hits, plain_spans, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    """Two of some 1.5 MB that differ in a word, one of a single long line of repeats,
    and short ones."""
    rng = random.Random(12)
    said = [f"w{rng.randrange(20_000)}" for _ in range(230_000)]
    for k in range(0, len(said), 9000):
        said[k] = rng.choice(["a.b@mail.example", "+1 (555) 010-0099", "10.1.2.3", "4111 1111 1111 1111", "C#\nC#\nD\nC#"])
    near = list(said)
    near[777] = "other"
    out = {1: " ".join(said), 2: " ".join(near), 3: "again and again " * 80_000, 4: "short text of a few words only", 5: "short text of a few words", 6: None}
    assert all(len(out[k].encode()) > SLICE_BYTES for k in (1, 2, 3))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, list(texts.items())).coalesce(1)


def test_pii(docs, texts):
    for r in pii.detect(docs, pii.Weights()).collect():
        assert r.base_sha256 == hashlib.sha256(pii.joined(plain_spans(texts[r.doc_id] or "")).encode()).hexdigest()


def test_quality(docs, texts):
    for r in quality.judge(docs).collect():
        text = texts[r.doc_id] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_scores_and_languages_do_not_depend_on_the_slices(spark, docs, texts):
    """Each text by itself gets what it gets among the others."""
    known, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, learned = toxicity.train(known, labels), langid.train(known)
    together = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}, {r.doc_id: (r.lang_pred, r.margin_bytes) for r in langid.identify(docs, learned).collect()}
    for k in (1, 3, 4):
        alone = table(spark, [(k, texts[k])])
        assert toxicity.score_documents(alone, model).first().score == together[0][k]
        (row,) = langid.identify(alone, learned).collect()
        assert (row.lang_pred, row.margin_bytes) == together[1][k]


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(WORD.findall(texts[1])[200_000:200_040])), (2, "again and"), (3, "nothing of this is said anywhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.decontaminate(spark, docs, bench).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(texts[r.doc_id], items)


def test_longest_matches(spark):
    """The longest verbatim match of each document, its item and its place, by brute force."""
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcde") for _ in range(40))) for k in range(4)]
    rows = []
    for k in range(60):
        words = [rng.choice("abcde") for _ in range(30)]
        item, start, n = rng.choice(items), rng.randrange(20), rng.choice([5, 12, 13, 14, 20])
        words[10:10] = item[1].split()[start : start + n]
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.decontaminate(spark, table(spark, rows), bench).collect():
        words = rows[r.doc_id][1].split()
        best = 0
        for _, text in items:
            said = text.split()
            for i in range(len(words)):
                for j in range(len(said)):
                    n = 0
                    while i + n < len(words) and j + n < len(said) and words[i + n] == said[j + n]:
                        n += 1
                    best = max(best, n)
        if best < 13:
            assert not r.longest_match
            continue
        assert r.longest_match == best
        said, at = dict((str(i), t) for i, t in items)[r.longest_item], r.longest_at
        assert " ".join(words[at : at + best]) in said


def test_near_duplicates(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, docs).collect()}
    assert got == {k: (len(shingles(t)), {2: 1}.get(k, k)) for k, t in texts.items()}


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(spark, docs, VOCABULARY).toPandas()
    for k, text in texts.items():
        assert got.length[got.doc_id == k].sum() == 1 + len(coder.encode(text or "", add_special_tokens=False).ids)


def test_rows_that_repeat_an_id_are_packed_once_each(spark):
    """Thousands of equal rows without an id: a place for each."""
    docs = table(spark, [(None, "the same few words")] * 3000 + [(7, "x")] * 500).repartition(6)
    got = packing.pack(spark, docs, VOCABULARY).toPandas()
    assert len(got) == 3500
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *part.length.cumsum()[:-1]]
