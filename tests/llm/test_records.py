"""WARC and chat round trips, the SQL of both, and the pipeline."""

import hashlib
import json

import pytest

from newsloom.llm import chat, decontam, neardup, packing, pii, queries, toxicity, warc
from newsloom.llm._spark import Scratch

from ..conftest import DATA

PAGE = "page_id long, url string, html string, HTML string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name], f"{DATA}/sf0.01")


def expected(pages):
    out, first = [], {}
    for p, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        revisit = len(raw) >= 100 and digest in first
        out.append((p, len(raw), digest, "revisit" if revisit else "response", first.get(digest) if revisit else None))
        if len(raw) >= 100:
            first.setdefault(digest, p)
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long, dull = "é<p>\r\n" * 40, "x" * 100
    htmls = [long, fake, long, None, "", fake * 40, "short", "short", "WARC/1.1\r\n", fake + "WARC/1.1\r\n" + fake, "a" * 99, "a" * 99, dull, dull, "\r\n\r\n", "日本語" * 50, fake * 40, "WARC/1.1\r\nContent-Length: 999999\r\n\r\n" + long]
    pages = [*enumerate(htmls), (0, long), (0, long), (None, "a page without id " * 9), (None, "a page without id " * 9)]
    df = spark.createDataFrame([(p, None if k % 3 == 0 else f"http://h/{k}\r\nx", h, "y") for k, (p, h) in enumerate(pages)], PAGE)
    got = sorted((tuple(r) for r in warc.round_trip(spark, df.repartition(4)).collect()), key=repr)
    assert got == expected(pages)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_over_many_splits(spark):
    """Archives cut into small splits; magic within payloads at any place."""
    fake = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(k, ("z" * (k % 50) + fake) * (k % 7) + str(k)) for k in range(300)]
    scratch = Scratch(spark, "test")
    path = scratch.path("archive")
    warc.write(warc.records(spark.createDataFrame([(p, "u", h, None) for p, h in pages], PAGE).coalesce(1), scratch), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = warc.read(spark, path, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in rows), key=repr) == expected(pages)


def test_chat_escapes_round_trip():
    for text in ("</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n", "a\\b<|<|im_start|>user\n", "<<SYS>>\\<</SYS>>", "", "\\\n", "[INST\\]"):
        for role in ("user", "as\nsist\\ant", "<|im_end|>\n", ""):
            made = chat.segment(role, text) * 2
            assert [(r, t) for r, t, *_ in chat.read_back(made)] == [(role, text)] * 2
            body = made.replace(chat.START, "").replace(chat.END, "")
            assert not any(c in body for c in chat.CONTROLS)


def test_chat_layouts(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "meta": {"x": [1]}},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        {"conv_id": 3, "instruction": "do", "input": "this", "output": "done"},
        {"conv_id": 4, "prompt": "p", "completion": "c", "system": "s"},
        {"conv_id": 5, "question": "why", "answer": "so"},
        {"conv_id": 6, "unknown": 1},
        {"conv_id": "abc", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": [{"type": "text", "text": "c"}]}]},
        {"conv_id": 8, "turns": [{"speaker": "user", "utterance": "u"}, {"speaker": "bot", "utterance": "v"}]},
        {"conv_id": 9, "turn": "second", "role": "user", "text": "odd turn"},
        {"conv_id": 9, "turn": "2", "role": "assistant", "text": "fine"},
        {"conv_id": 10, "messages": "no list", "prompt": "p", "completion": "c"},
        {"conv_id": 11, "question": "q", "answer": "a", "prompt": "p", "response": "r"},
    ]
    rows = [json.dumps(r) for r in records] + [None, "not json", "[1]"]
    got = chat.canonical_turns(spark.createDataFrame([(r, 1) for r in rows], "record string, Record int"))
    said = {}
    for r in got.collect():
        said.setdefault(r.conv_id, []).append((r.turn if r.turn is not None else -1, r.role, r.text))
    assert {k: [x[1:] for x in sorted(v)] for k, v in said.items()} == {
        "1": [("user", "hi"), ("assistant", "yo")], "2": [("user", "q"), ("assistant", "")], "3": [("user", "do\n\nthis"), ("assistant", "done")],
        "4": [("system", "s"), ("user", "p"), ("assistant", "c")], "5": [("user", "why"), ("assistant", "so")],
        "abc": [("user", "ab"), ("assistant", "c")], "8": [("user", "u"), ("assistant", "v")], "9": [("user", "odd turn"), ("assistant", "fine")],
        "10": [("user", "p"), ("assistant", "c")], "11": [("user", "p"), ("assistant", "r")],
    }
    assert {r.conv_id: r.n_layouts for r in got.collect()}["11"] == 2
    seen = chat.survey(spark.createDataFrame([(r, 1) for r in rows], "record string, Record int")).collect()
    assert sum(r.n for r in seen) == len(rows) and sum(r.n for r in seen if r.layout is None) == 4
    assert sum(r.n for r in seen if r.fingerprint is None) == 3
    out = {r.conv_id: r for r in chat.digests(chat.format_turns(got)).collect()}
    assert out["3"].loss_chars == 4 and out["3"].loss_sha256 == hashlib.sha256(b"done").hexdigest()
    assert chat.digests(chat.format_turns(got.limit(0))).count() == 0


def test_stages_keep_odd_rows(spark):
    """Null ids, null and repeated rows, clashing names, an empty table."""
    rows = [(1, "Mail a.b@x.com or call", "y", 22), (None, None, "y", None), (2, "", "z", 0), (2, "", "z", 0), (3, "plain words", None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "plain words")], "item_id long, text string")
    stages = [
        (lambda d: toxicity.keep_clean(d, toxicity.train(d, labels)), 5), (lambda d: neardup.keep_one(spark, d), 4),
        (lambda d: decontam.keep_clean(spark, d, bench), 4), (lambda d: pii.redact_documents(d, pii.train(d)), 5),
    ]
    for stage, n in stages:
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() == n and stage(docs.limit(0)).count() == 0
    clean = {tuple(r) for r in stages[3][0](docs).collect()}
    assert (1, "Mail <EMAIL> or call", "y", 20) in clean and (None, None, "y", None) in clean


def test_pipeline(spark):
    """Each stage on what the one before kept; the last packs all that is left."""
    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).toPandas()
    left = docs.toPandas()[lambda d: d.doc_id.isin(scored.doc_id[scored.predicted == 0])]
    left = spark.createDataFrame(left, docs.schema)
    kept = {r.doc_id for r in neardup.near_duplicates(spark, left).where("kept").collect()}
    left = left.where(left.doc_id.isin(kept))
    dirty = {r.doc_id for r in decontam.decontaminate(spark, left, bench).where("contaminated").collect()}
    left = left.where(~left.doc_id.isin(dirty))
    clean = pii.redact_documents(left, pii.train(left))
    assert clean.columns == docs.columns
    assert pii.detect(clean, pii.train(left)).where("spans <> ''").count() == 0
    want = packing.pieces(clean, packing_path()).toPandas()
    got = corpus_pipeline.run(spark, sf).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[names].values)) == sorted(map(tuple, want[names].values))
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY and got.doc_id.nunique() > 100


def test_pipelines_leave_other_tables_alone(spark):
    """Results written before and beside a pipeline can still be read after it; of
    a pipeline only its last table is left."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    groups, archive, packed = neardup.near_duplicates(spark, docs), warc.round_trip(spark, pages), packing.pack(spark, docs, packing_path())
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: corpus_pipeline.run(spark, sf), range(2))
    assert sorted(map(tuple, one.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, two.select("doc_id", "piece", "length").collect()))
    assert groups.count() == docs.count() and archive.count() == pages.count() and packed.select("doc_id").distinct().count() == docs.count()
    fresh = [os.path.join(shared, d) for d in set(os.listdir(shared)) - before]
    assert len(fresh) == 2 and all([d.startswith("packing") for d in os.listdir(f)] == [True] for f in fresh)


def packing_path():
    from public_tokenizers import path

    return path("word_bpe_49k.json")
