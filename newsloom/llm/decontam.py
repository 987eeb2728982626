"""Benchmark decontamination with suffix arrays over the training text.

Every slice of documents is a shard with a suffix array over its words: the
positions whose next SEED words begin somewhere in the benchmark, sorted by the
words that follow (positions left out could not match even SEED words).  Every
benchmark window is found by binary search in each shard's array; neighbouring
hits on one diagonal join into the longest verbatim matches and their places.

The benchmark is the query set.  Tasks turn it into word hashes and deal these into
blocks of at most BLOCK_WORDS words (a longer item is cut, with WINDOW - 1 words of
overlap), a written table.  One block at a time is loaded, broadcast (a proven size
bound) and released.  With several blocks the documents are written once, with a
number for each row; each block reads their texts and writes the hits alone, which meet
by that number at the end.

Edge cases: null or empty texts have no words and are never contaminated; an
item without words has no window; an item of fewer than WINDOW words is one
window; a null item_id counts as the id ``null``; item ids are distinct strings,
so repeated benchmark rows count once; repeated documents rows stay repeated.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, bitmap, may_be_in, numbered, pick, place, record
from ._text import ALNUM_WORDS, Words, slices

WINDOW = 13
SEED = 3
BLOCK_WORDS = 1_000_000
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"


@dataclass
class Block:
    """Distinct benchmark windows: sizes, sorted search keys and, by CSR, the
    (item, place) pairs they come from; seeds by number of words."""

    ids: list[str]
    size: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seeds: dict[int, np.ndarray]


def suffix_keys(words: Words, at: np.ndarray, depth: int) -> np.ndarray:
    """The next `depth` word hashes of each position as one sortable byte
    string; what lies beyond the text is zero."""
    left = words.left()[at]
    out = np.zeros((len(at), depth), ">u8")
    for k in range(depth):
        ok = left > k
        out[ok, k] = words.hash[at[ok] + k]
    return np.ascontiguousarray(out).view(f"S{8 * depth}").ravel()


def make_block(ids: list[str], words: Words, window: int = WINDOW) -> Block:
    """The windows of items (or parts of items) given by their words."""
    counts = words.counts[words.doc]
    left = words.left()
    start = np.flatnonzero((left >= window) | ((counts < window) & (left == counts)))
    size = np.minimum(counts[start], window)
    keys = suffix_keys(words, start, window)
    for k in np.unique(size[size < window]):  # a short item's window ends where its words end
        cut = size == k
        keys[cut] = suffix_keys(words, start[cut], int(k)).astype(keys.dtype)
    order = np.lexsort((size, keys)) if len(keys) else np.zeros(0, np.int64)
    start, size, keys = start[order], size[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (size[1:] != size[:-1])
    first = np.append(np.flatnonzero(new), len(keys))
    seeds = {}
    for k in range(1, SEED + 1):
        those = start[(size == k) if k < SEED else (size >= k)]
        if len(those):
            seeds[k] = np.unique(words.chain(k)[those])
    doc = words.doc[start]
    return Block(ids, size[new], keys[new], first, doc, start - words.first[doc], seeds)


def find(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word position) of every occurrence in a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, seeded = words.left(), np.zeros(len(words.starts), bool)
    for k, wanted in block.seeds.items():
        chain = words.chain(k)
        at = np.minimum(np.searchsorted(wanted, chain), len(wanted) - 1)
        seeded |= (wanted[at] == chain) & (left >= k)
    place = np.flatnonzero(seeded)
    if not len(place) or not len(block.keys):
        return none
    depth = block.keys.dtype.itemsize // 8
    keys = suffix_keys(words, place, depth)
    order = np.argsort(keys, kind="stable")
    place, keys = place[order], keys[order]  # the shard's suffix array
    lo = np.searchsorted(keys, block.keys, "left")
    last = block.keys.copy()
    for k in np.unique(block.size[block.size < depth]):
        cut = np.flatnonzero(block.size == k)
        raw = np.frombuffer(last[cut].tobytes(), np.uint8).reshape(len(cut), -1).copy()
        raw[:, 8 * k :] = 0xFF
        last[cut] = raw.view(last.dtype).ravel()
    hi = np.searchsorted(keys, last, "right")
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return none
    window = np.repeat(hit, n[hit])
    at = np.arange(len(window)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(lo[hit], n[hit])
    return window, place[at]


def longest(block: Block, words: Words, window: np.ndarray, place: np.ndarray, texts: int) -> tuple[np.ndarray, list, np.ndarray]:
    """The longest verbatim match of each text: words, item id, word number."""
    n = block.first[window + 1] - block.first[window]
    owner = np.repeat(np.arange(len(window)), n)
    row = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first[window], n)
    item, at, pos = block.item[row], block.place[row], place[owner]
    order = np.lexsort((pos, pos - at, item))
    item, at, pos, size = item[order], at[order], pos[order], block.size[window[owner]][order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] != pos[:-1] + 1) | (words.doc[pos[1:]] != words.doc[pos[:-1]])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(item))) - 1 + size[start]
    doc = words.doc[pos[start]]
    best = np.lexsort((pos[start], item[start], -length, doc))
    keep = best[np.unique(doc[best], return_index=True)[1]]
    most, where, name = np.zeros(texts, np.int64), np.full(texts, -1), [None] * texts
    most[doc[keep]] = length[keep]
    where[doc[keep]] = (pos[start] - words.first[doc])[keep]
    for d, i in zip(doc[keep], item[start][keep]):
        name[d] = block.ids[i]
    return most, name, where


def _dealt(benchmark: DataFrame) -> DataFrame:
    """(block, item_id, words): word hashes of items, or of overlapping parts of
    long ones; each task deals its items into blocks of at most BLOCK_WORDS words."""
    most, step = BLOCK_WORDS, BLOCK_WORDS - WINDOW + 1
    schema = [("block", pa.string()), ("item_id", pa.string()), ("words", pa.binary())]

    def run(batches):
        task, k, size = uuid.uuid4().hex, 0, 0
        for batch in batches:
            out = []
            for i, j, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, ALNUM_WORDS, lower=True)
                for d in range(j - i):
                    said = words.hash[words.first[d] : words.first[d + 1]]
                    for at in range(0, max(len(said) - WINDOW + 1, min(len(said), 1)), step):
                        part = said[at : at + most]
                        if size + len(part) > most:
                            k, size = k + 1, 0
                        size += len(part)
                        out.append((f"{task}-{k}", batch.column(0)[i + d].as_py(), part.tobytes()))
            if out:
                yield record(schema, *map(list, zip(*out)))

    rows = pick(benchmark, "item_id", "text").where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    # a word has at least one byte and, but for the last, one byte behind it
    bound = rows.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0
    return rows.coalesce(math.ceil(bound / most) or 1).mapInArrow(run, "block string, item_id string, words binary")


def _blocks(scratch: Scratch, benchmark: DataFrame) -> Iterator[tuple[Block, bool]]:
    """(block, whether it is the last), loaded one by one."""
    dealt = scratch.keep(_dealt(benchmark), "benchmark")
    names = [r.block for r in dealt.select("block").distinct().orderBy("block").collect()]  # one for each block, so for each pass
    for k, name in enumerate(names):
        rows = dealt.where(F.col("block") == name).select("item_id", "words").orderBy("item_id", "words").toArrow()
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
        words = Words.of_hashes(np.concatenate(parts), np.array(list(map(len, parts))))
        yield make_block(rows.column("item_id").to_pylist(), words), k == len(names) - 1
    if not names:
        yield make_block([], Words.of_hashes(np.zeros(0, np.uint64), np.zeros(0, np.int64))), True
    scratch.drop(dealt)


def _search(batch_texts: pa.Array, block: Block):
    """For each text: (n_words, hit word numbers, item ids, longest, item, at)."""
    for i, j, data, offsets in slices(batch_texts):
        words, n = Words(data, offsets, ALNUM_WORDS, lower=True), j - i
        window, place = find(block, words)
        if not len(window):
            yield from ((int(c), None, (), 0, None, -1) for c in words.counts)
            continue
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + block.size[window], -1)
        covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        cuts = np.searchsorted(covered, words.first)
        pairs = np.unique(words.doc[place].astype(np.int64) * len(block.size) + window)
        most, name, where = longest(block, words, window, place, n)
        at = np.searchsorted(pairs // len(block.size), np.arange(n + 1))
        for d in range(n):
            found = pairs[at[d] : at[d + 1]] % len(block.size)
            ids = {block.ids[k] for w in found for k in block.item[block.first[w] : block.first[w + 1]]}
            yield int(words.counts[d]), covered[cuts[d] : cuts[d + 1]] - words.first[d], ids, int(most[d]), name[d], int(where[d])


_FOUND = [("row", pa.int64()), ("n", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("most", pa.int64()), ("name", pa.string()), ("at", pa.int64())]
_FINAL = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())]


def _dirty(n: int, hits: int) -> bool:
    return hits > 0 and 20 * hits >= n


def _final(n: int, hits: int, ids: set | list, most: int, name: str | None, at: int) -> tuple:
    ids = sorted(ids)
    return n, hits, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), _dirty(n, hits), most, name, at


def _one_pass(rows: DataFrame, shared) -> DataFrame:
    """The verdicts of rows (doc_id, text) where one block holds the whole benchmark."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [_final(n, 0 if hits is None else len(hits), *rest) for n, hits, *rest in _search(batch.column(1), shared.value)]
                yield record(_FINAL, batch.column(0), *map(list, zip(*found)))

    return rows.mapInArrow(run, _OUT)


def _hits(rows: DataFrame, shared) -> DataFrame:
    """What one block finds in rows (row, text): only rows with hits come out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [(row.as_py(), n, hits.tobytes(), sorted(ids), most, name, at) for row, (n, hits, ids, most, name, at) in zip(batch.column(0), _search(batch.column(1), shared.value)) if hits is not None]
                if found:
                    yield record(_FOUND, *map(list, zip(*found)))

    return rows.mapInArrow(run, "row long, n long, hits binary, items array<string>, most long, name string, at long")


def _merged(found: DataFrame) -> DataFrame:
    """One row for each document with hits, whichever blocks they are of."""
    parts = found.groupBy("row").agg(F.collect_list(F.struct("n", "hits", "items", "most", "name", "at")).alias("parts"))  # one for each block at most
    schema = [("row", pa.int64()), *_FINAL[1:]]

    def run(batches):
        for batch in batches:
            out = []
            for row, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = np.unique(np.concatenate([np.frombuffer(p["hits"], np.int64) for p in parts]))
                best = min(parts, key=lambda p: (-p["most"], p["name"] or "", p["at"]))
                out.append((row, *_final(parts[0]["n"], len(hits), {i for p in parts for i in p["items"]}, best["most"], best["name"], best["at"])))
            if out:
                yield record(schema, *map(list, zip(*out)))

    return parts.mapInArrow(run, _OUT.replace("doc_id", "row", 1))


def _by_blocks(scratch: Scratch, rows: DataFrame, text: str, block: Block, blocks) -> tuple[DataFrame, DataFrame]:
    """(rows with a number, what all blocks find by that number).  The rows are written
    once, whatever the number of blocks; each block reads their texts and writes hits."""
    kept, found, last = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows"), [], False
    texts = kept.select(F.col("_row").alias("row"), F.col(text).alias("text"))
    while True:
        shared = scratch.spark.sparkContext.broadcast(block)
        found.append(scratch.keep(_hits(texts, shared), "hits"))
        shared.destroy()
        if last:
            break
        block, last = next(blocks)
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    merged = scratch.keep(_merged(every), "merged")
    scratch.drop(*found)
    return kept, merged


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, under: Scratch | None = None) -> DataFrame:
    """One row for each row of docs; no shuffle of texts."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(spark, "decontam", under)
    blocks = _blocks(scratch, benchmark)
    block, last = next(blocks)
    if last:
        next(blocks, None)  # lets go of the written benchmark
        return _one_pass(rows, spark.sparkContext.broadcast(block))
    kept, merged = _by_blocks(scratch, rows, "text", block, blocks)
    next(blocks, None)
    hit = may_be_in(bitmap(merged, F.xxhash64("row")), F.xxhash64("_row"))
    known = kept.where(hit).select("doc_id", F.col("_row").alias("row")).join(merged, "row").drop("row")
    none = spark.sparkContext.broadcast(make_block([], Words.of_hashes(np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    # rows whose number has its bit by chance have no hits either
    rest = kept.where(~hit).select("doc_id", "text").unionByName(kept.where(hit).join(merged, kept["_row"] == merged["row"], "left_anti").select("doc_id", "text"))
    return known.unionByName(_one_pass(rest, none))


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, under: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; only rows that may have
    to go are shuffled, and none where one block holds the benchmark."""
    names, at = docs.columns, place(docs, "text")
    docs = numbered(docs)
    scratch = Scratch(spark, "decontam", under)
    blocks = _blocks(scratch, benchmark)
    block, last = next(blocks)
    if not last:
        kept, merged = _by_blocks(scratch, docs, docs.columns[at], block, blocks)
        next(blocks, None)
        dirty = scratch.keep(merged.where("contaminated").select("row"), "dirty")
        hit = may_be_in(bitmap(dirty, F.xxhash64("row")), F.xxhash64("_row"))
        rest = kept.where(hit).join(dirty, kept["_row"] == dirty["row"], "left_anti")
        return kept.where(~hit).unionByName(rest).drop("_row").toDF(*names)
    next(blocks, None)
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                clean = [hits is None or not _dirty(n, len(hits)) for n, hits, *_ in _search(batch.column(at), shared.value)]
                yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
