"""Ranked lexical search over a two-level quantised index.

Index: one row for each document, its distinct term hashes in order with, at the
first level, the impact of each in one byte, rounded up to a multiple of STEP, and at
the second level the exact number of occurrences and of words.  Parquet columns
keep the levels apart: a scan reads the level it asks for.

Search: the items are the query set, dealt by tasks into blocks of at most ITEMS items
and WORDS words; one block at a time is broadcast, with its postings by term.
Bytes give each (item, document) an upper bound of its score, and bytes less one a
lower bound.  A scan of the first level finds each item's kth lower bound (k values
for each item and task leave a task); a second one rescores in whole numbers every
document whose upper bound reaches it.  All matches of an item with fewer than k
positive lower bounds are rescored.  Documents never leave the task that reads them.

Scores: a term's weight w is floor(1000 ln((2N + 2) / (2df + 1))), its impact
(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L; a score sums w * impact
over the item's terms with repeats.

Edge cases: null or empty texts and texts without terms match nothing and are not
counted in N; an item without terms has no rows; each row of the items is an item of
its own, whether or not its item_id repeats or is null; each row of the documents
is ranked, null ids after all others of equal score; equal rows keep one place each.
A doc_id that is no number is null.  Extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, over_batches, pick, record
from ._text import ALNUM_WORDS, Words, slices

TOP = 20
STEP = 3922  # of impacts, which stay below 10^6: 255 steps
ITEMS = 256  # of a block
WORDS = 1 << 20  # of a block, unless a single item has more
ROWS = 1024  # documents that are scored at a time
PAIRS = 4096  # (item, document) that are rescored at a time
SALTS = 64  # groups that meet before an item's rows do


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct term hashes of each text and their occurrences."""
    for _, _, data, offsets in slices(column):
        words = Words(data, offsets, ALNUM_WORDS, lower=True)
        for d in range(len(offsets) - 1):
            yield np.unique(words.hash[words.first[d] : words.first[d + 1]], return_counts=True)


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Index:
    """rows: doc_id, n (terms with repeats), terms (uint64), impacts (uint8), tfs (uint32)."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(scratch: Scratch, docs: DataFrame) -> Index:
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Words(data, offsets, ALNUM_WORDS, lower=True, hashed=False).counts for _, _, data, offsets in slices(batch.column(0))]
        counts = np.concatenate(counts)
        return record([("docs", pa.int64()), ("terms", pa.int64())], [int((counts > 0).sum())], [int(counts.sum())])

    total = over_batches(docs.select("text"), sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(x or 0) for x in total)
    schema = [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, rows = [], []
        for k, (terms, tf) in enumerate(_terms(batch.column(1))):
            if len(terms):
                n = int(tf.sum())
                steps = -(-impacts(tf, 75 + (25 * n * n_docs) // n_terms) // STEP)
                keep.append(k)
                rows.append((n, terms.tobytes(), steps.astype(np.uint8).tobytes(), tf.astype(np.uint32).tobytes()))
        return record(schema, batch.column(0).take(pa.array(keep, pa.int64())), *(map(list, zip(*rows)) if rows else [[]] * 4))

    rows = over_batches(docs, run, "doc_id long, n long, terms binary, impacts binary, tfs binary")
    return Index(scratch.keep(rows, "index"), n_docs, n_terms)


def _blocks(scratch: Scratch, items: DataFrame) -> DataFrame:
    """block, item (its place in the block), item_id, terms, tfs; each task deals its
    items into blocks."""
    items = pick(items, "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = max(1, math.ceil(items.count() / ITEMS))

    def run(batches):
        from pyspark import TaskContext

        part, block, item, words = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            rows = []
            for terms, tf in _terms(batch.column(1)):
                if item and (item == ITEMS or words + tf.sum() > WORDS):
                    block, item, words = block + 1, 0, 0
                rows.append((part << 32 | block, item, terms.tobytes(), tf.astype(np.int64).tobytes()))
                item, words = item + 1, words + int(tf.sum())
            if rows:
                b, i, t, f = map(list, zip(*rows))
                names = ["block", "item", "item_id", "terms", "tfs"]
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(i, pa.int32()), batch.column(0), pa.array(t, pa.binary()), pa.array(f, pa.binary())], names=names)

    dealt = items.repartition(wanted) if wanted > 1 else items.coalesce(1)
    return scratch.keep(dealt.mapInArrow(run, f"block long, item int, item_id {kind}, terms binary, tfs binary"), "items")


@dataclass
class Queries:
    """The postings of a block: term t is in items item[first[t] : first[t + 1]], with
    weight times occurrences in weight."""

    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    n_items: int

    @classmethod
    def of(cls, rows: list) -> "Queries":
        item = np.repeat([r.item for r in rows], [len(r.terms) // 8 for r in rows]) if rows else np.zeros(0, np.int64)
        terms = np.frombuffer(b"".join(bytes(r.terms) for r in rows), np.uint64)
        tf = np.frombuffer(b"".join(bytes(r.tfs) for r in rows), np.int64)
        order = np.lexsort((item, terms))
        distinct, first = np.unique(terms[order], return_index=True)
        return cls(distinct, np.append(first, len(terms)), item[order], tf[order], max((r.item for r in rows), default=-1) + 1)


def _hits(queries: Queries, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term of the block, place in the documents' terms) of the documents'
    terms that the block asks for, by document."""
    sizes = np.array([len(t.as_buffer()) // 8 for t in terms], np.int64)
    found = np.frombuffer(b"".join(t.as_buffer() for t in terms), np.uint64)
    at = np.minimum(np.searchsorted(queries.terms, found), len(queries.terms) - 1)
    place = np.flatnonzero(queries.terms[at] == found)
    return np.repeat(np.arange(len(sizes)), sizes)[place], at[place], place


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), kind).astype(np.int64)


def _sums(queries: Queries, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each document and item the sum of value * weight over the item's terms."""
    out = np.zeros((n, queries.n_items), np.int64)
    order = np.argsort(term, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(term[order])) + 1, [len(order)]])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if s == e:
            continue
        at, t = order[s:e], term[order[s]]
        items, weight = (x[queries.first[t] : queries.first[t + 1]] for x in (queries.item, queries.weight))
        out[doc[at][:, None], items[None, :]] += value[at][:, None] * weight[None, :]
    return out


def _parts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _document_frequencies(index: Index, queries: Broadcast) -> dict[int, int]:
    """Of the block's terms, by their places; each task sends one row for each at most."""

    def run(batches):
        asked = queries.value
        total = np.zeros(len(asked.terms), np.int64)
        for part in _parts(batches):
            total += np.bincount(_hits(asked, part.column(0))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield record([("t", pa.int64()), ("df", pa.int64())], some, total[some])

    counted = index.rows.select("terms").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return {r.t: r.df for r in counted.collect()}  # bounded by the block's words


def _top_bounds(index: Index, queries: Broadcast, k: int) -> DataFrame:
    """item, bound: each task's k greatest lower bounds, in steps, of each item."""

    def run(batches):
        asked = queries.value
        top = np.zeros((asked.n_items, k), np.int64)
        for part in _parts(batches):
            doc, term, place = _hits(asked, part.column(0))
            low = _sums(asked, doc, term, _flat(part.column(1), np.uint8)[place] - 1, part.num_rows)
            both = np.concatenate([top, low.T], axis=1)
            top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        item, at = np.nonzero(top)
        yield record([("item", pa.int32()), ("bound", pa.int64())], item, top[item, at])

    return index.rows.select("terms", "impacts").mapInArrow(run, "item int, bound long")


def _first(rows: DataFrame, k: int, order: list, salt) -> DataFrame:
    """The first k rows of each item and their rank; groups by salt meet before."""
    part = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_salt")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _rescored(index: Index, queries: Broadcast, least: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the exact scores of all documents whose upper bound reaches
    the item's least bound, each task's k first of each item."""
    n_docs, n_terms = index.n_docs, index.n_terms
    schema = [("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]

    def exact(asked: Queries, part: pa.RecordBatch, doc, term, place, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        n = part.column(3).to_numpy()
        impact = impacts(_flat(part.column(4), np.uint32)[place], (75 + (25 * n * n_docs) // n_terms)[doc])
        first = np.searchsorted(doc, np.arange(part.num_rows + 1))
        held = np.repeat(np.arange(len(asked.terms)), np.diff(asked.first)) * asked.n_items + asked.item
        out = np.zeros(len(pairs[0]), np.int64)
        for s in range(0, len(out), PAIRS):
            d, i = pairs[0][s : s + PAIRS], pairs[1][s : s + PAIRS]
            sizes = first[d + 1] - first[d]
            pair = np.repeat(np.arange(len(d)), sizes)
            hit = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[d], sizes)
            key = term[hit] * asked.n_items + i[pair]
            at = np.minimum(np.searchsorted(held, key), len(held) - 1)
            ok = held[at] == key
            np.add.at(out, s + pair[ok], impact[hit[ok]] * asked.weight[at[ok]])
        return out

    def ranked(rows: list[pa.Table]) -> list[pa.Table]:
        all_rows = pa.concat_tables(rows).combine_chunks()
        item, score = all_rows.column(0).to_numpy(), all_rows.column(2).to_numpy()
        ids = all_rows.column(1)
        none, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, none, -score, item))
        start = np.searchsorted(item[order], item[order], "left")
        return [all_rows.take(pa.array(order[np.arange(len(order)) - start < k]))]

    def run(batches):
        asked, held, size = queries.value, [], 0
        for part in _parts(batches):
            doc, term, place = _hits(asked, part.column(0))
            high = _sums(asked, doc, term, _flat(part.column(1), np.uint8)[place], part.num_rows)
            pairs = np.nonzero((high > 0) & (high >= least[None, :]))
            score = exact(asked, part, doc, term, place, pairs)
            good = score > 0
            found = record(schema, pairs[1][good].astype(np.int32), part.column(2).take(pa.array(pairs[0][good])), score[good])
            held.append(pa.Table.from_batches([found]))
            size += found.num_rows
            if size > 2 * k * asked.n_items + 65536:
                held = ranked(held)
                size = held[0].num_rows
        if held:
            yield from ranked(held)[0].to_batches()

    return index.rows.select("terms", "impacts", "doc_id", "n", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def _search(scratch: Scratch, index: Index, items: DataFrame, k: int) -> DataFrame | None:
    """item_id, rank, doc_id, score of one block."""
    spark = items.sparkSession
    asked = Queries.of(items.select("item", "terms", "tfs").collect())  # ITEMS items and WORDS words at most
    if not len(asked.terms):
        return None
    sent = spark.sparkContext.broadcast(asked)
    df = _document_frequencies(index, sent)
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(asked.terms))], np.int64)
    sent.destroy()
    asked.weight = asked.weight * np.repeat(weight, np.diff(asked.first))
    sent = spark.sparkContext.broadcast(asked)
    least = np.zeros(asked.n_items, np.int64)
    bounds = _first(_top_bounds(index, sent, k), k, [F.desc("bound")], F.xxhash64("bound"))
    for r in bounds.where(F.col("rank") == k).collect():  # one row for each item of the block
        least[r.item] = r.bound
    rows = _first(_rescored(index, sent, least, k), k, [F.desc("score"), F.asc_nulls_last("doc_id")], F.xxhash64("doc_id"))
    out = scratch.keep(rows.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "found")
    sent.destroy()
    return out


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP, under: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k first documents of each item."""
    scratch = Scratch(spark, "lexical", under)
    index, dealt = build(scratch, docs), _blocks(scratch, items)
    found = []
    for row in dealt.select("block").distinct().collect() if index.n_docs else []:
        one = _search(scratch, index, dealt.where(F.col("block") == row.block), k)
        if one is not None:
            found.append(one)
    scratch.drop_others(*[df._newsloom_path for df in found])
    if not found:
        return dealt.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out
