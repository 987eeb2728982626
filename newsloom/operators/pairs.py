"""All pairs of a day that share a term, scored without a shuffle of pairs.

A day's rows are dealt into blocks and every two blocks are a cell, which one task
scores: it holds one block's index from term to rows and streams the other past it.  So
rows are shuffled, as often as a day has blocks (BLOCKS; more only where a block would
pass MOST rows), and pairs leave a task as rows, as counts or as the best of an item.
Scores are exact: intersections are counted by the index, unions follow from sizes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import PARTS

BLOCKS, MOST = 16, 4096
WORK = 1 << 19  # pairs and shared terms that are counted at a time
NEAR = 2e-9  # scores this close to the best may be the best once they are rounded to nine places


@dataclass
class Scored:
    """Scored pairs of a cell: places among `ids` (and `labels`)."""

    date: str
    ids: pa.Array
    labels: pa.Array
    item: np.ndarray
    story: np.ndarray
    score: np.ndarray


def _spread(rows: DataFrame, cells: Callable[[Column, Column], Column], counts: DataFrame) -> DataFrame:
    """Every row once for each of its cells (lo, hi) and its side there: 0 is held, 1 streams past."""
    rows = rows.where("date is not null").select("id", "date", *[F.col(f"key.{p}").alias(p) for p in PARTS], "label")
    rows = rows.join(F.broadcast(counts), "date").withColumn("block", F.pmod(F.xxhash64("id", *PARTS), F.col("blocks")).cast("int"))
    return rows.withColumn("cell", F.explode(cells(F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)))).select("date", "cell.*", "id", *PARTS, "label")


def _cell(lo: Column, hi: Column, side: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / MOST)).cast("int").alias("blocks"))


def _once(rows: DataFrame) -> DataFrame:
    """Cells of each pair of one table once."""
    rows = rows.where("id is not null")

    def cells(b: Column, every: Column) -> Column:
        other = F.transform(every, lambda j: _cell(F.least(b, j), F.greatest(b, j), b > j))
        return F.concat(other, F.array(_cell(b, b, F.lit(1))))  # a block meets itself

    return _spread(rows, cells, _blocks(rows))


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of each row of one table with each of another."""
    counts = _blocks(left.select("date").unionByName(right.select("date")))
    held = _spread(right, lambda b, every: F.transform(every, lambda i: _cell(i, b, F.lit(0))), counts)
    return held.unionByName(_spread(left, lambda b, every: F.transform(every, lambda j: _cell(b, j, F.lit(1))), counts))


def _run(cells: DataFrame, made: Callable[[Iterator[Scored]], Iterator[pa.RecordBatch]], schema: str, weights: dict[str, float], once: bool) -> DataFrame:
    """made() over the scored pairs of every cell; the cells of a partition follow each other."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: sizes in bytes tell little of the work
    rows = cells.repartition(parts, "date", "lo", "hi").sortWithinPartitions("date", "lo", "hi", "side", "id")
    return rows.mapInArrow(lambda batches: made(_scored(batches, weights, once)), schema)


def _sets(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a column of sets, and how many each row has."""
    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


class _Block:
    """The held rows of a cell, with an index from term to rows for each part."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        self.n, self.ids, self.labels = table.num_rows, table["id"].combine_chunks(), table["label"].combine_chunks()
        self.names = np.array(self.ids.to_pylist(), dtype=object)
        self.sizes, self.index = [], []
        for p in PARTS:
            terms, sizes = _sets(table[p].combine_chunks())
            codes = terms.dictionary_encode()
            at = codes.indices.to_numpy(zero_copy_only=False)
            rows_of = np.repeat(np.arange(self.n), sizes)[np.argsort(at, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(codes.dictionary)))]).astype(np.int64)
            self.sizes.append(sizes)
            self.index.append((codes.dictionary, rows_of, ends))


def _meet(block: _Block, rows: pa.RecordBatch, weights: dict[str, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, places in the block, scores) of pairs that share a term."""
    found, work = [], np.full(rows.num_rows, block.n, np.int64)
    for p, (known, _, ends) in zip(PARTS, block.index):
        terms, sizes = _sets(rows.column(p))
        code = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(rows.num_rows), sizes)[code >= 0]
        code = code[code >= 0]
        start, long = ends[code], ends[code + 1] - ends[code]
        work += np.bincount(of, weights=long, minlength=rows.num_rows).astype(np.int64)
        found.append((sizes, of, start, long))
    turn = np.cumsum(work) // WORK
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1), rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        score, shared = np.zeros((b - a) * block.n), np.zeros((b - a) * block.n, bool)
        for p, (sizes, of, start, long), (_, rows_of, _), held in zip(PARTS, found, block.index, block.sizes):
            x, y = np.searchsorted(of, [a, b])
            n = long[x:y]
            each = np.repeat(start[x:y] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(np.repeat((of[x:y] - a) * block.n, n) + rows_of[each], minlength=len(score))
            union = np.add.outer(sizes[a:b], held).ravel() - both
            score += float(weights[p]) * (both / np.maximum(union, 1))
            shared |= both > 0
        at = np.flatnonzero(shared)
        yield a, at // block.n, at % block.n, score[at]


def _scored(batches: Iterator[pa.RecordBatch], weights: dict[str, float], once: bool) -> Iterator[Scored]:
    """The pairs of one cell after the other; of pairs of one table the later id is the item."""
    cell, held, block = None, [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("date", "lo", "hi", "side"))))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            (*now, side), rows = keys[a], batch.slice(a, b - a)
            if now != cell:
                cell, held, block = now, [], None
            if side == 0:
                held.append(rows)
                continue
            if not held:
                continue
            block = block or _Block(held)
            n, ids = rows.num_rows, pa.concat_arrays([rows.column("id"), block.ids])
            labels = pa.concat_arrays([rows.column("label"), block.labels])
            if once:
                names = rows.column("id").to_pylist()
                less, most = np.searchsorted(block.names, names, "left"), np.searchsorted(block.names, names, "right")
            for first, row, place, score in _meet(block, rows, weights):
                row = row + first
                item, story = row, n + place
                if once:
                    later = place < less[row]  # the streamed row has the later id
                    keep = later if cell[1] == cell[2] else later | (place >= most[row])
                    item, story = np.where(later, item, story)[keep], np.where(later, story, item)[keep]
                    score = score[keep]
                yield Scored(cell[0], ids, labels, item, story, score)


def _rows(scored: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
    for s in scored:
        for k in range(0, len(s.score), 1 << 16):
            item, story, score = (x[k : k + (1 << 16)] for x in (s.item, s.story, s.score))
            yield pa.RecordBatch.from_arrays([pa.array([s.date] * len(score), pa.string()), s.ids.take(pa.array(item)), s.ids.take(pa.array(story)), pa.array(score)], names=["date", "item", "story", "score"])


def _counts(scored: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.float64()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["score", "same", "n"])

    n: Counter = Counter()
    for s in scored:
        label = s.labels.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        same = (label[s.item] == label[s.story]) & (label[s.item] >= 0)
        for is_same in (True, False):
            got = pc.value_counts(pa.array(s.score[same == is_same]))
            n.update(dict(zip(((v, is_same) for v in got.field(0).to_pylist()), got.field(1).to_pylist())))
        if len(n) > 1 << 20:
            yield told()
            n.clear()
    yield told()


def _best(scored: Iterator[Scored]) -> Iterator[pa.RecordBatch]:
    def least(ids: pa.Array, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each item's stories those near its best score, the first by id of equal ones."""
        item, story, score = (np.concatenate(x) for x in zip(*found))
        best = np.full(len(ids), -np.inf)
        np.maximum.at(best, item, score)
        near = score >= best[item] - NEAR
        item, story, score = item[near], story[near], score[near]
        order = np.lexsort((rank[story], score, item))
        item, story, score = item[order], story[order], score[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (score[1:] != score[:-1])
        return item[new], story[new], score[new]

    def told(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        item, story, score = least(ids, found)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(item)), ids.take(pa.array(story)), pa.array(score)], names=["item", "story", "score"])

    ids, found, rank = None, [], None
    for s in scored:
        if s.ids is not ids:
            if found:
                yield told(ids, found)
            ids, found, rank = s.ids, [], np.argsort(np.argsort(np.array(s.ids.to_pylist(), dtype=object), kind="stable"))
        found.append(least(ids, [(s.item, s.story, s.score)]))
    if found:
        yield told(ids, found)


def _labelled(rows: DataFrame, label: Column | None) -> DataFrame:
    return rows.withColumn("label", (F.lit(None) if label is None else label).cast("string"))


def across(left: DataFrame, right: DataFrame, weights: dict[str, float]) -> DataFrame:
    """date, item, story, score of the pairs of a row on the left and one on the right."""
    cells = _across(_labelled(left, None), _labelled(right, None))
    return _run(cells, _rows, "date string, item string, story string, score double", weights, False)


def once(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """date, item, story, score of each pair of a table once, the later id as the item."""
    return _run(_once(_labelled(rows, None)), _rows, "date string, item string, story string, score double", weights, True)


def counts(rows: DataFrame, weights: dict[str, float], label: Column | None = None) -> DataFrame:
    """score, same, n: how many pairs of a table, each once, score so and have one label
    or not; rows without a label are unlike all."""
    told = _run(_once(_labelled(rows, label)), _counts, "score double, same boolean, n long", weights, True)
    return told.groupBy("score", "same").agg(F.sum("n").alias("n"))


def best(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """item, story, score: a few pairs of each item among which its best is, also where
    scores are rounded to nine places or more."""
    return _run(_once(_labelled(rows, None)), _best, "item string, story string, score double", weights, True)
