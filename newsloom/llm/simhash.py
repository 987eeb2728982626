"""SimHash near-duplicates by an embedding in segment popcounts.

1. Each whole text becomes a 64-bit fingerprint of its SIZE-word shingles; equal
   fingerprints are one class from here on.
2. A fingerprint is embedded as the bit counts of its 32 segments of two bits.  The
   Manhattan distance of two embeddings never exceeds the number of differing bits,
   over all segments or over any part of them.
3. Grid range join: of two fingerprints that differ in at most DISTANCE = 4 bits,
   either the lower halves differ in at most 2 or the upper halves in at most 1.
   The first are within Manhattan distance 2, so some cell of the lower grid is at
   distance 1 or less of both: each point goes to its own cell and all neighbours.
   The second are in one cell of the upper grid or in neighbouring ones, whose points
   differ in parity: points of even sum go to their neighbours too.
4. A cell of more than CELL classes is split by the same rule over the two quarters
   of the half that its key does not tell (at most 2 and at most 1 bits), and what
   is still larger is dealt into blocks, each pair of which meets once.
5. In each cell the fingerprints are compared in full; only a spanning forest of a
   cell's links leaves the task, fewer rows than went in.  Links become components.

Nothing is lost: every step is a lower bound or exact.

Edge cases: a null text or one without words has fingerprint zero and links like any
other; each row is a document of its own (rows that repeat a doc_id are not tied);
rows with a null id have a fingerprint and link others, and their component_id is
the smallest id reachable, or null where none is; a doc_id that is no number is
null; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, bitmap, join_hot, may_be_in, over_batches, pick, record
from ._text import BLANK_WORDS, Words, slices
from .neardup import components

SIZE = 4  # words of a shingle
SEED = 42
DISTANCE = 4  # differing bits of a link; the grids below are laid out for it
CELL = 1 << 15  # classes of a cell that one task compares, about
SMALL = 16  # cells of at most so many classes are compared all at once
_ONES = np.uint64(0x5555555555555555)


def _shingles(words: Words, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one blank after each, the start and end of each
    shingle in these, and the number of shingles of each text."""
    length = words.ends - words.starts
    at = np.cumsum(length + 1) - length - 1
    said = np.full(int((length + 1).sum()), 0x20, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    said[inside + np.repeat(at, length)] = words.data[inside + np.repeat(words.starts, length)]
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.first[:-1], counts)
    last = first + np.repeat(np.minimum(words.counts, size), counts) - 1
    return said.tobytes(), at[first], at[last] + length[last], counts


def simhashes(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fingerprint of each text: the bits set in over half its shingle hashes."""
    said, start, end, counts = _shingles(Words(data, offsets, BLANK_WORDS, lower=True, hashed=False), size)
    doc = np.repeat(np.arange(len(counts)), counts)
    set_bits = np.zeros((len(counts), 64), np.int64)
    for k in range(0, len(start), 1 << 14):
        part = slice(k, k + (1 << 14))
        hashes = np.array([xxhash.xxh64_intdigest(said[s:e], SEED) for s, e in zip(start[part].tolist(), end[part].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        fresh = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
        set_bits[doc[part][fresh]] += np.add.reduceat(bits, fresh, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


_PRINT = [("doc_id", pa.int64()), ("print", pa.int64())]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed integer): one row for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhashes(data, offsets) for _, _, data, offsets in slices(batch.column(1))]
        return record(_PRINT, batch.column(0), np.concatenate(found).astype(np.uint64).view(np.int64))

    return over_batches(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, print long")


def embed(prints: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, two bits wide each."""
    return prints - ((prints >> np.uint64(1)) & _ONES)


def cells(counts: np.ndarray, low: int, segments: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the grid over the segments from `low` on: each point's own cell,
    and the neighbours of those that are marked."""
    own = (counts >> np.uint64(2 * low)) & np.uint64((1 << 2 * segments) - 1)
    rows, found = [np.arange(len(own))], [own]
    for k in range(segments):
        field = (own >> np.uint64(2 * k)) & np.uint64(3)
        up, down = np.flatnonzero(least & (field < 2)), np.flatnonzero(least & (field > 0))
        step = np.uint64(1 << 2 * k)
        rows += [up, down]
        found += [own[up] + step, own[down] - step]
    return np.concatenate(rows), np.concatenate(found)


def _even(counts: np.ndarray, low: int, segments: int) -> np.ndarray:
    part = (counts >> np.uint64(2 * low)) & _ONES & np.uint64((1 << 2 * segments) - 1)
    return np.bitwise_count(part) % 2 == 0  # the sum is even as the ones among the counts are


def _ranges(prints: np.ndarray, low: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the range join over 2 * segments segments from `low` on, whose
    bits differ in at most DISTANCE; the cell tells its part."""
    counts = embed(prints) >> (np.uint64(2) * low)
    rows, found = cells(counts, 0, segments, np.ones(len(prints), bool))
    more, upper = cells(counts, segments, segments, _even(counts, segments, segments))
    return np.concatenate([rows, more]), np.concatenate([found, upper | np.uint64(1 << 2 * segments)])


_CELL = [("cell", pa.int64()), ("print", pa.int64())]


def _to_cells(prints: DataFrame) -> DataFrame:
    """(cell, print) over both halves; a cell has 33 bits, the highest tells the half."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column(0).to_numpy().view(np.uint64)
        rows, found = _ranges(values, np.zeros(len(values), np.uint64), 16)
        return record(_CELL, found.view(np.int64), values[rows].view(np.int64))

    return over_batches(prints.select("print"), run, "cell long, print long")


def _split(points: DataFrame) -> DataFrame:
    """(cell, print) over both quarters of the half that a cell does not tell, in
    cells of 50 bits and a mark."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
        low = np.where(cell >> np.uint64(32) == 0, np.uint64(16), np.uint64(0))
        rows, found = _ranges(values, low, 8)
        return record(_CELL, (cell[rows] << np.uint64(17) | found | np.uint64(1 << 62)).view(np.int64), values[rows].view(np.int64))

    return over_batches(points.select("cell", "print"), run, "cell long, print long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of edges (a, b) between n nodes that connect what all of them connect."""
    label, at, chosen = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        low, high = np.minimum(label[a[at]], label[b[at]]), np.maximum(label[a[at]], label[b[at]])
        apart = low != high
        at, low, high = at[apart], low[apart], high[apart]
        if not len(at):
            return np.concatenate(chosen)
        order = np.lexsort((low, high))
        one = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        chosen.append(at[one])
        onto = np.arange(n)
        onto[high[one]] = low[one]
        while (onto[onto] != onto).any():
            onto = onto[onto]
        label = onto[label]


def _links(prints: np.ndarray, cuts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each cell (places)."""
    sizes = np.diff(cuts)
    last = np.repeat(cuts[1:], sizes)
    few = np.repeat(sizes <= SMALL, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here = np.arange(len(prints))
    for k in range(1, SMALL):
        here = here[few[here] & (here + k < last[here])]
        near = here[np.bitwise_count(prints[here] ^ prints[here + k]) <= distance]
        a.append(near)
        b.append(near + k)
    a, b = np.concatenate(a), np.concatenate(b)
    keep = _forest(a, b, len(prints))
    a, b = [a[keep]], [b[keep]]
    for c in np.flatnonzero(sizes > SMALL):
        # whoever is reached leaves, so each class is compared with those left alone
        left = np.arange(cuts[c], cuts[c + 1])
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                x = reached.pop()
                near = np.bitwise_count(prints[left] ^ prints[x]) <= distance
                found = left[near]
                if len(found):
                    a.append(np.full(len(found), x))
                    b.append(found)
                    reached += found.tolist()
                    left = left[~near]
    return np.concatenate(a), np.concatenate(b)


_LINK = [("a", pa.int64()), ("b", pa.int64())]


def _compare(points: DataFrame) -> DataFrame:
    """(a, b): the links within the cells, each cell in one task."""

    def linked(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cell, prints = (np.concatenate(p) for p in zip(*parts))
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        a, b = _links(prints, cuts, DISTANCE)
        a, b = prints[a].view(np.int64), prints[b].view(np.int64)
        return record(_LINK, np.minimum(a, b), np.maximum(a, b))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cell, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(cell):
                continue
            at = int(np.searchsorted(cell, cell[-1]))  # where the unfinished cell begins
            if held and (at or cell[0] != held[-1][0][-1]):
                if at:
                    held.append((cell[:at], prints[:at]))
                yield linked(held)
                held = []
            elif at:
                yield linked([(cell[:at], prints[:at])])
            held.append((cell[at:], prints[at:]))
        if held:
            yield linked(held)

    return points.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _crowded(points: DataFrame) -> DataFrame:
    return points.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)


def _without(points: DataFrame, crowded: DataFrame) -> DataFrame:
    return points.join(crowded.select("cell"), "cell", "left_anti")


def links(scratch: Scratch, prints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column print), enough to connect all
    that differ in at most DISTANCE bits."""
    points = _to_cells(prints)
    crowded = scratch.keep(_crowded(points), "crowded")
    if crowded.isEmpty():
        return _compare(points).distinct()
    inner = _split(join_hot(points, crowded, "cell", "n").select("cell", "print"))
    dense = scratch.keep(_crowded(inner), "dense")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    own, other = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = join_hot(inner, dense, "cell", "n").withColumn("blocks", blocks).select("cell", "print", own.alias("own"), other.alias("other"))
    # cells that fall on one hash are compared together, which adds no wrong link
    dealt = dealt.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "print")
    rest = _without(points, crowded).unionByName(_without(inner, dense)).unionByName(dealt)
    return _compare(rest).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, under: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs."""
    scratch = Scratch(spark, "simhash", under)
    rows = scratch.keep(fingerprints(docs), "rows")
    classes = scratch.keep(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    found = scratch.keep(links(scratch, classes).where("a <> b"), "links")
    groups = components(scratch, found)
    ends = bitmap(groups, F.xxhash64("node"))
    # classes of one row that link with nothing are known; only the others are shuffled
    some = classes.where((F.col("copies") > 1) | may_be_in(ends, F.xxhash64("print")))
    some = scratch.keep(some.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print")), "some")
    ids = some.groupBy("component").agg(F.min("least").alias("component_id"))
    of = scratch.keep(some.join(ids, "component").select("print", "copies", "component_id"), "of")
    touched = may_be_in(bitmap(of, F.xxhash64("print")), F.xxhash64("print"))
    scratch.drop_others(rows._newsloom_path, of._newsloom_path)
    known = join_hot(rows.where(touched), of, "print", "copies", "left").select("doc_id", "print", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = known.unionByName(rows.where(~touched).select("doc_id", "print", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
