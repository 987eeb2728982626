"""Periodic runs of words: a harmonic grid of LCE queries over suffix arrays.

A run of period q has at least REPEATS * q words, so it holds two neighbouring
points jq and (j + 1)q of the grid of its period.  For each period p and each j
the longest common extensions of jp and (j + 1)p, forward by the suffix array and
backward by the array of the reversed words (both range minima over the LCP array,
by a sparse table), give the stretch of period p around them: n / p queries for a
period, n log n in all.  Stretches found again by multiples of their period have
the same ends; the least period stays.

Every word of a run occurs REPEATS times or more in its text, so the grid is laid
over the stretches of such words alone; no run reaches beyond one.

Texts are handled where they are read, in slices; nothing is shuffled.

Edge cases: a null or empty text has no words, no run and an empty collapsed text
(a null text stays null in collapse()); repeated rows stay repeated; a doc_id that
is null or no number is null in report(); extra columns are ignored by report()
and kept by collapse()."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import over_batches, over_rows, pick, place, record
from ._text import BLANK_WORDS, Words, mix, slices
from .quality import suffix_array

LEAST = 24  # words of a run
REPEATS = 3  # periods of a run
GRID = 1 << 20  # grid points that are queried at a time


class Extensions:
    """Longest common extensions of pairs of positions, forward."""

    def __init__(self, ids: np.ndarray, end: np.ndarray):
        order, common = suffix_array(ids, end)
        self.rank = np.empty(len(ids), np.int64)
        self.rank[order] = np.arange(len(ids))
        level = common.astype(np.int32)
        self.least, width = [level], 1
        while 2 * width <= len(ids):
            level = np.minimum(level[:-width], level[width:])
            self.least.append(level)
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k)) + 1])
        return out


def _grid(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(jp, p) of all neighbouring grid points jp, (j + 1)p of each stretch and
    period, some GRID at a time."""
    periods = size // REPEATS
    stretch = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(stretch)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (size[stretch] - 1) // period
    total = np.cumsum(points)
    at = 0
    while at < len(points):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GRID, "right")))
        n = points[at:to]
        p = np.repeat(period[at:to], n)
        j = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(first[stretch[at:to]], n) + j * p, p
        at = to


def runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; ids: the words of
    several texts in a row, doc: the text of each."""
    none = np.zeros(0, np.int64)
    ids = mix(ids ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], times[back] >= REPEATS, [False]]) if len(ids) else np.zeros(2, bool)
    opens = often[1:-1] & (~often[:-2] | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(ids)])
    closes = often[1:-1] & (~often[2:] | np.concatenate([doc[1:] != doc[:-1], [True]])[: len(ids)])
    begin, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stop - begin >= LEAST
    begin, size = begin[long], (stop - begin)[long]
    if not len(begin):
        return none, none, none
    first = np.cumsum(size) - size
    where = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(begin, size)
    own = mix(ids[where] ^ np.repeat(np.arange(1, len(size) + 1).astype(np.uint64) << np.uint64(32), size))
    n = len(own)
    ahead = Extensions(own, np.repeat(first + size, size))
    behind = Extensions(own[::-1].copy(), np.repeat(n - first, size)[::-1].copy())
    low = np.repeat(first, size)
    found = []
    for i, p in _grid(first, size):
        alike = own[i] == own[i + p]
        i, p = i[alike], p[alike]
        forward, backward = ahead(i, i + p), np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > low[i])
        backward[inner] = behind(n - i[inner], n - i[inner] - p[inner])
        length = forward + backward + p
        good = length >= np.maximum(LEAST, REPEATS * p)
        found.append(np.unique(np.stack([(i - backward)[good], length[good], p[good]], 1), axis=0))
    found = np.unique(np.concatenate(found), axis=0)  # by start, length and period
    if len(found):
        fresh = np.concatenate([[True], np.any(found[1:, :2] != found[:-1, :2], axis=1)])
        found = found[fresh]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return where[found[:, 0]], found[:, 1], found[:, 2]


def runs_of(column: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Each whole text of a batch and its runs, starts counted from its first word."""
    for _, _, data, offsets in slices(column):
        words = Words(data, offsets, BLANK_WORDS)
        start, length, period = runs(words.hash, words.doc)
        bounds = np.searchsorted(start, words.first)
        raw = data.tobytes()
        for d in range(len(offsets) - 1):
            lo, hi = bounds[d], bounds[d + 1]
            own = list(zip((start[lo:hi] - words.first[d]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()))
            yield raw[offsets[d] : offsets[d + 1]], own


def collapsed(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run repeats."""
    words = text.split()  # at the blanks of BLANK_WORDS
    if found:
        keep = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            keep[start + period] += 1
            keep[start + length] -= 1
        words = [w for w, drop in zip(words, np.cumsum(keep).tolist()) if not drop]
    return b" ".join(words)


_LONGS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
_OUT = [*[(c, pa.int64()) for c in _LONGS], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its number of runs, the run of greatest exponent
    and digests of all runs and of the collapsed text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in runs_of(batch.column(1)):
            best = (None,) * 4
            if found:
                start, length, period = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                best = (start, length, period, 1000 * length // period)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            rows.append((len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(text, found)).hexdigest()))
        return record(_OUT, batch.column(0), *map(list, zip(*rows)))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return over_batches(rows, run, ", ".join(f"{c} long" for c in _LONGS) + ", runs_sha256 string, collapsed_sha256 string")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: one row for each run."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows = [(d, *r) for d, (_, found) in zip(ids, runs_of(batch.column(1))) for r in found]
        return record([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")], *(map(list, zip(*rows)) if rows else [[]] * 4))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return over_batches(rows, run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of docs with their texts collapsed; texts without a run stay as
    they are."""
    at = place(docs, "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, (text, found) in enumerate(runs_of(batch.column(at))):
                if found:
                    texts[k] = collapsed(text, found).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return over_rows(docs, run)
