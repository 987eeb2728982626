"""Best-fit packing by length patterns fitted with non-negative least squares.

1. Documents become token pieces of at most CAPACITY ids (no shuffle).
2. The histogram of piece lengths (at most CAPACITY rows, whatever the data)
   goes to the driver.  Patterns of two or three lengths that fill a sequence
   are enumerated; non-negative repeat counts are fitted to the histogram by
   multiplicative updates, rounded, and held within the histogram.
3. What the rounded patterns leave is packed best-fit, longest first, on counts.
4. Each piece gets its rank among pieces of its length (hash buckets, so that a
   frequent length spreads over many tasks) and finds its place in the plan.

Edge cases: a null or empty text is the single id 0; repeated rows are packed
like other rows; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, over_batches, pick, record
from ._text import BLANK_WORDS, Words, slices

CAPACITY = 2048
SEPARATOR = 0
FIT_STEPS = 60
_CACHE = 1_000_000  # ids a task holds for words seen before; beyond it the memory starts anew


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _piece_coder(path: str):
    """Byte-pair merges of the vocabulary file as a rank table, or None if its
    ids are not in merge order.  The end-of-word mark becomes byte 0xFF, which no
    UTF-8 text holds; every entry must then encode to itself."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end, to_byte = model.get("end_of_word_suffix") or "", _byte_characters()
    ranks = {}
    for token, rank in model["vocab"].items():
        mark = bool(end) and token.endswith(end)
        body = token[: -len(end)] if mark else token
        if all(c in to_byte for c in body):
            ranks[bytes(to_byte[c] for c in body) + b"\xff" * mark] = rank
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if not end or any(model["vocab"].get(x + y) != 512 + k for k, (x, y) in enumerate(merged)):
        return None
    coder = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return coder if all(coder._encode_single_piece(t) == [r] for t, r in ranks.items()) else None


class WordIds:
    """Ids of whole texts, from the ids of their blank-separated words.

    The vocabulary's pre-tokenizer always splits at white space and drops it, so
    a text's ids are its words' ids in a row; each distinct word is encoded once.
    Words of printable ASCII and common Latin letters take the vocabulary's own
    merges through a rank table (the same ids, about ten times faster than a call
    of the tokenizer for each word); all other words go to the tokenizer."""

    _PLAIN = re.compile(rb"(?:[\x21-\x7e]|[\xc3-\xc5][\x80-\xbf])*")
    _PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder, self.merges = Tokenizer.from_file(path), _piece_coder(path)
        self.merge = self.merges and self.merges._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def word(self, raw: bytes) -> list[int]:
        if self.merges is None:
            return self.coder.encode(raw.decode(), add_special_tokens=False).ids
        if raw.isalpha():  # ASCII letters: one pre-token
            return self.merge(raw.lower() + b"\xff")
        if raw[:-1].isalpha() and raw[-1:] in b".,":
            return self.merge(raw[:-1].lower() + b"\xff") + self.merge(raw[-1:] + b"\xff")
        if b"<|" in raw or not self._PLAIN.fullmatch(raw):
            return self.coder.encode(raw.decode(), add_special_tokens=False).ids
        text = raw.decode().lower()
        if text.isalpha():
            return self.merge(text.encode() + b"\xff")
        out = []
        for piece in self._PRETOKEN.findall(text):
            out += self.merge(piece.encode() + b"\xff")
        return out

    def learn(self, raw: list[bytes], hashes: list[int]) -> None:
        got = [self.word(r) for r in raw]
        sizes = np.array([len(g) for g in got], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum()))])
        n = len(self.known)
        self.known.update(zip(hashes, range(n, n + len(hashes))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of the texts of a slice, each closed by SEPARATOR."""
        words = Words(data, offsets, BLANK_WORDS)
        back, distinct = pd.factorize(words.hash)
        where = np.empty(len(distinct), np.int64)
        where[back[::-1]] = np.arange(len(back))[::-1]  # the first place of each
        if len(self.flat) > _CACHE:
            self.forget()
        keys = distinct.tolist()
        found = [self.known.get(h) for h in keys]
        new = [k for k, f in enumerate(found) if f is None]
        if new:
            at, n = where[new], len(self.known)
            self.learn([data[s:e].tobytes() for s, e in zip(words.starts[at], words.ends[at])], [keys[k] for k in new])
            for i, k in enumerate(new, n):
                found[k] = i
        index = np.array(found, np.int64)[back]
        size = self.size[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[words.first]
        ids = np.insert(ids, bounds[1:], SEPARATOR)
        return ids, bounds + np.arange(len(bounds))


@functools.cache
def _word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    return WordIds(path)


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; no shuffle."""

    def run(batches):
        coder = _word_ids(vocabulary)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                ids, first = coder.encode(data, offsets)
                ids = ids.astype("<u4")
                doc, piece, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    for n, s in enumerate(range(first[k], first[k + 1], CAPACITY)):
                        e = min(s + CAPACITY, first[k + 1])
                        doc.append(i + k)
                        piece.append(n)
                        start.append(s - first[k])
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e]))
                yield record(_PIECE, batch.column(0).take(pa.array(doc, pa.int64())), piece, start, length, crc)
        coder.forget()  # workers live on and run other stages

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """All multisets of two or three of the lengths that sum to the capacity
    (rows of three, 0 for none)."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = have[capacity] = False
    a = np.flatnonzero(have)
    x, y = np.meshgrid(a, a, indexing="ij")
    z = capacity - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    ok[ok] = have[z[ok]]
    two = a[(2 * a >= capacity) & have[capacity - a]]
    pairs = np.stack([two, capacity - two, np.zeros_like(two)], 1)
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], 1)])


def repeat_counts(found: np.ndarray, hist: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative x that brings sum_p x_p count(p, length) near the histogram:
    multiplicative least-squares updates, which keep every x at 0 or above."""
    x = np.ones(len(found))
    target = hist.astype(float).copy()
    target[0] = 0
    wish = target[found].sum(1)
    for _ in range(steps):
        made = np.bincount(found.ravel(), np.repeat(x, 3), len(hist))
        made[0] = 0
        x *= wish / np.maximum(made[found].sum(1), 1e-9)
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Groups (lengths in a sequence, number of such sequences) that hold every
    piece of the histogram exactly once."""
    left = hist.astype(np.int64).copy()
    groups = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    found = patterns(np.flatnonzero(left), capacity)
    if len(found):
        fit = repeat_counts(found, left)
        order = np.argsort(-fit, kind="stable")
        due = np.diff(np.floor(np.concatenate([[0], np.cumsum(fit[order])]) + 0.5)).astype(np.int64)
        for p, want in zip(found[order], due):
            if want <= 0:
                continue
            parts = [int(v) for v in p if v]
            n = min(want, *(left[v] // parts.count(v) for v in parts))
            if n > 0:
                groups.append((parts, int(n)))
                for v in parts:
                    left[v] -= n
    spaces: dict[int, list[tuple[list[int], int]]] = {}  # open sequences by free space
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            space = min((s for s in spaces if s >= length), default=0)
            if space:
                parts, have = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space]
                take = min(n, have)
                if have > take:
                    spaces.setdefault(space, []).append((parts, have - take))
                spaces.setdefault(space - length, []).append(([*parts, length], take))
            else:
                each = capacity // length  # as many of this length as fit together
                take, rest = (n // each) * each, n % each
                if take:
                    spaces.setdefault(capacity - each * length, []).append(([length] * each, take // each))
                if rest:
                    spaces.setdefault(capacity - rest * length, []).append(([length] * rest, 1))
                take = n
            n -= take
    return groups + [g for gs in spaces.values() for g in gs]


def places(groups: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of places, sorted by (length, first rank): pieces of that length with
    ranks from `rank` on go to sequences from `sequence` on, at `offset`."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, n in groups:
        offset = 0
        for length in parts:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, under: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing", under)
    # rows that repeat an id, or have none, are told apart by where they were written
    made = scratch.keep(pieces(docs, vocabulary).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    hist = np.zeros(CAPACITY + 1, np.int64)
    for row in made.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most CAPACITY rows
        hist[row.length] = row.n
    shared = spark.sparkContext.broadcast(places(plan(hist)))  # bounded by the patterns, not by the data
    buckets = int(min(1 << 16, max(64, hist.sum() // 20_000)))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "salt"))
    ranked = dealt.withColumn("within", within).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = shared.value
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(table["key"], (length << 48) + rank, "right") - 1
        sequence = table["sequence"][at] + rank - (table["key"][at] & ((1 << 48) - 1))
        return record([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())], *[batch.column(k) for k in range(5)], sequence, table["offset"][at])

    return over_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
