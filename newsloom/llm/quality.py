"""Quality rules: plain counts and suffix-array repetition.

For each whole text a suffix array over its words (prefix doubling, vectorised
over the texts of a slice) gives the longest common prefixes of neighbouring
suffixes.  LCP intervals of at least LEAST words are the maximal repeated
substrings; the union of their spans must not cover more than COVERED of the
words, and the longest must not pass LONGEST words.

COVERED is the limit that the Gopher rules set for repeated 8-word windows
(12 %), far below the base rule's 50 % of 3-word windows; LONGEST is the length
from which exact substring deduplication removes a passage (50 tokens).  Either
decides alone: a long text with one passage of 51 words twice passes the base
rule and COVERED, one with many repeats of 8 words the base rule and LONGEST.

Edge cases: a null or empty text has no words, fails the base rule (fewer than
50 words) and has kept = false; repeated rows stay repeated; extra columns are
ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import over_batches, pick, record
from ._text import BLANK_WORDS, Words, mix, slices

LEAST = 8
COVERED = 0.12
LONGEST = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def base_counts(words: Words) -> dict[str, np.ndarray]:
    data, offsets, n = words.data, words.offsets, len(words.offsets) - 1
    text = lambda doc, value: mix(value ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    chars = _per_text(BLANK_WORDS[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    real = np.flatnonzero(np.searchsorted(words.starts, end) > np.searchsorted(words.starts, start))
    line_doc = np.searchsorted(offsets, start[real], "right") - 1
    _, one = np.unique(text(line_doc, words.span_hash(start[real], end[real])), return_index=True)
    lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[one], minlength=n)
    at = np.flatnonzero(words.left() >= 3)
    _, back, times = np.unique(text(words.doc[at], words.chain(3)[at]), return_inverse=True, return_counts=True)
    again = at[times[back] > 1] if len(at) else at
    inside = np.zeros(len(words.starts), bool)
    for k in range(3):
        inside[again + k] = True
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": _per_text(inside, words.first)}


def suffix_array(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of several texts in a row.  ids: words, told
    apart by text; end: one past the text's last word, for each position.
    lcp[k] is the common prefix of the suffixes at order[k - 1] and order[k]."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, length, here = [rank], 1, np.arange(n)
    while n and rank.max() < n:
        onward = here + length
        nxt = np.where(onward < end, rank[np.minimum(onward, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        length *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[order[:-1]]) & (b < end[order[1:]])
        alike = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        # a rank of level k compares 2**k words, fewer at the end of a text
        step = np.where(alike, np.minimum(1 << k, np.minimum(end[order[:-1]] - a, end[order[1:]] - b)), 0)
        common[1:] += step
        a += step
        b += step
    return order, common


def intervals(common: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the LCP intervals of at least `least` words whose
    occurrences differ in the word before: the maximal repeated substrings."""
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    out, stack, last = [], [], -1

    def close(above: int, last: int, first: int) -> int:
        while stack and stack[-1][0] > above:
            size, first = stack.pop()
            if changes[last] > changes[first]:
                out.append((size, first, last))
        return first

    for k in np.flatnonzero(common >= least).tolist():
        if k != last + 1:
            close(0, last, k)  # a shorter prefix in between ends them all
        size = int(common[k])
        first = close(size, k - 1, k - 1)
        if not stack or stack[-1][0] < size:
            stack.append((size, first))
        last = k
    close(0, last, 0)
    return out


def repetition(words: Words, least: int = LEAST) -> dict[str, np.ndarray]:
    """Covered words, longest repeat and number of maximal repeats of each text."""
    n = len(words.counts)
    covered, most, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # only texts in which some window of `least` words occurs twice have a repeat that long
    at = np.flatnonzero(words.left() >= least)
    mixed = mix(words.chain(least)[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    docs = np.unique(words.doc[at[times[back] > 1]]) if len(at) else at
    if not len(docs):
        return {"covered": covered, "longest": most, "repeats": repeats}
    pick_words = np.isin(words.doc, docs)
    doc = words.doc[pick_words]
    first = np.searchsorted(doc, docs)
    sizes = words.counts[docs]
    end = np.repeat(first + sizes, sizes)
    ids = mix(words.hash[pick_words] ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order, common = suffix_array(ids, end)
    reach = np.maximum(common, np.append(common[1:], 0))
    long = reach >= least
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, order[long], 1)
    np.add.at(cover, order[long] + reach[long], -1)
    np.add.at(covered, doc[np.cumsum(cover[:-1]) > 0], 1)
    np.maximum.at(most, doc[order[long]], reach[long])
    start = np.isin(order, first)
    before = np.where(start, np.arange(len(order)).astype(np.uint64), ids[np.maximum(order - 1, 0)])
    for _, lo, _ in intervals(common, before, least):
        repeats[doc[order[lo]]] += 1
    return {"covered": covered, "longest": most, "repeats": repeats}


_OUT = [("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("n_repeats", pa.int64())]


def judge(docs: DataFrame, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """One row for each row of docs; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for _, _, data, offsets in slices(batch.column(1)):
            words = Words(data, offsets, BLANK_WORDS)
            c, r = base_counts(words), repetition(words)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            kept = ~failed & (r["covered"] <= covered * c["n_words"]) & (r["longest"] <= longest)
            parts.append([*c.values(), failed, kept, r["covered"], r["longest"], r["repeats"]])
        return record(_OUT, batch.column(0), *[np.concatenate(p) for p in zip(*parts)])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return over_batches(rows, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_repeats long")
