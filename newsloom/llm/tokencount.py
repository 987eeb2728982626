"""Token counts by dynamic programming over a trie of pre-tokens.

A task puts the distinct pre-tokens of a slice (blank-separated words, with the
word mark before them) into a trie: sorted words, of which each opens new nodes
below the prefix it shares with the word before it.  Every node holds the unigram
forward score of its prefix: the best sum of piece scores over the ways to cut
the prefix, and the number of pieces of that way (fewer pieces win a tie).  A
prefix shared by many words is scored once, all nodes of one depth together; the
node at a word's end holds its terminal count.  Terminals of words seen before
are kept from slice to slice; beyond KNOWN words the rarer half goes, which
changes no result.

Pieces come from a SentencePiece vocabulary file.  The score of the piece with
rank r is -log(r + 2), Zipf's law for the ranks the file gives (it holds merge
ranks, no probabilities).  A character without a piece costs one byte piece for
each of its UTF-8 bytes.

A word of more than DEPTH characters shares little: its one branch is followed
with a window of the longest piece, so memory does not grow with the word.  Texts
above one slice are cut at blanks.

Words, prefixes and pieces are told apart by 64-bit hashes (see _text).

Edge cases: null and empty texts have no pre-tokens and count 0; repeated rows
stay repeated; extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick, record
from ._text import BLANK_WORDS, SLICE_BYTES, Words, mix, slices

MARK = "▁"
KNOWN = 400_000  # words whose terminals a task keeps
DEPTH = 256  # characters of a word in the trie
CELLS = 2_000_000  # of one trie: words times depth
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FLAGS = 22  # bits of a hash that tell most spans from pieces


def load_pieces(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(ordinary)}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def widths(chars: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Pieces:
    """Piece scores by hash of the code points."""

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        self.byte = -math.log(len(pieces) + 2)
        names = list(pieces)
        hashes = np.array([self.hash(codes(p)) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([pieces[p] for p in names], float)[order]
        self.flags = np.zeros(1 << _FLAGS, bool)
        self.flags[(self.hashes >> np.uint64(64 - _FLAGS)).astype(np.int64)] = True

    @staticmethod
    def steps(chars: np.ndarray) -> np.ndarray:
        """What each character adds: prefix sums of it, last axis in reading order."""
        value = mix(chars.astype(np.uint64) * _GOLD + _GOLD) * powers(_BASE, chars.shape[-1])
        out = np.zeros((*chars.shape[:-1], chars.shape[-1] + 1), np.uint64)
        np.cumsum(value, axis=-1, out=out[..., 1:])
        return out

    def hash(self, chars: np.ndarray) -> np.uint64:
        return self.span(self.steps(chars)[-1:], np.uint64(1))[0]

    @staticmethod
    def span(difference: np.ndarray, back: np.uint64) -> np.ndarray:
        """Hash of a span: the difference of its prefix sums, moved to the origin."""
        return mix(difference * back)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are pieces, their scores)."""
        maybe = np.flatnonzero(self.flags[(hashes >> np.uint64(64 - _FLAGS)).astype(np.int64)])
        if not len(maybe):
            return maybe, np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        right = self.hashes[at] == hashes[maybe]
        return maybe[right], self.scores[at[right]]


def trie_terminals(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(counts, scores) of sorted distinct words, by one trie of them."""
    n, size = len(words), np.array([len(w) + 1 for w in words])
    deep = int(size.max())
    chars = np.zeros((n, deep), np.uint32)
    chars[np.arange(deep) < size[:, None]] = codes("".join(MARK + w for w in words))
    sums, wide, back = pieces.steps(chars), widths(chars), powers(_BACK, deep + 1)
    shared = np.zeros(n, np.int64)  # characters that a word has in common with the one before it
    shared[1:] = np.cumprod(chars[1:] == chars[:-1], axis=1, dtype=np.int8).sum(1)
    score, count = np.zeros((n, deep + 1)), np.zeros((n, deep + 1), np.int64)
    for depth in range(1, deep + 1):
        new = np.flatnonzero((shared < depth) & (size >= depth))  # the words that open a node here
        best = score[new, depth - 1] + wide[new, depth - 1] * pieces.byte
        fewest = count[new, depth - 1] + wide[new, depth - 1]
        for start in range(max(0, depth - pieces.longest), depth):
            at, piece = pieces.find(pieces.span(sums[new, depth] - sums[new, start], back[start]))
            if len(at):
                s, c = score[new[at], start] + piece, count[new[at], start] + 1
                better = (s > best[at]) | ((s == best[at]) & (c < fewest[at]))
                best[at[better]], fewest[at[better]] = s[better], c[better]
        score[new, depth], count[new, depth] = best, fewest
        # a word that opens none stands below the node of the last one that did
        owner = np.zeros(n, np.int64)
        owner[new] = new
        owner = np.maximum.accumulate(owner)
        score[:, depth], count[:, depth] = score[owner, depth], count[owner, depth]
    rows = np.arange(n)
    return count[rows, size], score[rows, size]


def branch_terminal(parts: Iterator[str], pieces: Pieces) -> tuple[int, float]:
    """(pieces, score) of one long word that comes in parts; a window of the
    longest piece is all that is held."""
    keep, tail = pieces.longest, np.zeros(0, np.uint32)
    window = [(0.0, 0)]  # the best cuts of the last `keep` prefixes, the newest last
    for part in (codes(MARK), *map(codes, parts)):
        chars = np.concatenate([tail, part])
        sums, back, wide = Pieces.steps(chars), powers(_BACK, len(chars) + 1), widths(part)
        ends = np.arange(len(tail) + 1, len(chars) + 1)
        owners, sizes, found = [], [], []
        for size in range(1, keep + 1):
            inside = np.flatnonzero(ends >= size)
            start = ends[inside] - size
            at, piece = pieces.find(pieces.span(sums[ends[inside]] - sums[start], back[start]))
            owners.append(inside[at])
            sizes.append(np.full(len(at), size))
            found.append(piece)
        owner, sized, found = map(np.concatenate, (owners, sizes, found))
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(part) + 1)).tolist()
        sized, found = sized[order].tolist(), found[order].tolist()
        for k, bytes_ in enumerate(wide.tolist()):
            best, fewest = window[-1][0] + bytes_ * pieces.byte, window[-1][1] + bytes_
            for j in range(cuts[k], cuts[k + 1]):
                if sized[j] <= len(window):
                    s, c = window[-sized[j]]
                    s, c = s + found[j], c + 1
                    if s > best or (s == best and c < fewest):
                        best, fewest = s, c
            window.append((best, fewest))
            if len(window) > keep:
                del window[0]
        tail = chars[len(chars) - min(keep, len(chars)) :]
    return window[-1][1], window[-1][0]


def terminals(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(counts, scores) of distinct words, in tries of at most CELLS cells."""
    counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
    short = sorted((k for k in range(len(words)) if len(words[k]) < DEPTH), key=words.__getitem__)
    i = 0
    while i < len(short):
        j, deep = i, 0
        while j < len(short) and (j - i + 1) * max(deep, len(words[short[j]]) + 1) <= CELLS:
            deep = max(deep, len(words[short[j]]) + 1)
            j += 1
        rows = short[i:j]
        counts[rows], scores[rows] = trie_terminals([words[k] for k in rows], pieces)
        i = j
    for k in range(len(words)):
        if len(words[k]) >= DEPTH:
            counts[k], scores[k] = branch_terminal((words[k][a : a + 65536] for a in range(0, len(words[k]), 65536)), pieces)
    return counts, scores


class Known:
    """Terminals by word hash, kept from slice to slice."""

    def __init__(self, pieces: Pieces, most: int = KNOWN):
        self.pieces, self.most = pieces, most
        self.hash, self.count, self.score, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(count, score) of each word of a slice."""
        hashes, where, back, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.hash, hashes)
        old = self.hash[np.minimum(at, len(self.hash) - 1)] == hashes if len(self.hash) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~old)
        count, score = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        count[old], score[old] = self.count[at[old]], self.score[at[old]]
        self.uses[at[old]] += times[old]
        if len(new):
            raw = words.data.tobytes()
            said = [raw[s:e].decode() for s, e in zip(words.starts[where[new]].tolist(), words.ends[where[new]].tolist())]
            count[new], score[new] = terminals(said, self.pieces)
            fields = ((self.hash, hashes), (self.count, count), (self.score, score), (self.uses, times))
            self.hash, self.count, self.score, self.uses = (np.insert(a, at[new], b[new]) for a, b in fields)
            if len(self.hash) > self.most:
                stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
                self.hash, self.count, self.score, self.uses = self.hash[stay], self.count[stay], self.score[stay], self.uses[stay] // 2
        return count[back], score[back]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is one long word) of the parts of a text above one slice."""
    blanks = np.flatnonzero(~BLANK_WORDS[data])
    at = 0
    while at < len(data):
        if len(data) - at <= SLICE_BYTES:
            yield at, len(data), False
            return
        k = int(np.searchsorted(blanks, at + SLICE_BYTES)) - 1
        if k >= 0 and blanks[k] > at:
            end = int(blanks[k])
            yield at, end, False
        elif k >= 0 and blanks[k] == at and (k + 1 == len(blanks) or blanks[k + 1] > at + SLICE_BYTES):
            end = at + 1  # the blank before a long word
        else:
            k = int(np.searchsorted(blanks, at + 1))
            end = int(blanks[k]) if k < len(blanks) else len(data)
            yield at, end, True
        at = end


def _parts(data: np.ndarray) -> Iterator[str]:
    """A long word's bytes as strings, cut between code points."""
    at = 0
    while at < len(data):
        end = min(at + 65536, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end].tobytes().decode()
        at = end


def _long_text(data: np.ndarray, known: Known) -> tuple[int, int, float]:
    """(pre-tokens, tokens, score) of a text above one slice."""
    n = tokens = 0
    score = 0.0
    for start, end, word in _segments(data):
        if word:
            count, value = branch_terminal(_parts(data[start:end]), known.pieces)
            n, tokens, score = n + 1, tokens + count, score + value
        else:
            words = Words(data[start:end], np.array([0, end - start]), BLANK_WORDS)
            count, value = known.look_up(words)
            n, tokens, score = n + len(count), tokens + int(count.sum()), score + float(value.sum())
    return n, tokens, round(score, 6)


_OUT = [("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score for each row of docs; no shuffle."""

    def run(batches):
        known = Known(Pieces(load_pieces(vocabulary)))
        for batch in batches:
            parts = []
            for _, _, data, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                if n == 1 and len(data) > SLICE_BYTES:
                    parts.append(tuple(np.array([v]) for v in _long_text(data, known)))
                    continue
                words = Words(data, offsets, BLANK_WORDS)
                count, score = known.look_up(words)
                parts.append((words.counts, np.bincount(words.doc, count, n).astype(np.int64), np.round(np.bincount(words.doc, score, n), 6)))
            if parts:
                yield record(_OUT, batch.column(0), *[np.concatenate(p) for p in zip(*parts)])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
