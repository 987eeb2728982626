"""Personal data: exact base patterns, widened by a skip-chain CRF.

Base spans are the leftmost non-overlapping matches of fixed patterns.  Other
tokens that look alike (a number in another layout, an address without its full
domain) are the free nodes of a conditional random field per document: base
spans are observed nodes, neighbours in reading order share an edge, and
distant tokens with the same or a similar key share a skip edge, strung
from occurrence to occurrence, and from each free node to the nearest observed
node of its key, so that free repeats in between do not outweigh it.  A skip edge
weighs by how alike the two keys are.  Loopy
sum-product messages run until they no longer change, so a value found once is
labelled alike wherever, and however often, it returns in another form.

The weights are fitted to base spans that are masked: of each document a part of the
observed nodes (MASKED) loses its label, and what the others around it say (an equal
key, how alike a similar one is, neighbours, the word before) must tell whether it is
personal data, against the free nodes that no key ties to an observed one.  The
examples of all documents are counted by pattern; the fit is a logistic regression
over these counts, drawn to the default weights by as much as PRIOR examples.  Masked
spans have a base form, which no loose one has, so how many there are says nothing of
how often a loose form is personal data: that prior (nothing) is not fitted, as the
regression's own intercept takes up the shares of the examples.  The words
before are hashed to WORDS places, so every word counts and the model stays as large
as it is.  Nothing is clipped: what the corpus says of words and edges can label a token
and can keep it from a label, whatever its key.  A document without a base span keeps
its free nodes unlabelled: the network is not built there.

Edge cases: null and empty texts have no spans; repeated rows stay repeated;
extra columns are ignored (redaction keeps them)."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import over_batches, over_rows, pick, place, record

KINDS = ("email", "ip", "card", "phone")
WORDS = 4096  # places of the hash of the word before a node
MASKED = 4  # one of so many observed nodes is an example
PRIOR = 4.0  # weight of the defaults in the fit, in examples
ALIKE = 10  # steps of likeness that examples are counted by
SETTLED = 1e-4  # change of a message below which it is at rest
NEAR = 200  # code points between neighbours that share a chain edge

# Fixed patterns of the contract; possessive or guarded so that long runs stay linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:(?:[\x20./-]|\)[\x20-]?|[\x20-]?\()?[0-9])+")
_LOOSE_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?")
_BEFORE = re.compile(r"([^\W\d_]+)\W*$")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, prev, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > prev and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            prev = host.end()
            out.append((start, prev))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans in code points, by kind as in KINDS, by start."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return [_emails(text) if "@" in text else [], ips, cards, phones]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, found in zip(KINDS, spans) for s, e in found)


@dataclass
class Weights:
    """Log-odds: of a free node for no label, of agreement over skip edges
    between equal keys and (times their likeness) between similar ones, and over chain
    edges; and what the word before a node adds for a label, by its hash."""

    nothing: float = 5.0
    same: float = 7.0
    similar: float = 6.0
    chain: float = 0.2
    words: dict[int, float] = field(default_factory=dict)

    def of_word(self, word: str) -> float:
        return self.words.get(place_of(word), 0.0) if word else 0.0


def place_of(word: str) -> int:
    """1 to WORDS - 1; place 0 is no word."""
    return 1 + zlib.crc32(word.encode()) % (WORDS - 1)


def word_before(text: str, start: int) -> str:
    """The last word, lower-cased, of the 40 code points before a place."""
    found = _BEFORE.search(text, max(0, start - 40), start)
    return found[1].lower() if found else ""


def loose_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is an address) of tokens that only look like personal data
    and touch no base span."""
    found = [(*m.span(), False) for m in _LOOSE_NUMBER.finditer(text) if 7 <= len(_digits(m[0])) <= 19]
    prev = 0
    for m in _LOOSE_AT.finditer(text):
        start = m.start()
        while start > prev and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end())
        if start < m.start() and host:
            found.append((start, host.end(), True))
        prev = m.end()
    out, last, k = [], -1, 0
    for s, e, address in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and not (k < len(taken) and taken[k][0] < e):
            out.append((s, e, address))
            last = e
    return out


def keys(token: str, address: bool) -> tuple[str, str]:
    """The exact and the similar key of a token."""
    if address:
        flat = re.sub(r"\(at\)|\[at\]", "@", token.lower())
        flat = re.sub(r"\(dot\)|\[dot\]", ".", flat).replace(" ", "")
        return flat, flat.split("@")[0] + "@"
    digits = _digits(token)
    return digits, digits[-9:]


def likeness(a: str, b: str, address: bool) -> float:
    """Of two different keys with an equal similar key, half to 1: half is for what is
    equal, half grows, for numbers with the share of the longer one's digits that both end
    in, for addresses with the share of characters in common order."""
    if address:
        return 0.5 + SequenceMatcher(None, a, b, autojunk=False).ratio() / 2
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    return 0.5 + k / max(len(a), len(b)) / 2


def network(text: str, base: list[list[tuple[int, int]]], masked: frozenset = frozenset()):
    """Nodes (start, end, address, label or 0) in reading order and edges
    (i, j, type, likeness): 0 chain, 1 equal keys, 2 similar keys.  Occurrences of a key
    are strung in reading order; each free node also has an edge to the nearest
    observed node of its exact key, or else of its similar key.  masked: base spans
    whose nodes are free."""
    nodes = [(s, e, k == 0, 0 if (s, e) in masked else k + 1) for k, found in enumerate(base) for s, e in found]
    taken, reach = [], -1
    for s, e, *_ in sorted(nodes):  # merged, so that both ends ascend
        if s < reach:
            taken[-1] = (taken[-1][0], max(reach, e))
        else:
            taken.append((s, e))
        reach = max(reach, e)
    nodes += [(s, e, address, 0) for s, e, address in loose_spans(text, taken)]
    nodes.sort()
    edges, last, found, alike = [], {}, {}, []
    for i, (s, e, address, label) in enumerate(nodes):
        if i and s - nodes[i - 1][1] <= NEAR:
            edges.append((i - 1, i, 0, 1.0))
        exact, similar = keys(text[s:e], address)
        before = last.get((address, exact))
        if before is not None:
            edges.append((before, i, 1, 1.0))
        elif (near := last.get((address, "~", similar))) is not None:
            edges.append((near, i, 2, likeness(alike[near][0][1], exact, address)))
        last[(address, exact)] = last[(address, "~", similar)] = i
        alike.append(((address, exact), (address, "~", similar)))
        if label:
            for key in alike[-1]:
                found.setdefault(key, []).append(i)
    strung = {(i, j) for i, j, kind, _ in edges if kind}
    for i, node in enumerate(nodes):
        for kind, key in enumerate(alike[i], 1):
            if node[3] or key not in found:
                continue
            at = bisect.bisect(found[key], i)
            j = min(found[key][max(at - 1, 0) : at + 1], key=lambda j: abs(j - i))
            if (min(i, j), max(i, j)) not in strung:
                edges.append((min(i, j), max(i, j), kind, 1.0 if kind == 1 else likeness(alike[i][0][1], alike[j][0][1], node[2])))
            break
    return nodes, edges


def settle(nodes, edges, weights: Weights, before: list[str] | None = None) -> np.ndarray:
    """Labels by loopy sum-product: 0 none, else 1 + the place in KINDS.  before:
    the word before each node."""
    return beliefs(nodes, edges, weights, before).argmax(1)


def beliefs(nodes, edges, weights: Weights, before: list[str] | None = None) -> np.ndarray:
    """Log beliefs of each node's labels, up to a constant."""
    n, labels = len(nodes), 1 + len(KINDS)
    local = np.zeros((n, labels))
    for i, (_, _, address, label) in enumerate(nodes):
        if label:
            local[i] = -50
            local[i, label] = 0
        else:
            local[i, 0] = weights.nothing
            if before:
                local[i, 1:] += weights.of_word(before[i])
            local[i, [2, 3, 4] if address else [1]] = -50
    if edges:
        e = np.array([edge[:3] for edge in edges])
        gain = np.array([weights.chain, weights.same, weights.similar])[e[:, 2]] * np.array([edge[3] for edge in edges])
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        pair = np.expand_dims(np.concatenate([gain, gain]), (1, 2)) * np.eye(labels)
        # What observed nodes say is fixed: said in full from the start, or repeats
        # that have not heard it yet would talk each other out of a label, and
        # untouched by what comes in, or many repeats would outweigh it.
        seen = np.array([label > 0 for *_, label in nodes])[src]
        sent = np.zeros((len(src), labels))
        out = np.logaddexp.reduce(local[src[seen]][:, :, None] + pair[seen], axis=1)
        sent[seen] = out - out.max(1, keepdims=True)
        src, back, pair = src[~seen], back[~seen], pair[~seen]
        for _ in range(n + 50):  # enough to cross the longest chain; most come to rest in a few
            belief = local.copy()
            np.add.at(belief, dst, sent)
            out = belief[src] - sent[back]
            out = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            change = 0.5 * (out - out.max(1, keepdims=True)) - 0.5 * sent[~seen]
            sent[~seen] += change
            if not change.size or np.abs(change).max() < SETTLED:
                break
        np.add.at(local, dst, sent)
    return local


def find(text: str, weights: Weights) -> tuple[list, list]:
    """(base spans, all spans), both by kind."""
    base = base_spans(text)
    if not any(base):
        return base, base
    nodes, edges = network(text, base)
    if all(label for *_, label in nodes):
        return base, base
    labels = settle(nodes, edges, weights, [word_before(text, s) for s, *_ in nodes] if weights.words else None)
    spans = [list(found) for found in base]
    for (s, e, _, label), new in zip(nodes, labels):
        if not label and new:
            spans[new - 1].append((s, e))
    return base, [sorted(found) for found in spans]


def examples(text: str) -> Counter:
    """How often a pattern (an equal key, likeness of a similar one in steps, observed
    neighbours, place of the word before) stands before a masked node (labelled: 1) or
    a free one that no key ties to an observed node (0)."""
    base = base_spans(text)
    spans = [(s, e) for found in base for s, e in found]
    masked = frozenset((s, e) for s, e in spans if zlib.crc32(f"{len(text)}:{s}:{e}".encode()) % MASKED == 0)
    nodes, edges = network(text, base, masked)
    said = [[0, 0, 0] for _ in nodes]
    for i, j, kind, alike in edges:
        for a, b in ((i, j), (j, i)):
            if nodes[a][3] or not nodes[b][3] or (nodes[a][2] != nodes[b][2]):
                continue
            if kind == 1:
                said[a][0] = 1
            elif kind == 2:
                said[a][1] = max(said[a][1], 1 + int(alike * (ALIKE - 1)))
            else:
                said[a][2] += 1
    out: Counter = Counter()
    for (s, e, _, label), (same, alike, chain) in zip(nodes, said):
        if label:
            continue
        hidden = (s, e) in masked
        if hidden or not (same or alike):
            word = word_before(text, s)
            out[same, 0 if same else alike, chain, place_of(word) if word else 0, int(hidden)] += 1
    return out


_PATTERN = ("same", "alike", "chain", "word", "label")


def fit(counts: np.ndarray, base: Weights = Weights()) -> Weights:  # noqa: B008  it is never changed
    """Weights from rows of a pattern, its label and its count.  Newton's steps on the
    penalised likelihood; a word's own weight is shrunk to nothing."""
    same, alike, chain, word, label, n = counts.reshape(-1, 6).astype(np.float64).T
    x = np.stack([-np.ones_like(n), same, alike / ALIKE, chain], 1)
    start = np.array([base.nothing, base.same, base.similar, base.chain])
    theta, words, at = start.copy(), np.zeros(WORDS), word.astype(np.int64)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ theta + words[at])))
        error, curve = n * (label - p), n * p * (1 - p)
        # the words' weights given the others, then the others given the words
        own = np.bincount(at, error, WORDS) - PRIOR / 4 * words
        words = words + np.clip(own / (np.bincount(at, curve, WORDS) + PRIOR / 4), -1, 1)
        words[0] = 0
        p = 1 / (1 + np.exp(-(x @ theta + words[at])))
        error, curve = n * (label - p), n * p * (1 - p)
        step = np.linalg.solve((x * curve[:, None]).T @ x + PRIOR * np.eye(4), x.T @ error - PRIOR * (theta - start))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6 and np.abs(own).max() < 1e-3:
            break
    return Weights(base.nothing, *map(float, theta[1:]), {int(k): float(words[k]) for k in np.flatnonzero(words)})


def train(docs: DataFrame) -> Weights:
    """Weights fitted to the masked base spans of all documents; patterns are counted in
    each task before the shuffle, and there are never more than the pattern's places."""
    # no pattern of base or loose spans matches without a digit or an @ (or its spelling)
    rows = pick(docs, "text").where(F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]"))
    schema = [*[(c, pa.int64()) for c in _PATTERN], ("n", pa.int64())]

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(examples(text.as_py()))
        if total:
            found = np.array([(*k, v) for k, v in total.items()], np.int64)
            yield record(schema, *found.T)

    chain = F.least("chain", F.lit(2)).alias("chain")  # a node has two neighbours at most
    counts = rows.mapInArrow(run, ", ".join(f"{c} long" for c, _ in schema)).groupBy("same", "alike", chain, "word", "label").agg(F.sum("n").alias("n"))
    return fit(np.array([tuple(r) for r in counts.collect()], np.int64))


_OUT = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]


def detect(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, n_added; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1):
            base, spans = find(text.as_py() or "", weights)
            rows.append((*map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(map(len, spans)) - sum(map(len, base))))
        return record(_OUT, batch.column(0), *map(list, zip(*rows)))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return over_batches(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, weights: Weights) -> str:
    """The text with every span replaced by its kind; again until none is left
    (what a replacement brings together may match anew)."""
    while True:
        _, spans = find(text, weights)
        flat = sorted((s, e, kind) for kind, found in zip(KINDS, spans) for s, e in found)
        if not flat:
            return text
        out, at = [], 0
        for s, e, kind in flat:
            if s >= at:
                out += [text[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        text = "".join(out) + text[at:]


def redact_documents(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs with redacted text (and n_chars, where there is one, after it)."""
    at, size = place(docs, "text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns)
            before = columns[at].to_pylist()
            after = [None if t is None else redact(t, weights) for t in before]
            columns[at] = pa.array(after, columns[at].type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if a == b or a is None else len(a) for o, a, b in zip(old, after, before)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return over_rows(docs, run)
