"""Toxicity: a factorization machine over hashed terms.

score(text) = sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over
the distinct hashed terms i of the whole lower-cased text.  The pairwise part
holds what an additive model misses (an insult beside a group mention).

The fit uses a bounded, documented sample of labelled rows (SAMPLE documents,
those with the smallest hash of their id); scoring reads every whole text.

Edge cases: a null or empty text has no terms and gets the model's base score;
repeated label rows of one document count once (1 wins over 0), null labels and
null ids are not learned from; without labels of both kinds every score is the
share of toxic labels (0 without any).  Repeated documents rows stay repeated;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import over_batches, over_rows, pick, place, record
from ._text import ALNUM_WORDS, Words, slices

BITS = 21  # hashed terms: 2 ** BITS buckets
SAMPLE = 8000  # labelled documents that the fit uses at most
TERMS = 512  # hashed terms that the fitted model holds at most
FACTORS = 8
STEPS = 250
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)  # bytes: beginnings of words are terms too, so that unseen endings of a known stem count


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # sorted hashed terms with weights
    weights: np.ndarray
    factors: np.ndarray


def terms(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), once for each distinct hashed term of a text: its
    words and their beginnings.  wanted: a flag for each bucket of interest."""
    words = Words(data, offsets, ALNUM_WORDS, lower=True)
    keys = []
    for size in (0, *PREFIXES):
        doc, value = words.doc, words.hash
        if size:
            longer = np.flatnonzero(words.ends - words.starts > size)
            doc, value = words.doc[longer], words.span_hash(words.starts[longer], words.starts[longer] + size, size)
        bucket = (value >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            doc, bucket = doc[hit], bucket[hit]
        keys.append((doc.astype(np.int64) << BITS) | bucket)
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def _term_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for i, j, data, offsets in slices(batch.column(1)):
        doc, bucket = terms(data, offsets)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        out += [bucket[cuts[k] : cuts[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
    return record([("doc_id", pa.int64()), ("terms", pa.binary()), ("toxic", pa.int32())], batch.column(0).cast(pa.int64()), out, batch.column(2).cast(pa.int32()))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(terms, toxic) of at most `most` labelled documents outside the held-out third."""
    label = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    chosen = (
        label.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most SAMPLE rows of two numbers each: small enough for any executor
    texts = pick(docs, "doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    lists = over_batches(texts, _term_lists, "doc_id long, terms binary, toxic int")
    # of rows that repeat an id one text counts, so the bound holds
    return lists.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("toxic").alias("toxic")).drop("doc_id")


def fit(lists: list[np.ndarray], toxic: np.ndarray, least_z: float = 4.0) -> Model:
    """Adam on the logistic loss over the terms that tell the classes apart."""
    n, positive = len(toxic), int(toxic.sum())
    none = np.zeros(0, np.int64)
    if not n or positive in (0, n):
        share = positive / n if n else 0.0
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), none, np.zeros(0), np.zeros((0, FACTORS)))
    flat, sizes = np.concatenate(lists), [len(x) for x in lists]
    size, bad = 1 << BITS, np.repeat(toxic == 1, sizes)
    hit, miss = np.bincount(flat[bad], minlength=size), np.bincount(flat[~bad], minlength=size)
    both = (hit + miss) / n
    hit, miss = hit / positive, miss / (n - positive)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / positive + 1 / (n - positive)))
    z = np.where(both * n >= 3, (hit - miss) / spread, 0)
    kept = np.sort(np.argsort(-np.abs(z), kind="stable")[:TERMS])
    kept = kept[np.abs(z[kept]) >= least_z]
    rank = np.full(size, -1, np.int32)
    rank[kept] = np.arange(len(kept))
    x = np.zeros((n, len(kept)), np.float32)
    at = rank[flat]
    told = np.flatnonzero(at >= 0)
    x[np.searchsorted(np.cumsum(sizes), told, "right"), at[told]] = 1
    y = toxic.astype(np.float32)
    share = positive / n
    state = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(len(kept), np.float32), np.random.default_rng(7).normal(0, 0.05, (len(kept), FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, STEPS + 1):
        b, w, v = state
        xv = x @ v
        out = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / n
        xe = x.T @ err
        grads = [err.sum(keepdims=True), xe + 2e-5 * w, x.T @ (err[:, None] * xv) - v * xe[:, None] + 2e-5 * v]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            state[k] = state[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(state[0][0]), kept.astype(np.int64), state[1].astype(np.float64), state[2].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = sample(docs, labels, most).toArrow()
    lists = [np.frombuffer(x.as_buffer(), np.int32) for chunk in rows.column("terms").chunks for x in chunk]  # views, no copies
    toxic = (np.array(rows.column("toxic").to_pylist(), np.int64) > 0).astype(np.int64)
    order = sorted(range(len(lists)), key=lambda i: (lists[i].tobytes(), toxic[i]))  # the same fit whatever the order of rows
    return fit([lists[i] for i in order], toxic[order] if order else toxic)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.full(n, model.bias)
    if len(model.buckets):
        wanted = np.zeros(1 << BITS, bool)
        wanted[model.buckets] = True
        doc, bucket = terms(data, offsets, wanted)
        at = np.searchsorted(model.buckets, bucket)
        out += np.bincount(doc, model.weights[at], n)
        for f in range(model.factors.shape[1]):
            v = model.factors[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [scores(model, data, offsets) for _, _, data, offsets in slices(batch.column(2))]
        score = np.round(np.concatenate(got), 9)
        return record([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())], batch.column(0), batch.column(1), score, (score >= THRESHOLD).astype(np.int32))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return over_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model does not call toxic."""
    at = place(docs, "text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = [scores(model, data, offsets) for _, _, data, offsets in slices(batch.column(at))]
                yield batch.filter(pa.array(np.round(np.concatenate(got), 9) < THRESHOLD))

    return over_rows(docs, run)
