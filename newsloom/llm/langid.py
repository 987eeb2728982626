"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary of its training
texts.  A text is encoded whole with every dictionary; the language with the
smallest output wins.  `accepted` is false where the margin to the runner-up is
narrow (below MARGIN of the runner-up's size).

The fit uses a bounded, documented sample: at most BUCKETS documents for each
language, one for each bucket of a hash of the id, and at most DICTIONARY bytes.

Edge cases: a null text or one without a letter is `und` with score 0; with one
learned language it always wins; with none every row is `und`.  Rows with null
lang, null text or null id are not learned from.  Ties go to the first language
in alphabetical order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import over_batches, pick, record
from ._text import buffers

BUCKETS = 128
DICTIONARY = 96 << 10
LEVEL = 3
MARGIN = 0.01
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def train(docs: DataFrame, held_out: bool = True) -> dict[str, bytes]:
    """Raw dictionary content by language.  Two narrow scans: the chosen hashes
    (map-side minima, at most BUCKETS a language), then their texts, of which only
    what fits a dictionary leaves the executors."""
    rows = pick(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("h", F.xxhash64("doc_id"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    # of rows that repeat an id one text counts; then the shortest up to DICTIONARY bytes
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.substring("text", 1, DICTIONARY).alias("text"))).alias("t"))
    order = Window.partitionBy("lang").orderBy("t.size", "h")  # at most BUCKETS rows
    before = F.sum(F.col("t.size") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < DICTIONARY)
    texts = texts.select("lang", "before", F.substring("t.text", 1, DICTIONARY).alias("text")).toArrow()
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, at, text in zip(*(texts.column(k).to_pylist() for k in ("lang", "before", "text"))):
        by.setdefault(lang, []).append((at, text))
    out = {}
    for lang, items in sorted(by.items()):
        parts, left = [], DICTIONARY
        for _, text in sorted(items):  # short texts first: more of them, more varied
            raw = text.encode() + b"\n"
            parts.append(raw[:left])
            left -= len(parts[-1])
            if left <= 0:
                break
        out[lang] = b"".join(parts)
    return out


def _has_letter(raw: bytes) -> bool:
    view = np.frombuffer(raw, np.uint8)
    if _LETTER[view].any():
        return True
    return bool((view >= 0x80).any()) and any(c.isalpha() for c in raw.decode(errors="replace"))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        return [len(c.compress(raw)) for c in self.coders]

    def classify(self, raw: bytes) -> tuple[str, float, bool, int]:
        if not self.langs or not _has_letter(raw):
            return "und", 0.0, False, 0
        sizes = self.sizes(raw)
        best = min(sizes)
        k = sizes.index(best)
        second = min((s for i, s in enumerate(sizes) if i != k), default=None)
        score = 1 / sum(2.0 ** -min(s - best, 60) for s in sizes)
        margin = second - best if second is not None else best
        return self.langs[k], round(score, 9), second is None or margin > MARGIN * second, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, margin_bytes for every row."""
    schema = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("margin_bytes", pa.int64())]

    def run(batches):
        coder = Classifier(dictionaries)
        for batch in batches:
            if batch.num_rows:
                data, offsets = buffers(batch.column(2))
                rows = [coder.classify(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(batch.num_rows)]
                yield record(schema, batch.column(0), batch.column(1), *map(list, zip(*rows)))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, margin_bytes long")
