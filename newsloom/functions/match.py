"""Match keys, weighted Jaccard scores and the two-threshold verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DISTINCT_THRESHOLD, KEY_CAP, MERGE_THRESHOLD, WEIGHTS
from .text import col, merge_tags, non_empty, split_commas, split_tags, split_words

PARTS = ("entities", "titleTokens", "tags")


def sorted_set(items) -> Column:
    """Distinct non-empty terms in code order, at most KEY_CAP."""
    return F.slice(F.array_sort(F.array_distinct(non_empty(col(items)))), 1, KEY_CAP)


def match_key(title, peoples, proper_names, tags) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        sorted_set(F.concat(split_commas(peoples), split_commas(proper_names))).alias("entities"),
        sorted_set(split_words(title)).alias("titleTokens"),
        sorted_set(F.coalesce(col(tags), none)).alias("tags"),
    )


def union_keys(a, b) -> Column:
    return F.struct(*[sorted_set(F.concat(col(a)[p], col(b)[p])).alias(p) for p in PARTS])


def jaccard(a, b) -> Column:
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(either == 0, 0.0).otherwise(both / either)


def match_score(a, b, weights: dict[str, float] = WEIGHTS) -> Column:
    x, y, z = (F.lit(float(weights[p])) * jaccard(col(a)[p], col(b)[p]) for p in PARTS)
    return x + y + z


def classify(score, merge: float = MERGE_THRESHOLD, distinct: float = DISTINCT_THRESHOLD) -> Column:
    score = col(score)
    return F.when(score >= F.lit(merge), "merge").when(score <= F.lit(distinct), "distinct").otherwise("adjudicate")


def message_tags(category, tags) -> Column:
    return merge_tags(split_tags(category), tags)
