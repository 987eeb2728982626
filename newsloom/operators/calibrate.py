"""Threshold calibration: labelled pairs x threshold grid -> precision and recall."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISTINCT_THRESHOLD, MERGE_THRESHOLD, MIN_LABELLED_PAIRS, WEIGHTS
from ..functions.match import match_score
from .stories import with_key


def threshold_grid(step: float) -> list[float]:
    """0 to 1 by whole basis points; steps that do not divide the range are errors."""
    scaled = step * 100
    if scaled != scaled or abs(scaled) == float("inf") or scaled <= 0:
        raise ValueError(f"step must be positive: {step}")
    points = round(scaled)
    if abs(scaled - points) > 1e-9 or points <= 0 or 100 % points:
        raise ValueError(f"step must be whole basis points that divide the range: {step}")
    return [p / 100 for p in range(0, 101, points)]


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair (a, b, same).  A pair of an item with
    itself, or with two labels, is an error."""
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("label") == "same").alias("same"))
    one = ends.groupBy("a", "b").agg(F.min("same").alias("same"), F.max("same").alias("most"))
    bad = F.when(F.col("a") == F.col("b"), F.raise_error(F.concat(F.lit("self pair: "), F.col("a")))).when(F.col("same") != F.col("most"), F.raise_error(F.concat_ws(" ", F.lit("conflicting labels:"), "a", "b"))).otherwise(F.col("same"))
    return one.select("a", "b", bad.cast("boolean").alias("same"))


def scored_pairs(pairs: DataFrame, items: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(a, b, same, score); an id without an item is an error that names it."""
    keyed = with_key(items).select("id", "key")
    rows = pairs.join(keyed.toDF("a", "ka"), "a", "left").join(keyed.toDF("b", "kb"), "b", "left")
    missing = F.when(F.col("ka").isNull(), F.raise_error(F.concat(F.lit("no item: "), F.col("a")))).when(F.col("kb").isNull(), F.raise_error(F.concat(F.lit("no item: "), F.col("b"))))
    return rows.select("a", "b", "same", F.coalesce(missing.cast("double"), match_score("ka", "kb", weights)).alias("score"))


def sweep(scored: DataFrame, step: float) -> DataFrame:
    """The curve.  Pairs are counted once, by the number of thresholds that a score
    reaches and whether it is one; running sums over these at most 202 bins give what
    lies above and below each threshold, and a point of the curve is two look-ups.
    A row of `scored` may stand for n pairs."""
    spark = scored.sparkSession
    values = threshold_grid(step)
    every = F.array(*[F.lit(v) for v in values])
    reached = F.when(F.col("score").isNotNull(), F.size(F.filter(every, lambda v: v <= F.col("score"))))
    n = F.col("n") if "n" in scored.columns else F.lit(1)
    bins = scored.select("same", n.alias("n"), reached.alias("reached"), F.array_contains(every, F.col("score")).alias("exact"))
    bins = bins.groupBy("reached", "exact").agg(F.sum(F.col("same").cast("long") * F.col("n")).alias("same"), F.sum((~F.col("same")).cast("long") * F.col("n")).alias("different"))
    spine = spark.createDataFrame([(k, v, e) for k, v in [*enumerate(values, 1), (0, None)] for e in (True, False)], "reached int, value double, exact boolean")
    counts = spine.join(bins, ["reached", "exact"], "left").fillna(0, ["same", "different"])
    # in order of scores: what equals a threshold comes before what lies beyond it
    upward = Window.orderBy("reached", F.desc("exact")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumns({"same_to": F.sum("same").over(upward), "different_to": F.sum("different").over(upward)})
    whole = Window.partitionBy()
    sums = sums.withColumns({"all_same": F.sum("same").over(whole), "all_different": F.sum("different").over(whole)})
    at = sums.where("exact and reached > 0").select(
        "reached", "value", (F.col("same_to") - F.col("same")).alias("same_below"), (F.col("different_to") - F.col("different")).alias("different_below"), "same_to", "different_to", "all_same", "all_different",
    )
    low = at.select(F.col("reached").alias("k"), F.col("value").alias("distinctThreshold"), "same_to", "different_to")
    high = at.select(F.col("reached").alias("top"), F.col("value").alias("mergeThreshold"), "same_below", "different_below", "all_same", "all_different", F.explode(F.sequence(F.lit(1), "reached")).alias("k"))
    both = high.join(F.broadcast(low), "k")
    # where both thresholds are one, what equals it merges
    ends = F.col("k") == F.col("top")
    split_same, split = (F.when(ends, F.col(f"{c}_below")).otherwise(F.col(f"{c}_to")) for c in ("same", "different"))
    merged, wrong = F.col("all_same") - F.col("same_below"), F.col("all_different") - F.col("different_below")
    both = both.select("distinctThreshold", "mergeThreshold", merged.alias("ms"), wrong.alias("md"), split.alias("ok"), F.col("all_different").alias("different"), (F.col("all_same") + F.col("all_different")).alias("total"), (F.col("same_below") + F.col("different_below") - split_same - split).alias("band"))
    none = F.when(F.col("different") == 0, F.raise_error(F.lit("no different-story pairs: recall is undefined")))
    return both.select(
        "distinctThreshold", "mergeThreshold", F.expr("try_divide(ms, ms + md)").alias("autoMergePrecision"),
        F.coalesce(none.cast("double"), F.col("ok") / F.col("different")).alias("autoSplitRecall"), (F.col("band") / F.col("total")).alias("bandFraction"),
    )


def curve_csv(curve: DataFrame) -> DataFrame:
    """Lines of the curve, header first; a null precision is an empty cell."""
    cells = ["distinctThreshold", "mergeThreshold", "autoMergePrecision", "autoSplitRecall", "bandFraction"]
    body = curve.select(F.struct("mergeThreshold", "distinctThreshold").alias("k"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]).alias("line"))
    head = curve.sparkSession.createDataFrame([(",".join(cells),)], "line string").select(F.lit(None).cast("struct<mergeThreshold: double, distinctThreshold: double>").alias("k"), "line")
    return head.unionByName(body).orderBy(F.asc_nulls_first("k")).select("line")


def labelled_set_hash(pairs_text: str, items_text: str) -> str:
    import hashlib

    return "sha256:" + hashlib.sha256((pairs_text + items_text).encode()).hexdigest()


_RECORD = {"mergeThreshold", "distinctThreshold", "weights", "autoMergePrecision", "autoSplitRecall", "bandFraction", "adjudicatorAccuracy", "labelledSetHash", "pairs", "recordedAt"}


def read_record(path: str) -> dict | None:
    """The calibration record; None without a file, an error if malformed."""
    try:
        with open(path, encoding="utf-8") as file:
            record = json.load(file)
    except FileNotFoundError:
        return None
    if set(record) != _RECORD or set(record["weights"]) != set(WEIGHTS):
        raise ValueError("calibration record: unknown or missing fields")
    shares = ["mergeThreshold", "distinctThreshold", "autoMergePrecision", "autoSplitRecall", "bandFraction", "adjudicatorAccuracy"]
    if not all(0 <= record[k] <= 1 for k in shares) or record["distinctThreshold"] > record["mergeThreshold"] or record["pairs"] < 0:
        raise ValueError("calibration record: values out of range")
    return record


def production_blocker(record: dict | None) -> str | None:
    """Why the thresholds in use are not calibrated; None if they are."""
    if record is None:
        return "thresholds were never calibrated"
    if record["pairs"] < MIN_LABELLED_PAIRS:
        return f"{record['pairs']} labelled pairs are too few: {MIN_LABELLED_PAIRS} are needed"
    if (record["distinctThreshold"], record["mergeThreshold"]) != (DISTINCT_THRESHOLD, MERGE_THRESHOLD):
        return "other thresholds are in use than were calibrated"
    return None if record["weights"] == WEIGHTS else "other weights are in use than were calibrated"
