"""Summaries are clamped from the heads of texts as from the whole ones."""

import random

from pyspark.sql import functions as F

from newsloom.functions.spans import clamp, clamp_head, clamp_summary


def test_clamped_heads_equal_clamped_texts(spark):
    rng, texts = random.Random(3), [None, "", "x" * 220, "x" * 221, "😀" * 110, "😀" * 111, "a " * 105 + "[" + "y" * 900]
    for at in range(190, 226):
        for label, digits in ((1, 1), (30, 2), (5, 40), (60, 3)):
            texts.append("w " * (at // 2) + "v" * (at % 2) + "[" + "l" * label + "](#" + "7" * digits + ") and more" * 60)
    for _ in range(400):
        texts.append("".join(rng.choices(["[", "]", "](#1)", "(#", "12", ")", " ", "ab", "😀", "\n", "#"], k=rng.randrange(40, 260))))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.s for r in df.select("k", clamp_summary("t").alias("s")).collect()}
    assert got == {k: t if t is None else clamp(t) for k, t in enumerate(texts)}
    assert sum(t is not None and got[k] != t for k, t in enumerate(texts)) > 200


def test_whole_texts_do_not_reach_python(spark):
    df = spark.createDataFrame([("x " * 50_000,), ("[x " * 50_000,), ("[a](#1) b ] " * 10_000,)], "t string")
    assert df.agg(F.max(F.length(clamp_head("t")))).first()[0] <= 260
