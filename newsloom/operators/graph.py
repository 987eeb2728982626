"""Connected components by large-star and small-star joins.

Every round is joins and minima over the edges, none of which gathers a node's
neighbours; the edges of a round are a checkpoint in the folder that the session
names (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """The session's checkpoint folder; in local mode one is made where none is named."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(where)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder among the session's checkpoints."""
    checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), both long: the smallest node
    that each one reaches.  Rounds end when the edges stay the same, which then are
    stars around the smallest node of each component."""
    checkpoints(edges.sparkSession)
    digest: Column = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)")))
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while (said := now.agg(digest.alias("d")).first().d) != before:
        before, now = said, _stars(now).checkpoint()
    return now.toDF("node", "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
