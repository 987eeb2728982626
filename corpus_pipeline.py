"""The corpus pipeline: named stages, each calling one operator of newsloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet to the shared folder and reads again for the next stage.  run()
also says where a stage keeps its own tables (`under`), and removes these once the
stage's result is written; it touches no table but its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontam, neardup, packing, pii, toxicity
from newsloom.llm._spark import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, under: Scratch | None = None) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, under: Scratch | None = None) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.keep_one(spark, docs, under)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, under: Scratch | None = None) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"), under)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str, under: Scratch | None = None) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return pii.redact_documents(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, under: Scratch | None = None) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    from public_tokenizers import path

    return packing.pack(spark, docs, path("word_bpe_49k.json"), under)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        done = scratch.keep(stage(spark, docs, sf_dir, scratch), name)
        scratch.release_children()  # the stage's own tables: its result is written
        if k:
            scratch.drop(docs)
        docs = done
    return docs
