"""Readers of labelled pairs, items, snapshots and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import SPACES


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label) of JSON lines; blank lines are skipped, a bad line is an error
    that quotes it with its number (from 1)."""
    lines = _parsed(spark.read.text(path))
    bad = _bad(lines).first().v
    if bad is not None:
        raise ValueError(f"line {_line_number(spark, path, bad)} is not a labelled pair: {bad[:200]}")
    return lines.select("p.*")


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with what they hold; the first character tells most."""
    return lines.where(F.col("value").rlike(f"[^{SPACES}]")).select("value", F.from_json("value", "a string, b string, label string").alias("p"))


def _bad(lines: DataFrame) -> DataFrame:
    """The least of the bad lines as v, else null.  A filter would parse a line for every
    field it asks for; a projection parses it once."""
    good = F.col("p.a").isNotNull() & F.col("p.b").isNotNull() & F.col("p.label").isin("same", "different")
    return lines.select(F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias("v")).agg(F.min("v").alias("v"))


def _line_number(spark: SparkSession, path: str, line: str) -> int:
    """The first place of a line, counted over the files in order of their names;
    only read when a line is bad, file by file through the reader's own offsets."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("f"), F.split("value", "\r?\n").alias("lines"))
    before = whole.select("f", F.array_position("lines", line).alias("at"), F.size("lines").alias("n")).orderBy("f")
    total = 0
    for r in before.toLocalIterator():
        if r.at:
            return total + r.at
        total += r.n
    return total


def calibration_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array; a repeated id is an error."""
    rows = spark.read.schema("id string, title string, peoples string, properNames string, tags array<string>").json(path, multiLine=True)
    again = rows.groupBy("id").count().where("count > 1").first()
    if again:
        raise ValueError(f"repeated item: {again['id']}")
    return rows


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


class Playlist(DataSource):
    """format("playlist"): the videos of a playlist, page by page, through an injected
    reader.  Option playlist: its id; option reader: module:function(playlist, token)
    that returns ([(videoId, title)], next token or None)."""

    @classmethod
    def name(cls) -> str:
        return "playlist"

    def schema(self) -> str:
        return "videoId string, title string, pos long"

    def reader(self, schema) -> DataSourceReader:
        return _PlaylistReader(self.options)


class _PlaylistReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def read(self, partition):
        import importlib

        module, _, function = self.options["reader"].partition(":")
        page, token, pos = getattr(importlib.import_module(module), function), None, 0
        while True:
            found, token = page(self.options["playlist"], token)
            for video, title in found:
                yield video, title, pos
                pos += 1
            if not token:
                return


def emulated_posts(spark: SparkSession, now_ms: int, bodies: list[str], n: int = 1, seed: int = 0) -> DataFrame:
    """Synthetic posts that pick one of the bodies each."""
    texts = F.array(*[F.lit(b) for b in bodies])
    pick = F.floor(F.rand(seed) * len(bodies)).cast("int") + 1
    return spark.range(n).select(F.lit("emulated").alias("source_id"), (F.lit(now_ms) + F.col("id")).cast("string").alias("id"), F.element_at(texts, pick).alias("body"))
