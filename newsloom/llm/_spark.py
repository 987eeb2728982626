"""Small Spark helpers: picking columns, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26  # of a bitmap that spares rows a shuffle (8 MB, whatever the data)
BATCH_BYTES = 4 << 20  # of an Arrow batch: ten thousand long texts would fill a worker
HOT = 500  # keys that join_hot broadcasts at most


def place(df: DataFrame, name: str) -> int:
    """Where a column is: by exact name and first place, else whatever the case."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """The columns renamed by place, so that names that differ by case only, or
    repeat, do no harm."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever other columns there are."""
    return numbered(df).select(*[F.col(f"_c{place(df, n)}").alias(n) for n in names])


def over_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over all columns, which stay as they are in name and type."""
    plain = numbered(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder.  The session's Arrow batches are bounded in bytes, unless
    it has a bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(bound):
        spark.conf.set(bound, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where
    the session names none, a local one is made in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Written tables in the shared folder.  They cut lineage, survive lost
    executors, and are dropped as soon as later tables replace them.

    A step that runs within another gets that one's scratch as `under`: its tables lie
    in the other's folder, and only the other releases them, once it has written what it
    wanted of them.  Whatever is left then goes when the application ends."""

    def __init__(self, spark: SparkSession, label: str, under: "Scratch | None" = None):
        self.spark, self.root = spark, f"{under.root if under else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n, self.made, self.children = 0, [], []
        if under:
            under.children.append(self)
        else:
            where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def path(self, label: str = "t") -> str:
        self.n += 1
        self.made.append(f"{self.root}/{label}{self.n}")
        return self.made[-1]

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path, schema = self.path(label), df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._newsloom_path = path
        return out

    def remove(self, *paths: str) -> None:
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *frames: DataFrame) -> None:
        self.remove(*[path for df in frames if (path := getattr(df, "_newsloom_path", None))])

    def release(self) -> None:
        """Removes all of this scratch and of what ran under it."""
        self.remove(self.root)
        self.children = []

    def release_children(self) -> None:
        """Removes the tables of the steps that ran under this one, whose results are
        written or not wanted."""
        for child in self.children:
            child.release()
        self.children = []

    def drop_others(self, *paths: str) -> None:
        """Removes all that was written so far but for these paths."""
        self.remove(*[p for p in self.made if p not in paths])
        self.made = [p for p in self.made if p in paths]


def bitmap(rows: DataFrame, column: Column) -> Broadcast:
    """FILTER_BITS bits, one of them set for each 64-bit hash in a column.  What
    is unset is surely absent; what is set needs an exact join."""
    at = F.pmod(column, F.lit(FILTER_BITS)) + 1
    parts = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        bits[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_be_in(shared: Broadcast, column: Column) -> Column:
    """Whether a hash has its bit; only the hash travels to Python."""

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        return pa.array(has_bit(shared.value, at.to_numpy(zero_copy_only=False)))

    return test(F.pmod(column, F.lit(FILTER_BITS)))


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are distinct and whose `count` tells how
    many rows of left share a key.  Keys with more than 1 / HOT of the counted
    rows (so fewer than HOT keys) are broadcast, so no task gets a hot key's rows;
    the others are shuffled."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > F.lit(total)
    known = left.join(F.broadcast(right.where(hot)), key)
    others = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key, how)
    return known.unionByName(others)


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch (batches without rows are skipped)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def record(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])
