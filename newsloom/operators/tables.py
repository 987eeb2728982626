"""Mutations as whole-table results: upsert, patch, soft delete, append.

Each returns the new table; the caller writes it.  All are one join on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AUDIT_TTL_MS
from .items import live


def put(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows replaced or added."""
    return base.join(rows.select(key), key, "left_anti").select(base.columns).unionByName(rows.select(base.columns))


def put_new(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows added; one whose key exists is an error."""
    clash = rows.join(base.select(key), key, "left_semi").select(key).first()
    if clash:
        raise ValueError(f"already exists: {clash[0]}")
    return base.unionByName(rows, allowMissingColumns=True)


def put_absent(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows added where their key is new; others ignored."""
    return base.unionByName(rows.dropDuplicates([key]).join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def patch(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns that `changes` has are set, even to null or empty; others stay;
    unknown keys are added."""
    named = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in named], F.lit(True).alias("_hit"))
    rows = base.join(new, key, "full")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in base.columns])


def soft_delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """deleted = true; unknown ids become stubs."""
    return patch(base, ids.select(key).distinct().withColumn("deleted", F.lit(True)), key)


def get(base: DataFrame, id: str, key: str = "id") -> DataFrame:
    return base.where(F.col(key) == F.lit(id))


def list_all(base: DataFrame) -> DataFrame:
    return base.where(live())


def by_status(base: DataFrame, status: str) -> DataFrame:
    return base.where(live() & (F.col("status") == status))


def candidates_of(messages: DataFrame, date: str) -> DataFrame:
    """Key fields of a day's stories, one partition where stored by date."""
    return messages.where((F.col("date") == date) & live()).select("id", "date", "keyEntities", "keyTitle", "keyTags", "memberIds", "memberCount", "title")


def messages_by_status(messages: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Newest first, list fields only; rows that never set `deleted` do not count."""
    rows = messages.where((F.col("status") == status) & (F.col("deleted") == F.lit(False))).orderBy(F.desc("ts"), "id")
    rows = rows.limit(limit) if limit is not None else rows
    return rows.drop("members", "keyEntities", "keyTitle", "keyTags", "posts", "tgChannel")


def pick_in_order(base: DataFrame, ids: list[str], column: str) -> DataFrame:
    """(id, column) for the ids, in their order."""
    if not ids:
        return base.select("id", column).limit(0)
    want = base.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return want.join(base.select("id", column), "id", "left").orderBy("pos").select("id", column)


def merge_members(messages: DataFrame, merges: DataFrame) -> DataFrame:
    """New member blocks win over old ones of the same item."""
    new = merges.select("id", F.col("members").alias("_new"))
    both = F.map_concat(F.map_filter("members", lambda k, _: ~F.map_contains_key("_new", k)), "_new")
    rows = messages.join(new, "id", "left").withColumn("members", F.when(F.col("_new").isNull(), F.col("members")).otherwise(both)).drop("_new")
    return rows.withColumn("memberCount", F.size("members").cast("long")).withColumn("memberIds", F.map_keys("members")).select(messages.columns)


def audit_rows(entries: DataFrame) -> DataFrame:
    """Entries with their expiry, 30 days after `at`."""
    return entries.withColumn("expireAt", F.timestamp_millis(F.col("at") + AUDIT_TTL_MS))


def unexpired(rows: DataFrame, now_ms: int) -> DataFrame:
    return rows.where(F.col("expireAt").isNull() | (F.unix_millis("expireAt") > now_ms))


def stale(base: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Stored keys that a snapshot lacks."""
    return base.select(key).join(snapshot.select(key), key, "left_anti")


def sync(base: DataFrame, snapshot: DataFrame, key: str = "id") -> tuple[DataFrame, int, int]:
    """The snapshot as the new table, with rows written and deleted."""
    return snapshot, snapshot.count(), stale(base, snapshot, key).count()


def changed_fields(drafts: DataFrame, stored: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(id, field, value) of draft values that differ from what is stored."""
    text = lambda df, p: df.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(p + c) for c in columns])
    rows = text(drafts, "d_").join(text(stored, "s_"), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"d_{c}").alias("value"), F.col(f"s_{c}").alias("old")) for c in columns])
    return rows.select(key, F.explode(pairs).alias("p")).where("p.value <> p.old").select(key, "p.field", "p.value")
