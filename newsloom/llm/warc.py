"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: payloads of at least LEAST bytes that are equal (SHA-256) share one
response, that with the smallest page id; the others become revisit records that
refer to it.  A record is one row of Spark's text writer, so archives land on any
file system, in files of at most RECORDS records.

Reading: archives are split like any text, at the record magic.  Each piece is a
candidate record; its header gives the offset of the record that should follow.
A task first follows its own candidates to where their chains leave its split;
pointer jumping from each file's start then keeps the splits' reached entries,
and only records on a chain from a file's start are real.  Magic inside a payload
starts no record: its pieces go back to the record that holds them.

Edge cases: a null html is an empty payload, a null url an empty one; rows that
repeat a page id are records of their own (of equal ones the first is the
response); page ids that are null come last and stay null; a record cut off by
the end of its file is dropped; extra columns are ignored."""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, bitmap, join_hot, may_be_in, pick

MAGIC = b"WARC/1.1\r\n"
LEAST = 100
RECORDS = 2000
_NONE = (1 << 63) - 1


def records(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Payloads stay where they are read: digests are counted, a bitmap of those that
    repeat tells which rows are judged, without their payloads, by an exact join,
    and only one payload of each repeated digest is shuffled."""
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    rows = rows.withColumn("order", F.coalesce("page_id", F.lit(_NONE)))
    large, small = rows.where(F.col("payload_bytes") >= LEAST), rows.where(F.col("payload_bytes") < LEAST)
    # copies of a payload meet on the map side
    first = large.groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = scratch.keep(first, "first")
    repeats = bitmap(first, F.xxhash64("digest"))
    maybe = may_be_in(repeats, F.xxhash64("digest"))
    judged = scratch.keep(join_hot(large.where(maybe).select("digest", "order", "page_id", "url", "payload_bytes"), first, "digest", "copies", "left"), "judged")
    plain = ["page_id", "url", "payload_bytes", "digest"]
    refers = F.when(F.col("first") != _NONE, F.col("first")).alias("refers_to")
    later = judged.where(F.col("order") > F.col("first")).select(*plain, F.lit(False).alias("leads"), refers)
    # rows that repeat the smallest id are counted, not told apart, and one leads
    same = judged.where(F.col("order") == F.coalesce("first", "order")).groupBy(*plain, "order", "first").agg(F.count("*").alias("times"))
    same = same.withColumn("place", F.when(F.col("first").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("digest").orderBy("url"))))
    same = same.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    same = scratch.keep(same.select(*plain, "order", ((F.col("place") == 1) & (F.col("time") == 1)).alias("leads"), refers), "same")
    leads = same.where("leads")
    lead = F.xxhash64("digest", "order")
    payloads = large.where(maybe & may_be_in(bitmap(leads, lead), lead)).groupBy("digest", "order").agg(F.first("html").alias("html"))
    leading = leads.join(payloads, ["digest", "order"])
    names = ["page_id", "url", "html", "payload_bytes", F.hex("digest").alias("payload_digest")]
    response, revisit, none = F.lit("response").alias("record_type"), F.lit("revisit").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    parts = [d.select(*names, response, none) for d in (small, large.where(~maybe), leading)]
    parts += [d.withColumn("html", F.lit("")).select(*names, revisit, "refers_to") for d in (later, same.where("not leads").drop("order"))]
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumn("payload_digest", F.lower("payload_digest"))


def write(records: DataFrame, path: str) -> None:
    """WARC/1.1 files; the block is an HTTP response, without body in a revisit."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    refers = F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn("refers_to"))).otherwise("")
    value = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Bytes", F.col("payload_bytes").cast("string")),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(body) + len(http)).cast("string")),
        F.lit("\r\n" + http),
        body,
    )
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def header(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and length of the header at the start of a piece; None if it has
    none with a content length."""
    at, fields = 0, {}
    while m := _FIELD.match(piece, at):
        fields[m[1].lower()] = m[2]
        at = m.end()
    if piece[at : at + 2] != b"\r\n" or not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, at + 2


def parse(piece: bytes) -> tuple | None:
    """(page id, type, digest, bytes, refers to, whole payload's digest) of a
    complete record without its magic."""
    found = header(piece)
    if not found:
        return None
    fields, size = found
    block = piece[size : size + int(fields[b"content-length"])]
    if len(block) < int(fields[b"content-length"]):
        return None
    page = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-record-id", b""))
    refers = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-refers-to", b""))
    kind = fields.get(b"warc-type", b"").decode()
    page, refers = int(page[1]) if page else None, int(refers[1]) if refers else None
    if kind == "revisit":
        return page, kind, int(fields.get(b"warc-payload-bytes", b"0")), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode(), refers
    payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
    return page, kind, len(payload), hashlib.sha256(payload).hexdigest(), refers


_RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_RECORD_ARROW = [("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
_CANDIDATE = [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("end", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("whole", pa.bool_()), *_RECORD_ARROW]


def _pieces(spark: SparkSession, path: str, emit, schema: str) -> DataFrame:
    """Runs emit(file, split, rows of (offset, piece)) over each split's pieces
    in order.  A piece lies between two magics; its offset is that of its magic,
    as if the split's first line began at 0."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        now, line = None, 0
        for batch in batches:
            for file, split, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, split) != now:
                    if now is not None:
                        yield from emit(None)
                    now, line = (file, split), 0
                yield from emit((file, split, line - len(MAGIC), value))
                line += len(value) + len(MAGIC)
        if now is not None:
            yield from emit(None)

    return lines.mapInArrow(run, schema)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each piece: file, split, at (its offset), end (where the piece
    ends), next (its successor's offset), exit (where its chain leaves the split),
    and, if the piece is exactly one record, that record."""
    rows: list[list] = []

    def emit(piece):
        if piece is not None:
            file, split, at, value = piece
            found = header(value)
            follow = at + len(MAGIC) + found[1] + int(found[0][b"content-length"]) + 4 if found else None
            end = at + len(MAGIC) + len(value)
            rows.append([file, split, at, end, follow, None, follow == end, *((parse(value) if follow == end else None) or [None] * 5)])
            return
        exits: dict[int, int] = {}
        for row in reversed(rows):  # successors lie behind, so theirs is known
            if row[4] is not None:
                exits[row[2]] = row[5] = exits.get(row[4], row[4])
        arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _CANDIDATE)]
        rows.clear()
        yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _CANDIDATE])

    return _pieces(spark, path, emit, "file string, split long, at long, end long, next long, exit long, whole boolean, " + _RECORD)


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at and the bytes of each piece."""
    names = ["file", "split", "at", "raw"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def emit(piece):
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece, types)], names=names)

    return _pieces(spark, path, emit, "file string, split long, at long, raw binary")


def _reached(scratch: Scratch, chain: DataFrame) -> DataFrame:
    """(file, at): the entries that file starts reach, split by split.  Pointer
    jumping doubles the splits that a pointer spans in each round."""
    starts = chain.select("file").distinct().select("file", F.lit(0).cast("long").alias("at"))
    leaving = chain.where("exit is not null").select("file", "at", "exit")
    targets = leaving.select("file", F.col("exit").alias("at")).distinct().unionByName(starts).distinct()
    jump = scratch.keep(leaving.join(targets, ["file", "at"], "left_semi"), "jump")  # about one row a split
    found = scratch.keep(starts.join(jump, ["file", "at"], "left_semi"), "found")
    while True:
        new = found.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).join(jump, ["file", "at"], "left_semi")
        more = scratch.keep(found.unionByName(new).distinct(), "found")
        done = more.count() == found.count()
        scratch.drop(found)
        found = more
        if done:
            return found
        onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("then"))
        longer = scratch.keep(jump.join(onward, ["file", "exit"], "left").select("file", "at", F.coalesce("then", "exit").alias("exit")), "jump")
        scratch.drop(jump)
        jump = longer


def read(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The real records of the archives under a path."""
    pieces = scratch.keep(candidates(spark, path), "pieces")
    splits = pieces.groupBy("file", "split").agg(F.max("end").alias("size"))
    before = F.sum(F.col("size") + len(MAGIC)).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("base"))
    moved = [(F.col(c) + F.col("base")).alias(c) for c in ("at", "next", "exit")]
    chain = scratch.keep(pieces.join(base, ["file", "split"]).select("file", "split", "base", *moved, "whole", *[n for n, _ in _RECORD_ARROW]), "chain")
    scratch.drop(pieces)
    reached = _reached(scratch, chain).withColumn("entry", F.lit(True))

    def mark(split: pa.Table) -> pa.Table:
        at, onward, entry = (split.column(c).to_pylist() for c in ("at", "next", "entry"))
        place, real = {a: k for k, a in enumerate(at)}, [False] * len(at)
        for k in (k for k, e in enumerate(entry) if e):
            while k is not None and not real[k] and onward[k] is not None:
                real[k] = True
                k = place.get(onward[k])
        return split.drop_columns(["entry"]).append_column("real", pa.array(real))

    flagged = chain.join(reached, ["file", "at"], "left").select(*chain.columns, F.coalesce("entry", F.lit(False)).alias("entry"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chain.schema) + ", real boolean"
    marked = scratch.keep(flagged.groupBy("file", "split").applyInArrow(mark, schema), "marked")
    scratch.drop(chain)
    simple = marked.where("real and whole").select(*[n for n, _ in _RECORD_ARROW])
    torn = marked.where("real and not whole").select("file", F.col("at").alias("owner"))
    if torn.isEmpty():
        return simple
    return simple.unionByName(scratch.keep(_rejoin(marked, torn, _bytes(spark, path)), "torn"))


def _rejoin(marked: DataFrame, torn: DataFrame, raw: DataFrame) -> DataFrame:
    """Records whose payload holds magic: their pieces, in order, from a second scan."""
    owner = F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    parts = marked.join(torn.select("file").distinct(), "file", "left_semi").withColumn("owner", owner).join(torn, ["file", "owner"], "left_semi")
    parts = parts.select("file", "split", (F.col("at") - F.col("base")).alias("at"), "owner", F.col("at").alias("place"))
    held = parts.join(raw, ["file", "split", "at"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("place", "raw"))).alias("held"))

    def run(batches):
        for batch in batches:
            rows = [r for held in batch.column(0).to_pylist() if (r := parse(MAGIC.join(p["raw"] for p in held)))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _RECORD_ARROW)], names=[n for n, _ in _RECORD_ARROW])

    return held.select("held").mapInArrow(run, _RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, under: Scratch | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: archives
    written to the shared folder and read back."""
    scratch = Scratch(spark, "warc", under)
    path = scratch.path("archive")
    write(records(pages, scratch), path)
    scratch.drop_others(path)
    found = read(spark, path, scratch)
    scratch.remove(path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
