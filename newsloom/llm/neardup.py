"""MinHash near-duplicates with sequential Bayesian verification.

1. Each whole text becomes its set of 5-word shingle hashes, a digest of that
   set, band keys (BANDS bands of ROWS MinHash values) and an 8-bit signature.
2. Texts with equal sets collapse into one class (map-side minima by digest).
3. A bucket (equal band key) of several classes links each member to one leader
   of the bucket, chosen by a hash so that leaders differ from band to band.
4. Candidate pairs compare their signatures in batches; a pair goes as soon as
   the posterior chance that its similarity reaches the threshold is below MISS.
   Survivors are confirmed on full sets.
5. Links become components (contracting minimum hooks).  Buckets that still hold
   classes of several components compare the signatures of all other pairs across
   components, in blocks, so that no pair of a bucket goes unseen; the SAMPLE
   smallest shingle hashes of the union (all of them in short texts, whose
   similarity they give exactly) prune what is left.  These links join the rest.

Signatures and sets stay where they are written unless a bitmap of wanted nodes
says that a join may need them.

What is lost: only pairs that share no bucket (at similarity s,
(1 - s ** ROWS) ** BANDS: 2e-6 at 0.75, less above) or fall to step 4's bound.

Edge cases: a null text or one without words has an empty set and links with
nothing; rows that share a doc_id count as one document (their links are
pooled, each row is returned).  Rows with a null id link by their text alone, as
a node of its digest, and never join what their texts do not: such a row has the
smallest doc_id that its text reaches, or null where it reaches none.  They cannot
be told apart, so all are kept, as keep_one() keeps them.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import FILTER_BITS, Scratch, bitmap, has_bit, join_hot, may_be_in, numbered, over_batches, pick, place, record
from ._text import BLANK_WORDS, Words, mix, shingle_hashes, slices, stream

SIZE = 5  # words of a shingle
ROWS, BANDS = 5, 48
HASHES = ROWS * BANDS
STEP = 24  # signature values compared at a time
MISS = 1e-6  # chance at which a candidate is given up
NUMERATOR, DENOMINATOR = 75, 100
BLOCK = 512  # classes of a bucket that one block holds, about
SAMPLE = 512  # smallest shingle hashes of a class that its blocks compare (their upper halves, 2 KB)
NO_HASH = np.uint32(0xFFFFFFFF)

_MULTIPLY = (stream(101, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (stream(102, HASHES) >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over the distinct shingle hashes of one text."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        part = _MULTIPLY[:, None] * short[None, i : i + 1024] + _ADD[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(low, (part * np.uint32(0x2C1B3C6D)).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the rows of `low` (texts x HASHES)."""
    values = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(stream(103, BANDS), values.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = shingle_hashes(Words(data, offsets, BLANK_WORDS, lower=True), SIZE)
    return [np.unique(hashes[first[k] : first[k + 1]]) for k in range(len(offsets) - 1)]


def digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def stray(digest: bytes) -> int:
    """The node of a text whose rows have no id: 62 bits of its digest."""
    return int.from_bytes(digest[:8], "little") >> 2 | 1 << 62


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, digests, lows = [], [], []
    for _, _, data, offsets in slices(batch.column(1)):
        for found in shingle_sets(data, offsets):
            counts.append(len(found))
            digests.append(digest(found.tobytes()))
            lows.append(minhash(found))
    low = np.array(lows)
    keys, small = band_keys(low), (low & np.uint32(0xFF)).astype(np.uint8)
    nodes = [stray(d) if i is None else i for i, d in zip(batch.column(0).to_pylist(), digests)]
    return record(_FINGERPRINT, batch.column(0), nodes, counts, digests, [k.tobytes() for k in keys], [s.tobytes() for s in small])


_FINGERPRINT = [("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("signature", pa.binary())]


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS, batches=range(STEP, HASHES + 1, STEP)) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is given up).  The posterior
    of the similarity has a uniform prior; 8-bit values match by chance too."""
    s = (np.arange(20_000) + 0.5) / 20_000
    q = s + (1 - s) / 256
    log_q, log_p = np.log(q), np.log1p(-np.minimum(q, 1 - 1e-12))
    out = []
    for n in batches:
        for m in range(n + 1):
            like = m * log_q + (n - m) * log_p
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= miss * like.sum():
                break
        out.append((n, m))
    return out


def likely(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows outlast every batch of comparisons, and the
    values that match in these."""
    alive, seen, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in bounds:
        seen = seen + (a[alive, done:n] == b[alive, done:n]).sum(1)
        stay = seen >= m
        alive, seen, done = alive[stay], seen[stay], n
    return alive, seen


def sampled(low_a: np.ndarray, low_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, matches: np.ndarray, least: int) -> np.ndarray:
    """Which pairs outlast the batch of smallest shingle hashes.  low: rows of up to
    SAMPLE sorted hashes, closed by the largest integer; matches: equal signature
    values of the pairs; least: what all values together must reach."""
    both = np.sort(np.concatenate([low_a, low_b], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    again &= both[:, 1:] != NO_HASH
    short = np.maximum(size_a, size_b) <= SAMPLE
    common = again.sum(1)
    union = size_a + size_b - common
    # of larger sets the SAMPLE smallest of the union are a fair sample of it
    seen = np.arange(1, both.shape[1]) + 1 - np.cumsum(again, axis=1)
    part = (again & (seen <= SAMPLE)).sum(1)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    exact = DENOMINATOR * (common + 1) >= NUMERATOR * (union - 1)  # spare for upper halves that are alike within a text
    ok = np.where(short, exact, matches + part >= least)
    return np.flatnonzero(ok & (DENOMINATOR * small >= NUMERATOR * large))


def _rows(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), HASHES)


def _prune(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    bounds = least_matches()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, _ = likely(_rows(batch.column(2)), _rows(batch.column(3)), bounds)
        return batch.select([0, 1]).take(pa.array(got))

    wanted = bitmap(_ends(pairs), F.xxhash64("node"))
    sig = signatures.where(may_be_in(wanted, F.xxhash64("node"))).select("node", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return over_batches(both, run, "a long, b long")


def _full_sets(docs: DataFrame, nodes: DataFrame, strays: bool) -> DataFrame:
    """(node, digest, shingles, low) of the wanted nodes, without a shuffle of texts: a bitmap
    of FILTER_BITS bits, whatever the data, goes to every task, which skips texts
    whose bit is unset; an exact semi-join then drops what passed by chance.  Of
    rows without an id, whose node only their text tells, one for each node stays."""
    bit, shared = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)), bitmap(nodes, F.xxhash64("node"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(shared.value, batch.column(2).to_numpy())))
            if batch.num_rows:
                found = [s for _, _, data, offsets in slices(batch.column(1)) for s in shingle_sets(data, offsets)]
                out = [s.tobytes() for s in found]
                yield record(_SET, batch.column(0), list(map(digest, out)), out, [smallest(s).tobytes() for s in found])

    def unnamed(batches):
        for batch in batches:
            if batch.num_rows:
                found = [s for _, _, data, offsets in slices(batch.column(0)) for s in shingle_sets(data, offsets)]
                out = [s.tobytes() for s in found]
                digests = list(map(digest, out))
                yield record(_SET, list(map(stray, digests)), digests, out, [smallest(s).tobytes() for s in found])

    schema = "node long, digest binary, shingles binary, low binary"
    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    sets = named.select("node", "text", bit.alias("bit")).mapInArrow(run, schema).join(nodes, "node", "left_semi")
    if not strays:
        return sets
    return sets.unionByName(docs.where("doc_id is null").select("text").mapInArrow(unnamed, schema).join(nodes, "node", "left_semi").dropDuplicates(["node"]))


_SET = [("node", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary()), ("low", pa.binary())]


def smallest(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the SAMPLE smallest hashes, which keep their order."""
    return (shingles[:SAMPLE] >> np.uint64(32)).astype(np.uint32)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if not len(small) or DENOMINATOR * len(small) < NUMERATOR * len(large):
                continue
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both):
                keep.append(k)
        return batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    sets = sets.select("node", "shingles")
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return over_batches(both, run, "a long, b long").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Each round every root hooks to its smallest neighbour, hooks are followed to
    their ends by pointer jumping, and the edges shrink to links between roots;
    all joins and minima are distributed, each round is a written table."""
    left = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        ways = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.keep(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hook")
        while True:
            onward = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.keep(hook.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("new"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "jump")
            scratch.drop(hook)
            hook = jumped.select("node", F.col("new").alias("root"))
            hook._newsloom_path = jumped._newsloom_path
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            now = hook
        else:
            now = scratch.keep(found.join(hook.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "found")
            scratch.drop(found)
        a, b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        rest = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = scratch.keep(rest, "edges")
        scratch.drop(left, *([hook] if found is not None else []))
        left, found = rest, now
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("root").alias("component"))


def _bands(classes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        return record([("key", pa.int64()), ("node", pa.int64())], keys, nodes)

    return over_batches(classes.select("node", "bands"), run, "key long, node long")


def _lows(column: pa.Array) -> np.ndarray:
    found = [np.frombuffer(value.as_buffer(), np.uint32) for value in column]
    out = np.full((len(found), max(map(len, found))), NO_HASH)
    for row, value in zip(out, found):
        row[: len(value)] = value
    return out


def _across(mixed: DataFrame, marks: DataFrame, sampling: bool) -> DataFrame:
    """Compares all pairs of classes that share a key and differ in component, but
    for those with the key's leader, which are known.  mixed: key, blocks, node,
    leads, component; marks: signature by node, when sampling also
    size and low.  A key's classes are dealt into blocks of about BLOCK; each pair of
    blocks meets once.  Pairs that are not likely never leave the task: without
    sampling the (key, node) that are in a likely pair come out, no more rows than
    went in; with sampling the pairs (a, b) that outlast that as well."""
    bounds = least_matches()
    ((_, least),) = least_matches(batches=[HASHES + SAMPLE])
    more = ["size", "low"] if sampling else []
    dealt = (
        mixed.join(marks.select("node", "signature", *more), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "leads", "component", "signature", *more)
    )
    names = ["a", "b"] if sampling else ["key", "node"]

    def compared(part: pa.Table) -> list[list]:
        node, comp = part.column("node").to_numpy(), part.column("component").to_numpy()
        key, own, lo, hi, leads = (part.column(c).to_numpy() for c in ("key", "own", "lo", "hi", "leads"))
        sig = _rows(part.column("signature"))
        size = part.column("size").to_numpy() if sampling else None
        change = np.any([x[1:] != x[:-1] for x in (key, lo, hi)], axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(node)]])
        out = [[], []]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
            ok = (comp[i] != comp[j]) & (node[i] != node[j]) & ~leads[i] & ~leads[j] & ((lo[s] == hi[s]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            got, matches = likely(sig[i], sig[j], bounds)
            i, j = i[got], j[got]
            if not len(i):
                continue
            if not sampling:
                ends = np.unique(node[np.concatenate([i, j])])
                out[0].append(np.full(len(ends), key[s]))
                out[1].append(ends)
                continue
            low = _lows(part.column("low").slice(s, e - s))
            for at in range(0, len(i), 2048):
                x, y = i[at : at + 2048], j[at : at + 2048]
                keep = sampled(low[x - s], low[y - s], size[x], size[y], matches[at : at + 2048], least)
                out[0].append(np.minimum(node[x[keep]], node[y[keep]]))
                out[1].append(np.maximum(node[x[keep]], node[y[keep]]))
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        schema = pa.schema([(c, pa.int64()) for c in names])

        def emit(part: pa.Table):
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *c])) for c in compared(part.combine_chunks())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]
            tail = np.all([batch.column(k).to_numpy() == last[k] for k in range(3)], axis=0)
            at = int(np.argmax(tail))  # where the unfinished group begins
            if at or (held and [held[-1].column(k)[0].as_py() for k in range(3)] != last):
                yield emit(pa.Table.from_batches([*held, batch.slice(0, at)]) if at else pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(at))
        if held:
            yield emit(pa.Table.from_batches(held))

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, under: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    scratch = Scratch(spark, "neardup", under)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    wide = scratch.keep(over_batches(docs, _fingerprints, "doc_id long, node long, n_shingles long, digest binary, bands binary, signature binary"), "wide")
    prints = scratch.keep(wide.select("doc_id", "n_shingles", "digest"), "prints")
    full = prints.where("n_shingles > 0")
    named = full.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    strays = not full.where("doc_id is null").isEmpty()
    # only rows whose digest may repeat are shuffled; these meet their class in map-side minima
    again = bitmap(full.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), F.xxhash64("digest"))
    maybe, some = may_be_in(again, F.xxhash64("digest")), wide.where("n_shingles > 0")
    stray = F.col("doc_id").isNull().alias("stray")
    best = some.where(maybe).groupBy("digest").agg(F.min(F.struct(stray, "node", "bands", "signature")).alias("m"), F.count("*").alias("copies"))
    single = some.where(~maybe).select("digest", stray, "node", "bands", "signature", F.lit(1).cast("long").alias("copies"))
    classes = scratch.keep(best.select("digest", "m.*", "copies").unionByName(single), "classes")
    scratch.drop(wide)
    rep = scratch.keep(classes.select("digest", F.col("node").alias("rep"), "stray", "copies"), "reps")

    # documents whose repeated rows have different texts tie the classes of these together
    mixed = named.groupBy("node").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("node")
    ties = scratch.keep(named.join(mixed, "node").join(rep.select("digest", "rep"), "digest").select(F.col("node").alias("a"), F.col("rep").alias("b")), "ties")

    bands = scratch.keep(_bands(classes), "bands")
    leaders = bands.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("m"), F.count("*").alias("n")).where("n > 1")
    leaders = scratch.keep(leaders, "leaders")
    some = bands.where(may_be_in(bitmap(leaders, F.xxhash64("key")), F.xxhash64("key")))
    shared = scratch.keep(join_hot(some, leaders, "key", "n").select("key", "node", F.col("m").bitwiseXOR(F.col("key")).alias("leader")), "shared")
    scratch.drop(bands, leaders)

    pairs = shared.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    pruned = scratch.keep(_prune(pairs, classes), "pruned")
    links = _linked(scratch, docs, pruned, strays)

    groups = scratch.keep(components(scratch, links.unionByName(ties)), "groups")
    rows = scratch.keep(shared.join(groups, "node", "left").select("key", "node", (F.col("node") == F.col("leader")).alias("leads"), F.coalesce("component", "node").alias("component")), "rows")
    scratch.drop(shared)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = scratch.keep(rows.join(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key"), "mixed")
    scratch.drop(rows)
    wanted = may_be_in(bitmap(mixed, F.xxhash64("node")), F.xxhash64("node"))
    marks = scratch.keep(classes.where(wanted).select("node", "signature"), "marks")
    flagged = scratch.keep(_across(mixed, marks, False), "flagged")
    sets = scratch.keep(_full_sets(docs, flagged.select("node").distinct(), strays), "sets")
    # of documents whose rows differ the text of the class counts here
    lows = sets.join(rep.select("digest", F.col("rep").alias("node")), ["digest", "node"], "left_semi").dropDuplicates(["node"])
    lows = lows.select("node", (F.octet_length("shingles") / 8).cast("long").alias("size"), "low").join(marks, "node")
    more = _across(mixed.join(flagged, ["key", "node"], "left_semi"), lows, True)
    more = scratch.keep(more.join(pruned, ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        links = links.unionByName(scratch.keep(_confirm(more, sets), "links"))
        again = components(scratch, links.unionByName(ties))
        groups = scratch.keep(again, "groups")
    scratch.drop(mixed, sets, classes, marks, flagged, pruned)

    if strays:
        # a component goes by its smallest id, or by none
        ids = groups.join(rep.where("stray").select(F.col("rep").alias("node")), "node", "left_anti").groupBy("component").agg(F.min("node").alias("least"))
        groups = scratch.keep(groups.join(ids, "component", "left").select("node", F.col("least").alias("component")), "named")
    of = rep.join(groups.toDF("rep", "component"), "rep", "left").select("digest", "copies", F.coalesce("component", F.expr("if(stray, null, rep)")).alias("component_id"))
    alone = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    of = scratch.keep(of, "of")
    held = [prints, of]
    out = join_hot(full, of, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(alone)
    scratch.drop_others(*[df._newsloom_path for df in held])
    return out.withColumn("kept", F.expr("doc_id is null or doc_id <=> component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()


def _linked(scratch: Scratch, docs: DataFrame, pairs: DataFrame, strays: bool) -> DataFrame:
    sets = scratch.keep(_full_sets(docs, _ends(pairs), strays), "sets")
    out = scratch.keep(_confirm(pairs, sets), "links")
    scratch.drop(sets)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, under: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, whose document is the smallest of its
    group; of rows that repeat an id the one with the longest text stays (in
    code points), of equally long ones the one with the smallest xxhash64 of the
    text.  Rows without an id stay: they cannot be told apart."""
    names, scratch = docs.columns, Scratch(spark, "keepone", under)
    plain, doc_id, text = numbered(docs), f"_c{place(docs, 'doc_id')}", f"_c{place(docs, 'text')}"
    found = near_duplicates(spark, docs, scratch).where("doc_id is not null")
    said = scratch.keep(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "said")
    scratch.release_children()
    # only rows that may go, or whose id repeats, are shuffled; the others stay as they are
    key = F.col(doc_id).cast("long")
    touched = may_be_in(bitmap(said.where("n > 1 or not kept"), F.xxhash64("doc_id")), F.xxhash64(key))
    order = F.struct(-F.coalesce(F.length(text), F.lit(-1)), F.xxhash64(text))
    kept = said.where("kept").select(F.col("doc_id").alias("_id"))
    judged = plain.where(key.isNotNull() & touched).withColumn("_id", key).join(kept, "_id", "left_semi")
    judged = judged.groupBy("_id").agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return judged.unionByName(plain.where(key.isNull() | ~touched)).toDF(*names)
