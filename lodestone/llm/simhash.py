"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most four bits differ in at most one
bit in some segment when they are cut into three.  Every distinct fingerprint
is indexed under each of its segments with each one bit left out (64 keys);
equal keys meet by an equality shuffle and are verified on all 64 bits.

Equal fingerprints are one row before anything is indexed.  A bucket of up to
``bucket_rows`` fingerprints is linked within its task, which writes a
spanning set of its links and not its pairs.  Larger buckets are never held:
their members are indexed again, by variants of three segments of the bits
that their bucket has not used, and so on until the buckets fit or next to no
bits are left, when distinct members are few.  The same guarantee holds in
every round, so that no pair is lost.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; fewer words than a shingle are
one shingle; rows with a null id take part and never name a component unless
all its ids are null; repeated rows are kept as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, quoted, small_batches, text_or_empty, texts_of, tidy, without, written
from .components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Segments as (first bit, width): with three, one of them differs in at most one of four bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: For each of the 64 keys, the bits of its segment.
_USED = np.array([((1 << width) - 1) << first for first, width in SEGMENTS for _ in range(width)], np.uint64)
#: Fingerprints of one bucket that a task links in memory; larger buckets are cut further.
BUCKET_ROWS = 4096
#: Bits left from which a bucket is not cut further: its members are then at most 2 ** 12.
LEAST_FREE_BITS = 6


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of UTF-8 text: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only and splits at ASCII white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    hashes = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, __content, fp): each row's fingerprint as a signed long, and a hash of its text."""
    small_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.array([fingerprint(t, shingle_words) for t in texts_of(batch.column(2))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["__id", "__content", "fp"])

    kind = dict(docs.dtypes)[id_col]
    text = text_or_empty(quoted(text_col))
    return map_arrow(docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(text).alias("__content"), text.alias("t")), of, f"__id {kind}, __content long, fp long")


def variant_keys(fps: np.ndarray) -> np.ndarray:
    """One row per fingerprint of its 64 keys: (segment and left-out bit, the segment without that bit)."""
    keys = np.empty((len(fps), 64), np.uint64)
    column = 0
    for first, width in SEGMENTS:
        segment = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            keys[:, column] = (segment & ~np.uint64(1 << bit)) | np.uint64(column << 32)
            column += 1
    return keys


def _spanning(members: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that join a bucket's members exactly as all pairs within max_bits would."""
    waiting, a, b = members, [], []
    while len(waiting):
        reached, waiting = waiting[:1], waiting[1:]
        while len(reached) and len(waiting):
            x, reached = reached[0], reached[1:]
            near = np.bitwise_count(waiting ^ x) <= max_bits
            if near.any():
                found = waiting[near]
                a.extend([x] * len(found))
                b.extend(found)
                reached, waiting = np.concatenate((reached, found)), waiting[~near]
    return a, b


def _bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int, bucket_rows: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, fingerprint, bits used) sorted by key: links (used null), and of over-full buckets (fingerprint, key, bits used)."""

    def out(a: np.ndarray, b: np.ndarray, used: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(a), pa.int64()) if used is None else pa.array(np.ascontiguousarray(used).view(np.int64))], ["a", "b", "used"])

    def too_many(count: int, used: np.uint64) -> bool:
        """Members that agree but for few bits are few themselves."""
        return count > bucket_rows and 64 - int(used).bit_count() > LEAST_FREE_BITS

    held = tuple(np.empty(0, np.uint64) for _ in range(3))  # of the bucket that the last batch ended in
    over = None  # its key, if it is over-full
    for batch in batches:
        rows = tuple(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        if not len(rows[0]):
            continue
        if over is not None:
            more = int(np.searchsorted(rows[0] != over, True)) if rows[0][-1] != over else len(rows[0])
            if more:
                yield out(rows[1][:more], rows[0][:more], rows[2][:more])
            rows = tuple(x[more:] for x in rows)
            if not len(rows[0]):
                continue
            over = None
        keys, fps, used = (np.concatenate(x) for x in zip(held, rows, strict=True))
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        last = int(starts[-1])
        held = tuple(x[last:] for x in (keys, fps, used))
        if too_many(len(keys) - last, used[last]):
            over = keys[last]
            yield out(fps[last:], keys[last:], used[last:])
            held = tuple(np.empty(0, np.uint64) for _ in range(3))
        a, b = [], []
        sizes = np.diff(starts)
        for lag in (1, 2, 3):  # small buckets at once: all their pairs, of which there are six at most
            at = starts[:-1][(sizes > lag) & (sizes <= 4)]
            for shift in range(4 - lag):
                i = at[sizes[np.searchsorted(starts, at)] > lag + shift] + shift
                near = np.bitwise_count(fps[i] ^ fps[i + lag]) <= max_bits
                a.append(fps[i][near])
                b.append(fps[i + lag][near])
        for k in np.flatnonzero(sizes > 4):
            members = slice(starts[k], starts[k + 1])
            if too_many(int(sizes[k]), used[members][0]):
                yield out(fps[members], keys[members], used[members])
            else:
                x, y = _spanning(fps[members], max_bits)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        x, y = (np.concatenate(z) if z else np.empty(0, np.uint64) for z in (a, b))
        if len(x):
            pair = np.unique(np.stack((x, y), axis=1), axis=0)
            yield out(pair[:, 0], pair[:, 1])
    if len(held[0]) > 1:
        x, y = _spanning(held[1], max_bits)
        if x:
            yield out(np.array(x, np.uint64), np.array(y, np.uint64))


def _deeper(fps: np.ndarray, keys: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fingerprint, bits used) of members of over-full buckets, each under one-wildcard variants of the bits that its bucket has not used.

    Two members differ in no more bits there than in all, so of three segments
    of them one differs in at most one bit.
    """
    for bits in np.unique(used):
        mine = used == bits
        part, key = fps[mine], keys[mine]
        free = np.array([b for b in range(64) if not int(bits) >> b & 1], np.uint64)
        for number, segment in enumerate(np.array_split(free, len(SEGMENTS))):
            mask = np.uint64(sum(1 << int(b) for b in segment))
            for b in segment:
                value = part & (mask & ~(np.uint64(1) << b))
                mixed = (key ^ np.uint64(number * 64 + int(b) + 1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = ((mixed ^ (mixed >> np.uint64(31))) + value) * np.uint64(0xD1342543DE82EF95)
                yield mixed ^ (mixed >> np.uint64(29)), part, np.full(len(part), bits | mask)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp whose components are those of all pairs within max_bits."""
    if not 0 <= max_bits < 2 * len(SEGMENTS):
        raise ValueError("max_bits must be below 6: three segments of which one differs in at most one bit")

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 1024):
            part = fps[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(variant_keys(part).ravel().view(np.int64)), pa.array(np.repeat(part, 64).view(np.int64)), pa.array(np.tile(_USED, len(part)).view(np.int64))], ["k", "fp", "used"])

    def deeper(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, keys, used = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for columns in _deeper(fps, keys, used):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["k", "fp", "used"])

    variants, out = map_arrow(distinct.select("fp"), keyed, "k long, fp long, used long"), None
    while True:  # each round leaves a third of the bits to the next, so that there are six at most
        dealt = variants.repartition("k").sortWithinPartitions("k", "fp")
        found = written(dealt.mapInArrow(tidy(lambda b: _bucket_links(b, max_bits, bucket_rows)), "a long, b long, used long"), "simhash-links")
        near = found.filter("used IS NULL").select("a", "b")
        out = near if out is None else out.unionByName(near)
        big = found.filter("used IS NOT NULL")
        if big.isEmpty():
            return out
        variants = map_arrow(big.select("a", "b", "used"), deeper, "k long, fp long, used long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, __content, fingerprint in hex, component_id) for every row; component_id is the smallest id reachable."""
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-distinct")
    joined = written(components(links(distinct, max_bits, bucket_rows)).withColumnRenamed("node", "fp"), "simhash-components")
    members = distinct.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    members = written(members, "simhash-members")
    discard(joined)
    smallest = written(members.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(members.join(smallest, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), "__content", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, the one with its smallest id (of rows repeated with that id, one)."""
    base = without(docs, "__id", "__content")
    found = near_duplicates(base, id_col, text_col, **options).withColumnRenamed(id_col, "__id")
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    return keep_least(docs, base, found.select("__id", "__content", group.alias("g")), id_col, text_col)


def keep_least(docs: DataFrame, base: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group, the one with its smallest id.

    base: docs without columns named __id or __content; found: (__id,
    __content, g) of all its rows.
    """
    from .exact_dedup import drop_keys

    identity = {"__id": F.col(quoted(id_col)), "__content": F.xxhash64(text_or_empty(quoted(text_col)))}
    stays = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__content").alias("c")))
    found = written(found, "simhash-found")
    best = written(found.groupBy("g").agg(stays.alias("best")), "simhash-best")  # so that a hot group's rows can be split
    gone = found.join(best, "g").filter("NOT (best.id <=> __id AND best.c = __content)").select("__id", "__content").distinct()
    gone = written(gone, "simhash-dropped")
    kept = drop_keys(base.withColumns(identity), gone)
    repeats = written(found.groupBy("__id", "__content").count().filter("count > 1").select("__id", "__content"), "simhash-repeats")
    if repeats.isEmpty():
        return kept.select(*[quoted(c) for c in docs.columns])
    once = kept.join(repeats.withColumnsRenamed({"__id": "__i", "__content": "__c"}), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__content") == F.col("__c")), "left_semi")
    return drop_keys(kept, repeats).unionByName(once.dropDuplicates(["__id", "__content"])).select(*[quoted(c) for c in docs.columns])
