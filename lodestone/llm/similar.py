"""Near-duplicates by the similarity of their word shingles, for corpora.

Texts of which the sets of five-word shingles have a Jaccard similarity of
0.8 or more are linked, and one row of each component stays.

1. Fingerprints (SimHash of the same shingles) within four bits are found by
   their deletion-variant keys, as in ``simhash``, and give candidate pairs.
2. At 0.8 fingerprints differ in about ten bits, too many for deletion
   variants to be selective.  What they miss shares one of ``BANDS`` band keys
   of ``ROWS`` minimum hashes each: a pair at similarity s shares none with
   probability (1 - s^4)^32, 5e-8 at 0.8, and less above it.
3. Band keys that one text alone holds are left out by a pre-aggregated
   summary, and of keys with the same members one is kept.
4. The pairs of step 1 and each bucket's pairs are verified on the whole
   shingle sets.  A task writes a spanning set of the links and not its pairs.
   Buckets of over ``CELL_TEXTS`` texts are dealt over a grid of cells in which
   any two of their texts still meet.

Defined cases: null and empty texts, and those of white space only, have one
shingle, the empty one; fewer words than a shingle are one shingle; rows with
a null id take part and stay only where all ids of a component are null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_bounded, discard, map_arrow, quoted, small_batches, text_or_empty, texts_of, tidy, without, written
from .components import components
from .simhash import fingerprint, keep_least, links

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Texts that one cell compares in memory.
CELL_TEXTS = 1024

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the least hashes under its permutations."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[at : at + 256, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def spanning(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Links by position that join the sets exactly as all pairs of the similarity would."""
    part, whole = similar
    sizes = np.array([len(s) for s in sets])
    near = lambda common, x, y: (part + whole) * common >= part * (sizes[x] + sizes[y])
    if len(sets) == 2:
        return [(0, 1)] if near(len(np.intersect1d(*sets, assume_unique=True)), 0, 1) else []
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(len(values), np.int32)
    waiting, out = np.arange(len(sets)), []
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            x = reached.pop()
            fit = waiting[(whole * sizes[waiting] >= part * sizes[x]) & (whole * sizes[x] >= part * sizes[waiting])]
            if not len(fit):
                continue
            own = flat[starts[x] : starts[x + 1]]
            mark[own] = 1
            ends = np.cumsum(sizes[fit])
            places = np.arange(ends[-1]) + np.repeat(starts[fit] - (ends - sizes[fit]), sizes[fit])
            common = np.add.reduceat(mark[flat[places]], ends - sizes[fit])
            mark[own] = 0
            found = fit[near(common, fit, x)]
            out.extend((int(x), int(y)) for y in found)
            reached.extend(found)
            waiting = np.setdiff1d(waiting, found, assume_unique=True)
    return out


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of (node, fp) that join the nodes as all pairs of fingerprints within four bits would."""
    prints = written(prints.distinct(), "similar-prints")
    least = written(prints.groupBy("fp").agg(F.min("node").alias("least")), "similar-least")
    same = prints.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda end: least.select(F.col("fp").alias(f"fp_{end}"), F.col("least").alias(end))
    near = links(least).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).distinct()
    near = near.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    out = written(same.unionByName(near), "similar-pairs")
    discard(prints)
    discard(least)
    return out


def similar_links(texts: DataFrame, shingle_words: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR, cell_texts: int = CELL_TEXTS) -> DataFrame:
    """Links (a, b) between nodes of (node, t), whose components are those of all pairs of the similarity."""

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch.column(1))
        keys = np.concatenate([band_keys(shingles(t, shingle_words)) for t in texts])
        prints = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64)
        nodes, prints = (np.repeat(x, BANDS) for x in (batch.column(0).to_numpy(), prints.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes), pa.array(prints)], ["k", "node", "fp"])

    def with_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t, shingle_words).tobytes() for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by cell."""
        cell, nodes, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            pairs = spanning(sets, similar) if len(sets) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for k, i, j, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != (k, i, j):
                    yield from out()
                    cell, nodes, sets = (k, i, j), [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
        yield from out()

    keys = written(map_arrow(texts.select("node", "t"), keyed, "k long, node long, fp long"), "similar-keys")
    pairs = fingerprint_pairs(keys.select("node", "fp"))
    keys = keys.select("k", "node")
    summary = keys.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"), F.try_sum(F.shiftright(F.xxhash64("node"), 24)).alias("s")).filter("a < b")
    shared = written(summary.withColumn("s", F.coalesce("s", "k")).groupBy("a", "b", "n", "s").agg(F.min("k").alias("k")).select("k", "n"), "similar-buckets")
    paired = pairs.select(F.xxhash64("a", "b").alias("k"), F.explode(F.array("a", "b")).alias("node"), F.lit(2).cast("long").alias("n"))
    members = written(keys.join(shared, "k").unionByName(paired.select("k", "node", "n")).distinct(), "similar-members")
    nodes = broadcast_if_bounded(written(members.select("node").distinct(), "similar-nodes"))
    sets = map_arrow(texts.select("node", "t").join(nodes, "node", "left_semi"), with_sets, "node long, shingles binary")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-sets")
    blocks = F.when(F.col("n") > cell_texts, F.ceil(F.col("n") * 2 / cell_texts)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).select("k", "node", F.explode(cells).alias("c")).select("k", "c.i", "c.j", "node")
    dealt = dealt.join(sets, "node").select("k", "i", "j", "node", "shingles")
    return dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(tidy(verified), "a long, b long")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component of similar texts, the one with its smallest id (of rows repeated with that id, one)."""
    small_batches(docs.sparkSession)
    text = text_or_empty(quoted(text_col))
    base = without(docs, "__id", "__content")
    nodes = base.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(text).alias("__content"))
    joined = written(components(similar_links(base.select(F.xxhash64(text).alias("node"), text.alias("t")), **options)), "similar-components")
    found = nodes.join(joined, nodes["__content"] == joined["node"], "left").select("__id", "__content", F.coalesce("component", "__content").alias("g"))
    return keep_least(docs, base, found, id_col, text_col)
