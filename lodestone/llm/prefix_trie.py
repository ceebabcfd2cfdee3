"""Prefix trie of conversations, rolled up by pointer jumping.

Every conversation is rebuilt from the first turns of its hundred's first one
and its own later turns.  A node of the trie is a distinct sequence of first
turns; its key is a digest that every row gets from a running exclusive-or over
the hashes of (position, turn), so that neither texts nor sequences are
shuffled and a conversation of any length is scanned in ranges.

What a subtree holds is summed up by doubling: after round k a node has the
sums of all below it less than 2^k steps away and points to its ancestor 2^k
steps up.  A round adds each node's sums to that ancestor's and doubles the
pointer, so a trie of depth d takes log2 d rounds.  Pointers that would leave
the trie end, so the root is never a join's key.

Defined cases: null roles and texts are empty; rows with a null conv_id take
no part; turns that are equal in number come in the order of their digests;
repeated rows are turns of their own; a conversation of which nothing is left
ends at the root; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rangescan import running

from .common import discard, remainder, shuffle_partitions, text_or_empty, tidy, written

#: Conversations of one hundred share the first turns of its first one, fewer than so many of them.
HUNDRED, MOST_SHARED = 100, 6
ROOT = "root"
#: Ids whose digits make one row on their way to the hash of a node's ends.
IDS_A_ROW = 4096


def _word(digest: Column, k: int) -> Column:
    """64 bits of a digest in hexadecimal digits, as a signed number."""
    return F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): the turns in order, places from 1."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = written(rows, "trie-turns").withColumn("row", F.monotonically_increasing_id())
    return running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest", "row"], {"place": ("sum", F.lit(1).cast("long"))}).select("conv_id", "place", "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, place, digest, chars), and every conversation (conv_id)."""
    turns = written(_turns(conversations), "trie-placed")
    shared, hundred = remainder("conv_id", MOST_SHARED), F.col("conv_id") - F.col("conv_id") % HUNDRED
    heads = turns.filter((F.col("place") < MOST_SHARED) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "hundred")
    heads = written(heads, "trie-heads")
    have = heads.groupBy("hundred").agg(F.max("place").alias("have"))
    convs = written(turns.select("conv_id").distinct().select("conv_id", shared.alias("shared"), hundred.alias("hundred")), "trie-conversations")
    first = convs.join(heads, "hundred").filter("place <= shared").select("conv_id", "place", "digest", "chars")
    later = turns.withColumns({"shared": shared, "hundred": hundred}).filter("place > shared").join(written(have, "trie-have"), "hundred", "left")
    place = F.col("place") - F.col("shared") + F.least("shared", F.coalesce("have", F.lit(0)))
    return first.unionByName(later.select("conv_id", place.alias("place"), "digest", "chars")), convs


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.when(depth == 0, ROOT).otherwise(F.concat_ws("-", depth.cast("string"), F.hex(a), F.hex(b)))


def members(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars): each rebuilt turn with the keys of its node and of the one before."""
    mixed = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    rows = rows.select("conv_id", "place", "chars", _word(mixed, 0).alias("a"), _word(mixed, 1).alias("b"))
    run = running(rows, ["conv_id"], ["place"], {"xa": ("xor", F.col("a")), "xb": ("xor", F.col("b"))})
    node = _key(F.col("place"), F.col("xa"), F.col("xb"))
    parent = _key(F.col("place") - 1, F.col("xa").bitwiseXOR(F.col("a")), F.col("xb").bitwiseXOR(F.col("b")))
    return run.select("conv_id", F.col("place").alias("depth"), node.alias("node"), parent.alias("parent"), "chars")


def roll_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(node, *sums): the columns summed over each node's subtree, itself included.

    nodes: (node, parent, depth, *sums), the root with a null parent and depth 0.
    """
    state = written(nodes.select("node", F.col("parent").alias("up"), "depth", *sums), "trie-state")
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        more = written(state.filter("up IS NOT NULL").groupBy("up").agg(*[F.sum(c).alias(f"more_{c}") for c in sums]).withColumnRenamed("up", "node"), "trie-more")
        # whose ancestor twice as far up is neither the root nor beyond it has to look it up
        far = state.filter(F.col("depth") > 2 * step).select("node", "up")
        doubled = written(far.join(state.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", "upper"), "trie-pointers")
        joined = state.join(more, "node", "left").join(doubled, "node", "left")
        up = F.when(F.col("depth") == 2 * step, ROOT).otherwise(F.col("upper"))
        following = written(joined.select("node", up.alias("up"), "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]), "trie-state")
        for table in (state, more, doubled):
            discard(table)
        state, step = following, 2 * step
    return state.select("node", *sums)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first, ids) of at most IDS_A_ROW ids, of rows (node, conv_id) that are sorted."""
    node, ids = None, []
    for batch in batches:
        out = []
        for n, i in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (n != node or len(ids) == IDS_A_ROW):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(i)
        yield _batch(out, ("node", "first", "ids"), (pa.string(), pa.int64(), pa.string()))
    if ids:
        yield _batch([(node, ids[0], ",".join(map(str, ids)))], ("node", "first", "ids"), (pa.string(), pa.int64(), pa.string()))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of sorted rows of joined ids: a hash is fed row by row, so a node's ids are never held together."""
    node, state = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if state is not None and n == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        yield _batch(out, ("node", "ends_sha256"), (pa.string(), pa.string()))
    if state is not None:
        yield _batch([(node, state.hexdigest())], ("node", "ends_sha256"), (pa.string(), pa.string()))


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): ids joined in ranges first, so that of a node at which very many end few rows meet."""
    n = shuffle_partitions(ends.sparkSession)
    joined = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(tidy(_joined_ids), "node string, first long, ids string")
    return joined.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(tidy(_hashed_ids), "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(conversations)
    placed = written(members(written(rows, "trie-rebuilt")), "trie-members")
    total, least = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    first_nodes = placed.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"))
    root = conversations.sparkSession.createDataFrame([(ROOT, None, 0, least, total, 0)] if total else [], first_nodes.schema)
    nodes = written(first_nodes.unionByName(root), "trie-nodes")
    children = written(nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    nodes_with = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    sums = written(nodes_with.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved), "trie-own")
    rolled = roll_up(sums, ["n_leaves", "saved_tokens"])
    last = placed.groupBy("conv_id").agg(F.max_by("node", "depth").alias("last"))
    ends = written(convs.join(last, "conv_id", "left").select(F.coalesce("last", F.lit(ROOT)).alias("node"), "conv_id"), "trie-ends")
    hashes = written(_end_hashes(ends), "trie-end-hashes")
    below = nodes.filter("depth > 1").select("node", F.col("parent").alias("above"))
    above = written(below.join(nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id")), "above").select("node", "parent_conv_id"), "trie-above")
    out = nodes_with.join(rolled, "node").join(hashes, "node", "left").join(above, "node", "left")
    parent = F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id"))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
