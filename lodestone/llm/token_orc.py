"""Token ids in ORC files.

A document is a row: its id, the shard (file) it is in, the ids before it in
that shard, its token count and its ids.  Shards are ranges of ascending
document ids and rows ascend within them.  ORC stores integers run-length
encoded, keeps a row index per ``ROW_STRIDE`` rows of each stripe and a Bloom
filter on the document id, so that readers split files by stripe and a lookup
of documents skips stripes and row groups from metadata alone.

Tokenizing runs after the range shuffle, so a text is shuffled once and ids
never.  Global starts are the shards' totals summed up: one row a shard.

Defined cases: null and empty texts have only the end id; null ids sort first;
of rows with one id the order is that of their texts' hash; an empty table
gives an empty file and result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_bytes, map_arrow, new_path, quoted, shuffle_partitions, small_batches, text_or_empty, tidy
from .tokens import WORD_LEVEL, encoder, public_path

END_ID = 1
ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Bytes of input (as stored) that a file holds the tokens of, at most about.
RANGE_BYTES = 128 << 20


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, row_stride: int = ROW_STRIDE) -> None:
    """Write the token ids of every document to ORC files at path, in ascending id order."""
    small_batches(docs.sparkSession)
    model, kind = tokenizer or public_path("word_bpe_49k.json"), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                ids = encoder(model, WORD_LEVEL).encode(texts[at : at + 1000], end_id)
                if not ids:
                    continue
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                starts = before + ends - sizes
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(np.full(len(ids), shard), pa.int32()), pa.array(starts), pa.array(sizes), lists], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    texts = docs.select(F.col(quoted(id_col)).alias("i"), text_or_empty(quoted(text_col)).alias("t"))
    ranges = max(shuffle_partitions(docs.sparkSession), -(-input_bytes(docs) // RANGE_BYTES))
    ordered = texts.repartitionByRange(ranges, "i").sortWithinPartitions("i", F.xxhash64("t"))
    rows = ordered.mapInArrow(tidy(run), f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(row_stride), "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of token files; with doc_ids, only those, by a predicate that row indexes and Bloom filters prune with."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its files: start counts the ids of all documents before it."""
    small_batches(spark)
    rows = read_tokens(spark, path)

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(offsets).astype(np.int64)
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    kind = dict(rows.dtypes)["doc_id"]
    digests = map_arrow(rows.select("doc_id", "shard", "shard_start", "ids"), digest, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = spark.read.orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return digests.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write token files to the shared folder and index them from what was written."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, **options)
    return token_index(docs.sparkSession, path)
