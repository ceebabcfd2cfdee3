"""Shared plumbing of the training-data operators.

Intermediate results that are read more than once, or that end a long lineage,
are written as Parquet tables under ``spark.checkpoint.dir``: every executor
sees them, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and normal-form definitions.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows a side may have to be broadcast; each is a key of 8 bytes (about 32 MB as a hashed relation).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir().rstrip("/") + "/lodestone-checkpoints"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


#: Paths of the tables that this process has written and not deleted.
_paths: set[str] = set()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cut lineage, stable rows."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    _paths.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _paths.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing lazy reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that operators have written in this process: for callers that have used or stored their results."""
    for path in list(_paths):
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of results that nothing refers to any more, between large steps."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds: 2,000 rows or 32 MB, whichever is less."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer takes df to have: of files those on disk; 0 where it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def broadcast_if_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the (written) table is counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    """The text as a string; null is the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def _give_back() -> None:
    """Return freed memory to the system: workers are used again, and an executor's limit holds for all of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep_freed(most: int = 64 << 20) -> None:
    """Let this process keep so much freed memory for the next arrays, until _give_back: taking pages from the system anew can cost more than the arithmetic on them."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: smaller arrays come from the heap
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches that gives its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(tidy(run), schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding it; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less columns whose names clash with the ones an operator adds (case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken])
