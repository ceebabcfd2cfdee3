"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Pieces are range-sorted by length and gaps by size, in one order from the
largest down.  A round sweeps it: a piece takes the last gap before it that is
free, which is its successor, the smallest gap that holds it; where several
want one gap the longest comes first, by rank.  Each gap takes one piece a
round.  Ranges are swept apart, and what they leave is swept together: as
pieces and gaps pair like brackets, that is the sweep of the whole order.
Then gaps are updated and the next round begins; where nothing fits, as many
sequences are opened as the rest needs at least.

Pieces of one length are interchangeable, and so are gaps of one size, so the
tables hold runs of them: (length, first rank, count) and (size, first
sequence, count).  There are at most ``capacity`` lengths and a few runs for
each, however large the corpus.  The driver sees two counters a round.  All
that grows with the corpus is tokenizing, counting lengths, ranking pieces
within their length (from the counts of each task, so that a length with a
third of all pieces is never gathered) and looking up each piece's rank.

Defined cases: null and empty texts are a single end id; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, quoted, small_batches, text_or_empty, tidy, written
from .tokens import BYTE_LEVEL, encoder, public_path

CAPACITY = 1024
END_ID = 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, and the first piece takes the remainder."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): rank counts the pieces of one length within a task."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows_at in range(0, batch.num_rows, 1000):  # few texts and ids are held at once, not a whole batch
                ids_col, texts = batch.slice(rows_at, 1000).columns
                rows, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(encoder(path, BYTE_LEVEL).encode(texts.to_pylist(), end_id)):
                    for k, (at, size) in enumerate(cut(len(ids), capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[at : at + size]))
                        rank.append(ranks[size])
                        ranks[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids_col.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(rows), part), pa.int32()), pa.array(rank, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"],
                )
        encoder(path, BYTE_LEVEL).rest()

    texts = docs.select(quoted(id_col), text_or_empty(quoted(text_col)).alias("t"))
    return texts.mapInArrow(tidy(run), f"{quoted(id_col)} {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


#: Kinds of rows: gaps and pieces that a round sweeps, and what it makes: gaps of the next round and placed pieces.
GAP, PIECE, NEXT, PLACED = range(4)
#: Columns of runs; a placed run's number is its first rank, its sequence and offset where it goes.
RUN = "kind int, value long, number long, n long, sequence long, offset long"
#: Ranges that a round sweeps side by side.
RANGES = 8


def swept(rows: Iterable[tuple[int, ...]], capacity: int) -> Iterator[tuple[int, ...]]:
    """One sweep over runs in order of falling value, gaps before pieces of their size."""
    free: list[tuple[int, int, int]] = []
    for kind, value, number, n, sequence, offset in rows:
        if kind == GAP:
            free.append((value, number, n))
        elif kind == PIECE:
            while n and free:
                size, first, count = free.pop()
                took = min(n, count)
                yield PLACED, value, number, took, first, capacity - size
                if size > value:
                    yield NEXT, size - value, first, took, 0, 0
                if took < count:
                    free.append((size, first + took, count - took))
                number, n = number + took, n - took
            if n:
                yield PIECE, value, number, n, 0, 0
        else:
            yield kind, value, number, n, sequence, offset
    for value, number, n in free:
        yield GAP, value, number, n, 0, 0


def _order(row: tuple[int, ...]) -> tuple[int, ...]:
    return -row[1], row[0], row[2]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where each length's ranks go, up to the next row's first rank; by the same rounds, in memory."""
    rows = [(PIECE, n, 0, c, 0, 0) for n, c in counts.items() if c]
    sequences, out = 0, []
    opened = sum(c for n, c in counts.items() if 2 * n > capacity) or -(-sum(n * c for n, c in counts.items()) // capacity)  # no two of the first fit one sequence
    while any(r[0] == PIECE for r in rows):
        if opened:
            rows.append((GAP, capacity, sequences, opened, 0, 0))
            sequences += opened
        made = list(swept(sorted(rows, key=_order), capacity))
        placed = [r for r in made if r[0] == PLACED]
        out += [(r[1], r[2], r[4], r[5]) for r in placed]
        rows = [(GAP, *r[1:]) if r[0] == NEXT else r for r in made if r[0] != PLACED]
        opened = 0 if placed else -(-sum(r[1] * r[3] for r in rows if r[0] == PIECE) // capacity)
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def placed_runs(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """The same from (length, n), a round at a time on tables: (value, number, n, sequence, offset) of every run that is placed."""
    spark = counts.sparkSession

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = list(swept(rows, capacity))
        if made:
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["kind", "value", "number", "n", "sequence", "offset"])

    none = F.lit(0).cast("long")
    state = written(counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("value"), none.alias("number"), F.col("n"), none.alias("sequence"), none.alias("offset")), "pack-round")
    tables, sequences = [], 0
    tokens, waiting, long = state.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("value") * F.col("n"), F.col("n"), F.when(F.col("value") * 2 > capacity, F.col("n")))]).first()
    opened = long or -(-tokens // capacity)  # no two of the long ones fit one sequence
    order = [F.col("value").desc(), F.col("kind"), F.col("number")]
    while waiting:
        rows = state.filter(F.col("kind") != PLACED).withColumn("kind", F.when(F.col("kind") == NEXT, GAP).otherwise(F.col("kind")))
        if opened:
            rows = rows.unionByName(spark.createDataFrame([(GAP, capacity, sequences, opened, 0, 0)], RUN))
            sequences += opened
        local = rows.repartitionByRange(ranges, F.col("value").desc()).sortWithinPartitions(*order).mapInArrow(tidy(sweep), RUN)
        # what the ranges leave: a few runs for each length and size, whatever the corpus
        state = written(local.repartition(1).sortWithinPartitions(*order).mapInArrow(tidy(sweep), RUN), "pack-round")
        tables.append(state)
        piece = F.col("kind") == PIECE
        tokens, placed, waiting = state.agg(*[F.coalesce(F.sum(F.when(c, v)), F.lit(0)) for c, v in ((piece, F.col("value") * F.col("n")), (F.col("kind") == PLACED, F.col("n")), (piece, F.col("n")))]).first()
        opened = 0 if placed else -(-tokens // capacity)
    if not tables:
        return state.filter("false").drop("kind")
    paths = [t._lodestone_path for t in tables]
    found = written(spark.read.schema(state.schema).parquet(*paths).filter(F.col("kind") == PLACED).drop("kind"), "pack-plan")
    for t in tables:
        discard(t)
    return found


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cutup = written(pieces(docs, id_col, text_col, tokenizer or public_path("byte_bpe_50k.json"), end_id, capacity), "pack-pieces")
    per_task = written(cutup.groupBy("part", "length").count(), "pack-counts")
    runs = placed_runs(per_task.groupBy("length").agg(F.sum("count").alias("n")), capacity)
    found = runs.select("value", "number", "sequence", "offset").orderBy("value", "number").toArrow()  # a few rows for each length
    table = spark.sparkContext.broadcast(np.stack([found.column(k).to_numpy() for k in range(4)], axis=1) if found.num_rows else np.empty((0, 4), np.int64))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # as many rows as tasks times lengths: joined by shuffle, as that grows with the corpus
    ranked = cutup.join(bases.hint("merge"), ["part", "length"]).select(quoted(id_col), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def look_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = table.value
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        key = lambda n, r: n * (1 << 48) + r  # noqa: E731  a length's ranks stay below 2 ** 48
        at = np.searchsorted(key(rows[:, 0], rows[:, 1]), key(length, rank), side="right") - 1
        place = rows[at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(place[:, 2] + rank - place[:, 1]), pa.array(place[:, 3])], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(ranked, look_up, f"{quoted(id_col)} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
