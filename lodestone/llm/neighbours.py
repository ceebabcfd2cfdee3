"""Nearest vectors by learned partitions.

A bounded sample gives a neighbour graph, its balanced parts and two small
classifiers (partition_router).  Then every vector goes to one part, every
query to its most probable parts, and packs of vectors meet packs of queries
of the same part for exact inner products.

Equal vectors are one candidate with its smallest ids, and one query whose
result is dealt out to all that ask it, so copies cost nothing.  A part that
holds more than others is dealt over more slabs, which its queries visit all;
packs have a bounded size, so a task never holds a part.

Defined cases: a vector takes no part if it or its id is null, if it is zero
or empty, if it holds a null or a number that is not finite, or if it is not
as long as most vectors are (the shorter of equally many); rows with the
query's own id are the query's own; rows repeated with the same id and vector
count once, an id repeated with another vector is a candidate with each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, tidy, written
from .partition_router import Router, fit

#: Rows of the sample that the classifiers are fitted to, and its numbers at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 8192, 8_000_000
#: Parts: a power of two near the root of the number of vectors over PART_ROOT, at least and at most so many.
PART_ROOT, LEAST_PARTS, MOST_PARTS = 16, 4, 128
#: Vectors of a slab, of a pack and queries of a pack.
SLAB_ROWS, PACK_ROWS, QUERY_ROWS = 65_536, 4096, 1024
#: Bytes of a pack's vectors at most.
PACK_BYTES = 4 << 20
#: Packs of queries whose best a task holds for the slab at hand.
HELD_PACKS = 64
#: Candidates ranked again beside the k wanted, as products of blocks are rounded differently.
SPARE = 4
_PACK = "part int, n int, counts binary, ids binary, vectors binary"
_QUERIES = "part int, n int, keys binary, vectors binary"
KEY_BYTES = 32


def n_parts(n: int) -> int:
    root = max(1.0, np.sqrt(max(n, 1)) / PART_ROOT)
    return int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** round(np.log2(root)))))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of those that take part, as doubles or, where they were, as floats."""
    kind = dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>" if kind == "array<float>" else "array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(~bad & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (size.d if size else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packs(router: Router, d: int, kind: type, rows: int):
    """Vectors with their ids, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(p: int) -> pa.RecordBatch:
            counts, ids, vectors = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            return pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(counts)], pa.int32()), "counts": [counts.tobytes()], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vector"], d).astype(kind)
            lists = batch["ids"]
            ids, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            part = router.part(x)
            for p in np.unique(part).tolist():
                mine = np.nonzero(part == p)[0]
                for at in range(0, len(mine), rows):
                    some = mine[at : at + rows]
                    counts = (ends[some + 1] - ends[some]).astype(np.int32)
                    own = np.concatenate([ids[ends[i] : ends[i + 1]] for i in some])
                    if p in held and sum(len(c) for c, _, _ in held[p]) + len(some) > rows:
                        yield packed(p)
                    held.setdefault(p, []).append((counts, own.astype(np.int64), x[some]))
        for p in list(held):
            yield packed(p)

    return tidy(run)


def _query_packs(router: Router, d: int, kind: type, rows: int):
    """Queries' keys and vectors, packed by each part they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vector"], d).astype(kind)
            keys = np.frombuffer(b"".join(batch["key"].to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
            probes = router.probes(x)
            for p in range(router.n_parts):
                mine = np.nonzero(probes[:, p])[0]
                for at in range(0, len(mine), rows):
                    some = mine[at : at + rows]
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(some)], pa.int32()), "keys": [keys[some].tobytes()], "vectors": [x[some].tobytes()]})

    return tidy(run)


def best_of_pack(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact inner products, in double precision, of each query's k best vectors of a pack and some more."""
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    k = min(k + SPARE, len(x))
    near = q @ x.T
    place = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(k), (len(q), k))
    return place, (q[:, None, :] * x[place]).sum(axis=2)


def _listed(place: np.ndarray, score: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row a query of ids and their scores: each chosen vector's ids, filled up with scores of minus infinity."""
    times = counts[place]
    total = times.sum(axis=1)
    flat = times.ravel()
    offset = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
    starts = (np.cumsum(counts) - counts)[place].ravel()
    owner = np.repeat(np.arange(len(place)), total)
    column = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    out_ids, out_scores = np.zeros((len(place), total.max()), np.int64), np.full((len(place), total.max()), -np.inf)
    out_ids[owner, column] = ids[np.repeat(starts, flat) + offset]
    out_scores[owner, column] = np.repeat(score.ravel(), flat)
    return out_ids, out_scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by score and then id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _rerank(d: int, kind: type, k: int):
    """(key, vec_id, score) of packs of vectors met by packs of queries; what one slab's packs give a query is merged before it leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        slab = None

        def passed_on() -> Iterator[pa.RecordBatch]:
            for keys, (ids, scores) in held.items():
                row, column = np.nonzero(scores > -np.inf)
                names = pa.array([keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)], pa.binary())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(ids[row, column]), pa.array(scores[row, column])], names=["key", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for row, here in enumerate(zip(batch["part"].to_pylist(), batch["slab"].to_pylist(), strict=True)):
                if here != slab or len(held) > HELD_PACKS:
                    yield from passed_on()
                    slab = here
                value = lambda name, row=row, batch=batch: batch[name][row].as_buffer()
                queries = np.frombuffer(value("query_vectors"), kind).reshape(-1, d)
                vectors = np.frombuffer(value("vectors"), kind).reshape(-1, d)
                found = _listed(*best_of_pack(queries, vectors, k), np.frombuffer(value("counts"), np.int32), np.frombuffer(value("ids"), np.int64))
                keys = batch["keys"][row].as_py()
                if keys in held:
                    found = tuple(np.hstack(x) for x in zip(held[keys], found, strict=True))
                held[keys] = _best(*found, k)
        yield from passed_on()

    return tidy(run)


def nearest_vectors(vectors: DataFrame, asks: Column | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each row for which ``asks`` holds (a condition on vec_id; all by default)."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    keyed = valid(vectors, id_col, vector_col).withColumn("key", F.unhex(F.sha2(F.col("vector").cast("string").cast("binary"), 256)))
    keyed = written(keyed, "vectors")
    smallest = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    few = keyed.withColumn("r", smallest).filter(F.col("r") <= k + 1)
    distinct = written(few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors-distinct")
    asked = keyed.filter(F.lit(True) if asks is None else asks)
    askers = written(asked.select("key", F.col("vec_id").alias("query_id")).distinct(), "vectors-askers")
    asking = written(asked.groupBy("key").agg(F.first("vector").alias("vector")), "vectors-asking")

    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, longest, d = distinct.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = distinct.select("key", "vector").orderBy("key").limit(max(64, min(SAMPLE_ROWS, SAMPLE_NUMBERS // d)))
    router = fit(np.array([r.vector for r in sampled.collect()], np.float64), longest, n_parts(n), k)

    rows = max(64, min(PACK_ROWS, PACK_BYTES // (d * np.dtype(kind).itemsize)))
    packs = written(distinct.select("ids", "vector").mapInArrow(_packs(router, d, kind, rows), _PACK), "vectors-packs")
    sizes = {r.part: r.n for r in packs.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a part
    slabs = F.element_at(F.create_map(*[F.lit(x) for p in range(router.n_parts) for x in (p, -(-sizes.get(p, 0) // SLAB_ROWS) or 1)]), F.col("part"))
    dealt = packs.withColumn("slab", F.pmod(F.xxhash64("ids"), slabs))
    queries = asking.mapInArrow(_query_packs(router, d, kind, min(rows, QUERY_ROWS)), _QUERIES)
    queries = written(queries, "vectors-queries").select("part", "keys", F.col("vectors").alias("query_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), (slabs - 1).cast("long"))).alias("slab"))
    met = dealt.join(queries, ["part", "slab"]).select("part", "slab", "keys", "query_vectors", "counts", "ids", "vectors")
    scored = met.mapInArrow(_rerank(d, kind, k + 1), "key binary, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    found = written(scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1), "vectors-found")
    discard(distinct)
    lists = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))).alias("found"))
    lists = written(lists, "vectors-lists")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    dealt_out = askers.join(lists, "key").select("query_id", F.posexplode(others).alias("at", "x"))
    return dealt_out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))

