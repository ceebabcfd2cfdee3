"""Benchmark decontamination by winnowing.

From each text every window of ``WINDOW_WORDS - GRAM_WORDS + 1`` consecutive
k-grams keeps its smallest k-gram hash (Schleimer, Wilkerson and Aiken, 2003).
A span of WINDOW_WORDS words that two texts share holds one whole such window,
so both keep the same k-gram of it: joining the kept k-grams misses no shared
span of that length.  Each hit is extended in both directions, word by word,
and counts if it reaches WINDOW_WORDS.  Items with fewer words are indexed
whole under their own length.

The benchmark's k-grams reach the text scan as a bitmap of fixed size, which
lets through all true hits whatever the benchmark's size; what passes joins
the benchmark's k-grams by equality, so nothing depends on the benchmark
being small.  Rows that shuffle are hits with their few words of context.

Defined cases: null or empty texts have no words and no hits; items without
words are no windows; repeated item ids count once; repeated documents are
reported each; an empty benchmark leaves every document clean; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, quoted, small_batches, text_or_empty, texts_of, written

WINDOW_WORDS = 10
GRAM_WORDS = 5
#: Bits of the bitmap that pre-filters k-grams (4 MB).
BITMAP_BITS = 1 << 25
#: Distinct words whose hashes one task keeps at hand.
CACHE_WORDS = 300_000

#: Fixed: A-Z to lower case; other ASCII than digits and letters to a space; all else as it is.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, forgetting all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _Hashes()


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams; empty where there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + count]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def kept_grams(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of each window's smallest hash (the last of equal ones); span: k-grams in a window."""
    count = len(grams) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best, at = grams[span - 1 :].copy(), np.arange(span - 1, len(grams))
    for back in range(span - 2, -1, -1):
        other = grams[back : back + count]
        less = other < best
        best[less] = other[less]
        at[less] = np.arange(back, back + count)[less]
    return np.unique(at)


def selected(words: list[bytes], short: set[int], item: bool, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, words in the gram) of what a text keeps; short: lengths of items below the window."""
    hashes = hash_words(words)
    found = []
    if len(words) >= window:
        grams = gram_hashes(hashes, gram)
        at = kept_grams(grams, window - gram + 1)
        found.append((grams[at], at, np.full(len(at), gram)))
    for n in {len(words)} if item and len(words) < window else () if item else short:
        grams = gram_hashes(hashes, n)
        # marked, so that a whole short item never meets a k-gram of the same words
        found.append((~grams, np.arange(len(grams)), np.full(len(grams), n)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _context(words: list[bytes], at: int, n: int, window: int) -> tuple[bytes, int]:
    """Words around a gram that any window holding it can reach, and the gram's place in them."""
    first = max(0, at - (window - n)) if n < window else at
    return b" ".join(words[first : at + n + max(0, window - n)]), at - first


def _schema(id_type: str) -> str:
    return f"item {id_type}, h long, gram int, context binary, place int"


def item_grams(benchmark: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    kind = dict(benchmark.dtypes)[id_col]

    def grams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = batch.column(0), ([], [], [], [], [])
        for i, text in enumerate(texts_of(batch.column(1))):
            words = words_of(text)
            if not words:
                continue
            short = len(words) < window
            for h, at, n in zip(*(x.tolist() for x in selected(words, set(), True, window, gram)), strict=True):
                context, place = (b" ".join(words), 0) if short else _context(words, at, n, window)
                for column, value in zip(rows, (i, h, n if not short else -n, context, place), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows[0], pa.int64())), pa.array(np.array(rows[1], np.uint64).view(np.int64)), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int32())],
            ["item", "h", "gram", "context", "place"],
        )

    return map_arrow(benchmark.select(quoted(id_col), text_or_empty(quoted(text_col)).alias("t")), grams, _schema(kind)).distinct()


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size of the hashes in a column, put together in the executors and merged by words of 64 bits."""
    place = F.expr(f"pmod({column}, {bits})")
    words = hashes.select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) AS int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most bits / 64 rows, whatever the input
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def in_bitmap(hashes: np.ndarray, bitmap_words: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(bitmap_words) * 64 - 1)
    at = hashes & bits
    return (bitmap_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _extent(doc: list[bytes], at: int, item: list[bytes], place: int, n: int) -> tuple[int, int]:
    """How many words match to the left and to the right of a gram of n words."""
    left = 0
    while left < min(at, place) and doc[at - left - 1] == item[place - left - 1]:
        left += 1
    right, most = 0, min(len(doc) - at - n, len(item) - place - n)
    while right < most and doc[at + n + right] == item[place + n + right]:
        right += 1
    return left, right


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(id, __content, n_words, n_hit, spans, items) for every row.

    spans: array of (from, to) word ranges that occur in the benchmark, merged
    and in order; items: sorted distinct ids of the items they come from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = written(item_grams(benchmark, item_col, item_text_col, window, gram), "winnow-items")
    lengths = {-r[0] for r in items.filter("gram < 0").select("gram").distinct().collect()}  # fewer than the window's words
    sieve = spark.sparkContext.broadcast(bitmap(items, "h", BITMAP_BITS))
    kind = dict(docs.dtypes)[id_col]

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, per_doc = [], []
        for text in texts_of(batch.column(2)):
            words = words_of(text)
            n_words.append(len(words))
            rows = []
            hashes, places, sizes = selected(words, lengths, False, window, gram)
            hit = in_bitmap(hashes, sieve.value)
            for h, at, n in zip(hashes[hit].view(np.int64).tolist(), places[hit].tolist(), sizes[hit].tolist(), strict=True):
                context, place = _context(words, at, n, window)
                rows.append({"h": h, "at": at, "context": context, "place": place})
            per_doc.append(rows)
        grams = pa.array(per_doc, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("context", pa.binary()), ("place", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), grams], ["__id", "__content", "n_words", "grams"])

    text = text_or_empty(quoted(text_col))
    schema = f"__id {kind}, __content long, n_words long, grams array<struct<h:long,at:long,context:binary,place:int>>"
    scanned = map_arrow(docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(text).alias("__content"), text.alias("t")), scan, schema)
    scanned = written(scanned.withColumn("__row", F.monotonically_increasing_id()), "winnow-scan")

    def extend(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, first, last = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(1, 7)]
        for i, (at, doc, place, n, item, item_place) in enumerate(zip(*columns, strict=True)):
            size = abs(n)
            a, b = doc.split(), item.split()
            if a[place : place + size] != b[item_place : item_place + size]:
                continue
            left, right = _extent(a, place, b, item_place, size) if n > 0 else (0, 0)
            if n < 0 or left + size + right >= window:
                keep.append(i)
                first.append(at - left)
                last.append(at + size + right)
        index = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(7).take(index), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["__row", "item", "a", "b"])

    hits = scanned.select("__row", F.explode("grams").alias("g")).select("__row", "g.*")
    right = items.select("h", "gram", F.col("context").alias("item_context"), F.col("place").alias("item_place"), "item")
    joined = hits.join(right, "h").select("__row", "at", "context", "place", "gram", "item_context", "item_place", "item")
    spans = map_arrow(joined, extend, f"__row long, item {dict(benchmark.dtypes)[item_col]}, a long, b long")
    found = spans.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("raw"), F.array_sort(F.collect_set("item")).alias("items"))
    return (
        scanned.drop("grams").join(found, "__row", "left")
        .select(F.col("__id").alias(id_col), "__content", "n_words", merged("raw").alias("spans"), F.coalesce("items", F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>")).alias("items"))
        .withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)"))
    )


def merged(column: str):
    """Sorted spans with those that overlap or touch made one."""
    return F.expr(f"""
        aggregate(coalesce({column}, array()), cast(array() AS array<struct<a:bigint,b:bigint>>), (done, s) ->
            CASE WHEN size(done) > 0 AND element_at(done, -1).b >= s.a
                 THEN concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, s.b))))
                 ELSE concat(done, array(named_struct('a', s.a, 'b', s.b))) END)""")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a word that occurs in a benchmark window."""
    from .exact_dedup import drop_keys

    bad = contamination(docs, benchmark, id_col, text_col, **options).filter("n_hit > 0")
    bad = written(bad.select(F.col(id_col).alias("__id"), "__content").distinct(), "winnow-dropped")
    identity = {"__id": F.col(quoted(id_col)), "__content": F.xxhash64(text_or_empty(quoted(text_col)))}
    return drop_keys(docs.withColumns(identity), bad).select(*[quoted(c) for c in docs.columns])
