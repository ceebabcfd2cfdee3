"""Removal of passages that repeat across documents, by a compressed FM-index per shard.

Shards are cut by content, so that a passage meets all its copies in one
shard and the work grows with the corpus and not with its square: every window
of words has a minimizer (the smallest hash of its runs of GRAM_WORDS words),
consecutive windows with the same one are a segment, and equal windows are in
segments of equal minimizers wherever they stand.

1. Minimizers that only one document holds can repeat nowhere else.  The others
   are found by ranges of their hashes, each chunk of texts sending its distinct
   ones as five sorted bytes each, and reach the texts as a bitmap.  Its size
   follows their number up to a bound; a full one lets more through, never less.
2. Each chunk of texts makes its segments distinct, with their least document
   id, before they move: a passage, however frequent, is one entry a chunk.
   Minimizers with very many segments (a common phrase between ever different
   words) are split: each of their windows is a segment of its own, routed by
   all of its words, so that no key's segments outgrow a task.
3. Each task indexes its distinct segments shard by shard (see ``fm_index``)
   and streams them through backward search.  Where the matching statistic
   reaches the window, the least id of the suffixes in its interval is the
   window's first document.
4. The answers go back to the chunk they came from, which holds the places of
   its segments; windows first seen in a smaller id are spans to remove.

Only step 2's segments and the last join move words.

Defined cases: null and empty texts have no words; a null id neither removes
nor is removed from; rows repeated with one id do not remove each other; ids
must be integers (anything else is refused); an empty table gives an empty
result.  One text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, quoted, release, shuffle_partitions, small_batches, text_or_empty, texts_of, tidy, written
from .fm_index import FMIndex
from .wordhash import Runs, Texts, chunks, joined, smallest, texts_of_column, word_hashes, word_spans

WINDOW_WORDS = 13
GRAM_WORDS = 8
#: Words of one FM-index, a few more where one key's segments end.
SHARD_WORDS = 100_000
#: Bytes of text that are cut into segments at a time.
CHUNK_BYTES = 4 << 20
#: Bits of the bitmap of shared minimizers: so many for each of them, and at most so many (64 MB).
BITS_EACH, MOST_BITS = 32, 1 << 29
#: Bits of the bitmap of minimizers that are split (512 KB), and the occurrences from which one is.
HOT_BITS, HOT = 1 << 22, 8192
#: Segments that one task indexes, about.
TASK_SEGMENTS = 60_000
_SALT = np.uint64(0x5851F42D4C957F2D)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, np.int64, len(kinds))) + 8 * len(kinds)
    starts = np.concatenate(([8 * len(kinds)], ends[:-1]))
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(starts.tolist(), ends.tolist(), kinds, strict=True)]


class Cut:
    """The segments of a chunk of texts: row, first (word in the row), windows, key, and the chunk's words."""

    def __init__(self, texts: Texts, window: int, gram: int):
        self.begins, self.ends, counts = word_spans(texts)
        self.runs, self.window = Runs(word_hashes(texts.data, self.begins, self.ends)), window
        rows = np.repeat(np.arange(len(counts)), counts)
        edges = np.concatenate(([0], np.cumsum(counts)))
        place = np.arange(len(rows))
        starts = place[place + window <= edges[1:][rows]]
        at = smallest(self.runs.of(gram), window - gram + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        self.word = starts[heads]
        self.windows = np.diff(np.append(heads, len(starts)))
        self.key = self.runs.of(gram)[at[heads]]
        self.row = rows[self.word]
        self.first = self.word - edges[self.row]

    def only(self, which: np.ndarray) -> None:
        self.word, self.windows, self.key, self.row, self.first = (x[which] for x in (self.word, self.windows, self.key, self.row, self.first))

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Make each window of the hot segments a segment, its key its words; returns which ones are such."""
        if not hot.any():
            return hot
        times = np.where(hot, self.windows, 1)
        index = np.repeat(np.arange(len(hot)), times)
        step = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        hot = hot[index]
        self.word, self.first, self.row = self.word[index] + step, self.first[index] + step, self.row[index]
        self.windows = np.where(hot, 1, self.windows[index])
        self.key = np.where(hot, self.runs.of(self.window)[self.word] ^ _SALT, self.key[index])
        return hot

    def names(self) -> np.ndarray:
        """A hash of each segment's words: its first and its last window cover them all."""
        whole = self.runs.of(self.window)
        return joined(joined(whole[self.word], whole[self.word + self.windows - 1]), self.windows.astype(np.uint64))


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal rows together, where in it each group begins)."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def shared_minimizers(rows: DataFrame, window: int, gram: int, partitions: int, hot: int) -> DataFrame:
    """(p, shared, occurrences, hot) by range of hashes: five-byte names of minimizers that two chunks or two ids hold, and of frequent ones.

    A name is the 40 bits of the hash below those that say which range it is in.
    """
    bits = max(0, partitions - 1).bit_length()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, CHUNK_BYTES):
            cut = Cut(texts, window, gram)
            key = cut.key >> np.uint64(24 - bits)
            order = np.argsort(key, kind="stable")
            key, ids = key[order], texts.columns[0][cut.row[order]]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            if not len(heads):
                continue
            several = np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads)
            times = np.diff(np.append(heads, len(key)))
            key = key[heads]
            edges = np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40))
            parts = np.flatnonzero(np.diff(edges))
            blobs = []
            for p in parts.tolist():
                part = slice(edges[p], edges[p + 1])
                blobs.append(_packed((key[part] >> np.uint64(8)).astype(np.uint32), key[part].astype(np.uint8), several[part], times[part].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(blobs, pa.binary())], ["p", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(_unpacked(blob, np.uint32, np.uint8, np.bool_, np.uint32))
        for p, found in held.items():
            high, low, several, times = (np.concatenate(x) for x in zip(*found, strict=True))
            key = (high.astype(np.uint64) << np.uint64(8)) | low
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            shared = np.logical_or.reduceat(several[order], heads) | (np.diff(np.append(heads, len(key))) > 1)
            total = np.add.reduceat(times[order].astype(np.int64), heads)
            key, total = key[heads][shared], total[shared]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([key.tobytes()], pa.binary()), pa.array([key[total > hot].tobytes()], pa.binary())], ["p", "shared", "occurrences", "names", "hot"])

    sent = rows.mapInArrow(tidy(of), "p int, blob binary").repartitionById(1 << bits, F.col("p"))
    return sent.mapInArrow(tidy(merge), "p int, shared long, occurrences long, names binary, hot binary")


def _sieve(shared: DataFrame, column: str, bits: int, range_bits: int) -> np.ndarray:
    """The bitmap of the top bits of the names in a column, put together by range: each range is one slice of it."""
    most = bits.bit_length() - 1

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slices = []
        for names in batch.column(1).to_pylist():
            place = np.frombuffer(names, np.uint64) >> np.uint64(40 + range_bits - most)
            slice_ = np.zeros(max(1, (bits >> range_bits)), bool)
            slice_[place.astype(np.int64)] = True
            slices.append(np.packbits(slice_, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slices, pa.binary())], ["p", "bits"])

    out, size = np.zeros(bits // 8, np.uint8), (bits >> range_bits) // 8
    for row in map_arrow(shared.select("p", column), of, "p int, bits binary").toLocalIterator():  # bits / 8 bytes in all
        out[row["p"] * size : (row["p"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _in(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - (len(sieve) * 8).bit_length() + 1)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def least_of_windows(hashes: np.ndarray, lengths: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """The least document id of each window of each segment over all segments of a shard, one after the other; hashes: the segments' words."""
    numbers = np.unique(hashes, return_inverse=True)[1] + 1
    places = np.arange(len(numbers)) + np.repeat(np.arange(len(lengths)), lengths)  # one 0 after each segment
    symbols = np.zeros(len(numbers) + len(lengths), np.int32)
    symbols[places] = numbers
    index = FMIndex(symbols, window)
    heads = np.unique(index.bounds(window)[0])
    smallest_id = np.minimum.reduceat(np.repeat(least, lengths + 1)[index.order], heads)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    patterns = np.full((len(lengths), int(lengths.max())), -1, np.int32)
    patterns[row, column] = numbers
    counts = lengths - window + 1
    out, begin = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
    for rows, position, matched, left in index.matching_statistics(patterns, lengths):
        whole = matched == window
        out[begin[rows[whole]] + position[whole]] = smallest_id[np.searchsorted(heads, left[whole], side="right") - 1]
    return out


def index_shard(texts: list[bytes], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, the least document id of each of its windows over all segments of the shard."""
    held = texts_of_column(pa.array(texts, pa.binary()))
    first, end, counts = word_spans(held)
    found = least_of_windows(word_hashes(held.data, first, end), counts, least, window)
    return np.split(found, np.cumsum(counts - window + 1)[:-1])


def _answers(blobs: list[bytes], window: int, gram: int, shard_words: int) -> list[np.ndarray]:
    """For the segments of each blob, in order, the least ids of their windows."""
    parts = [_unpacked(b, np.uint8, np.int64, np.uint32, np.uint8) for b in blobs]
    hot, least, sizes, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    texts = Texts(text, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
    first, end, counts = word_spans(texts)
    hashes = word_hashes(text, first, end)
    runs, begin = Runs(hashes), np.cumsum(counts) - counts
    whole, grams = runs.of(window), runs.of(gram)
    windows = counts - window + 1
    key = grams[smallest(grams, window - gram + 1)[begin]]
    key = np.where(hot != 0, whole[begin] ^ _SALT, key)
    name = joined(joined(whole[begin], whole[begin + windows - 1]), windows.astype(np.uint64))
    order, heads = _same(name, key)  # by key, then by name
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    least = np.minimum.reduceat(least[order], heads)
    chosen = order[heads]
    lengths, key = counts[chosen], key[chosen]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key_heads = np.flatnonzero(new)
    until = np.cumsum(np.add.reduceat(lengths, key_heads))
    found, at = [], 0
    while at < len(key_heads):  # a shard: keys of about shard_words words, one at least
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + shard_words, side="right")))
        a, b = key_heads[at], key_heads[to] if to < len(key_heads) else len(key)
        mine, size = chosen[a:b], lengths[a:b]
        words = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        found.append(least_of_windows(hashes[words], size, least[a:b], window))
        at = to
    flat, per = np.concatenate(found), lengths - window + 1
    start = (np.cumsum(per) - per)[group]
    values = flat[np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))]
    rows = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    edges = np.concatenate(([0], np.cumsum(windows)))[rows]
    return [values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(__id, __content, spans) of documents with words in windows that a smaller id holds; spans: word ranges (a, b), merged and in order."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"document ids must be integers, not {kind}")
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty(quoted(text_col))
    rows = docs.filter(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("__id"), F.xxhash64(text).alias("__content"), text.alias("t"))
    ranges = shuffle_partitions(spark)
    range_bits = max(0, ranges - 1).bit_length()
    shared = written(shared_minimizers(rows.drop("__content"), window, gram, ranges, hot), "substring-shared")
    found, occurrences = shared.agg(F.coalesce(F.sum("shared"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    bits = min(MOST_BITS, max(1 << 20, 1 << (found * BITS_EACH).bit_length()))
    bits = max(bits, 8 << range_bits)
    sieves = spark.sparkContext.broadcast((_sieve(shared, "names", bits, range_bits), _sieve(shared, "hot", max(HOT_BITS, 8 << range_bits), range_bits)))
    discard(shared)
    release(spark)
    routes = max(ranges, -(-occurrences // TASK_SEGMENTS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        sieve, hot_sieve = sieves.value
        for texts in chunks(batches, CHUNK_BYTES):
            segments = Cut(texts, window, gram)
            segments.only(_in(sieve, segments.key))
            split = segments.split(_in(hot_sieve, segments.key))
            if not len(split):
                continue
            ids, name = texts.columns[0][segments.row], segments.names()
            route = (segments.key % np.uint64(routes)).astype(np.int32)
            order, heads = _same(name, segments.key, route)
            unique = np.empty(len(order), np.int64)
            unique[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            least, greatest = np.minimum.reduceat(ids[order], heads), np.maximum.reduceat(ids[order], heads)
            chosen = order[heads]
            a = segments.begins[segments.word[chosen]]
            b = segments.ends[segments.word[chosen] + segments.windows[chosen] + window - 2]
            out = [(-1, _packed(*texts.columns, segments.row.astype(np.uint32), segments.first.astype(np.uint32), unique.astype(np.uint32), segments.windows[chosen].astype(np.uint8), greatest))]
            edges = np.flatnonzero(np.concatenate(([True], route[chosen][1:] != route[chosen][:-1], [True])))
            whole = texts.data.tobytes()
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                joined_text = b"".join([whole[i:j] for i, j in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)])
                out.append((int(route[chosen[x]]), _packed(split[chosen[x:y]].astype(np.uint8), least[x:y], (b - a)[x:y].astype(np.uint32), np.frombuffer(joined_text, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), number)), pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["chunk", "p", "blob"])
            number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, routes_, blobs = [], [], []
        for batch in batches:
            for held, column in zip((numbers, routes_, blobs), batch.columns, strict=True):
                held.extend(column.to_pylist())
        if blobs:
            for n, p, found in zip(numbers, routes_, _answers(blobs, window, gram, shard_words), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([p], pa.int32()), pa.array([_packed(found)], pa.binary())], ["chunk", "p", "blob"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by chunk and p: a chunk's places come first."""
        chunk, places, least = None, None, []
        for batch in batches:
            for n, p, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != chunk:
                    if places is not None:
                        yield _spans_of(places, least, window)
                    chunk, places, least = n, None, []
                if p < 0:
                    places = _unpacked(blob, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.int64)
                else:
                    least.append(_unpacked(blob, np.int64)[0])
        if places is not None:
            yield _spans_of(places, least, window)

    schema = "chunk long, p int, blob binary"
    segments = written(rows.mapInArrow(tidy(cut), schema), "substring-segments")
    answers = written(segments.filter("p >= 0").repartitionById(routes, F.col("p")).mapInArrow(tidy(answer), schema), "substring-answers")
    release(spark)
    both = segments.filter("p < 0").unionByName(answers)
    found = written(both.repartition("chunk").sortWithinPartitions("chunk", "p").mapInArrow(tidy(spans), "__id long, __content long, spans array<struct<a:long,b:long>>"), "substring-spans")
    discard(segments)
    discard(answers)
    release(spark)
    return found


def _spans_of(places: list[np.ndarray], least: list[np.ndarray], window: int) -> pa.RecordBatch:
    """The spans to remove of a chunk's rows, merged: from its segments' places and the least ids of its distinct segments' windows."""
    ids, contents, row, first, unique, windows, greatest = places
    flat = np.concatenate(least)
    begin = np.cumsum(windows, dtype=np.int64) - windows
    some = (np.minimum.reduceat(flat, begin) < greatest)[unique]  # else none of its places has a greater id
    row, first, unique = row[some].astype(np.int64), first[some].astype(np.int64), unique[some]
    count = windows[unique].astype(np.int64)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row, start, value = np.repeat(row, count), np.repeat(first, count) + step, flat[np.repeat(begin[unique], count) + step]
    hit = value < ids[row]
    row, start = row[hit], start[hit]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)
    heads = np.flatnonzero(new)
    a, b = start[heads], start[np.append(heads[1:], len(row))[: len(heads)] - 1] + window
    rows, at = np.unique(row[heads], return_index=True)
    struct = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(contents[rows]), lists], ["__id", "__content", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: kept is what is left of the words, joined by one space."""
    spans = repeated_spans(docs, id_col, text_col, **options).withColumnsRenamed({"__id": "__i", "__content": "__c"})
    spans = spans.groupBy("__i", "__c").agg(F.first("spans").alias("spans"))  # repeated rows have the same
    text = text_or_empty(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(text).alias("__content"), text.alias("t"))
    joined_rows = rows.join(spans, (F.col("__id").cast("long") == F.col("__i")) & (F.col("__content") == F.col("__c")), "left").select("__id", "t", "spans")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, kept = [], [], []
        for t, removed in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words, at, left = t.split(), 0, []
            for span in removed or ():
                left.extend(words[at : span["a"]])
                at = span["b"]
            left.extend(words[at:])
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept"])

    return map_arrow(joined_rows, cut, f"{quoted(id_col)} {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept string")
