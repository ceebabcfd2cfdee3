"""Words of UTF-8 text and hashes of their runs, for whole batches of texts at a time, on numpy.

A word is a run of bytes that are no ASCII white space.  Words and runs of
words are named by 64-bit hashes; equal runs have equal hashes wherever they
stand, and different ones meet with a probability of about 2 ** -64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC4CEB9FE1A85EC53))
#: Keeps the low bytes of a lane of eight.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes up to which a word is hashed side by side with others.
_SHORT = 64


@dataclass(frozen=True)
class Texts:
    """Texts one after the other: their bytes, where each begins (and the last ends), and columns beside them."""

    data: np.ndarray
    offsets: np.ndarray
    columns: tuple[np.ndarray, ...] = ()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def texts_of_column(column: pa.Array) -> Texts:
    """A string or binary column without nulls."""
    data, at = _buffers(column)
    return Texts(data[at[0] : at[-1]], at - at[0])


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[Texts]:
    """Batches whose last column is text (no nulls), the others integers, as chunks of about most_bytes of text and at least one row."""
    held: list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]] = []
    size = 0

    def out() -> Texts:
        lengths = np.concatenate([np.diff(at) for _, at, _ in held])
        columns = tuple(np.concatenate(c) for c in zip(*(c for _, _, c in held), strict=True))
        return Texts(np.concatenate([d for d, _, _ in held]), np.concatenate(([0], np.cumsum(lengths))), columns)

    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = _buffers(batch.column(batch.num_columns - 1))
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most_bytes - size, side="right")) - 1)
            held.append((data[at[row] : at[end]].copy(), at[row : end + 1] - at[row], tuple(c[row:end].copy() for c in columns)))
            size += int(at[end] - at[row])
            row = end
            if size >= most_bytes or row < batch.num_rows:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of all words, and the number of words of each text."""
    data, offsets = texts.data, texts.offsets
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]  # words do not go on in the next text
    at = offsets[:-1][full]
    begins[at] = inside[at]
    at = offsets[1:][full] - 1
    ends[at] = inside[at]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(first, offsets))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, taken in lanes of eight."""
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[: len(data)] = data
    aligned = padded.view(np.uint64)

    def lane(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        low = aligned[block] >> shift
        high = (aligned[block + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (low | high) & _LOW[np.minimum(size, 8)]

    size = end - first
    out = _mixed(lane(first, size) ^ (size.astype(np.uint64) * _A))
    rest = np.flatnonzero((size > 8) & (size <= _SHORT))
    done = 8
    while len(rest):
        out[rest] = _mixed(out[rest] * _A + lane(first[rest] + done, size[rest] - done))
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[first[i] : end[i]].data, 7)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run of words that are one named a and one named b after it."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


class Runs:
    """Hashes of all runs of n words, for any n, from those of runs half as long."""

    def __init__(self, words: np.ndarray):
        self._powers = [words]

    def _power(self, k: int) -> np.ndarray:
        while len(self._powers) <= k:
            half, before = 1 << (len(self._powers) - 1), self._powers[-1]
            self._powers.append(joined(before[: max(0, len(before) - half)], before[half:]))
        return self._powers[k]

    def of(self, n: int) -> np.ndarray:
        count, out, at = max(0, len(self._powers[0]) - n + 1), None, 0
        for k in range(n.bit_length() - 1, -1, -1):
            if n >> k & 1:
                part = self._power(k)[at : at + count]
                out = part if out is None else joined(out, part)
                at += 1 << k
        return out


def smallest(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes, the position of the smallest (the last of equal ones)."""
    count = len(hashes) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best, back = hashes[span - 1 :].copy(), np.full(count, span - 1, np.int8)
    for k in range(span - 2, -1, -1):
        other = hashes[k : k + count]
        less = other < best
        np.copyto(best, other, where=less)
        np.copyto(back, np.int8(k), where=less)
    return np.arange(count) + back
