"""Vectorised text kernels for Arrow batches: whole texts as bytes, words as positions, hashes as arrays.

Texts are UTF-8, and all separators and case rules are ASCII, so work on bytes equals work on code points.
A null text is an empty one. Rows are taken in chunks of half a megabyte; one longer text is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64


def texts(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of chunks of rows that have about ``chunk`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + chunk, "right")) - 1)
        yield row, off[row : end + 1] - off[row], data[off[row] : off[end]]
        row = end


def byte_table(separators) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin (one more than texts)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~is_separator[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begin[first] = word[first]
    stop[last] = word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: A random odd value for each byte.
LETTERS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte segment, by a polynomial over random letter values."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    power = np.multiply.accumulate(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, U))
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    at = np.arange(len(base)) + base
    value = LETTERS[data[at]] * power[at - np.repeat(starts, size)]
    total = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
    return mix(total + size.astype(U) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in text order, and where each text's shingles begin.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    count = np.diff(bounds)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_bounds = np.concatenate(([0], np.cumsum(many)))
    if not out_bounds[-1]:
        return np.zeros(0, U), out_bounds
    factor = [U(0x9E3779B97F4A7C15 ^ (0x632BE59BD9B4E019 * (k + 1) & 0xFFFFFFFFFFFFFFFF) | 1) for k in range(n)]
    text = np.repeat(np.arange(len(count)), many)
    at = bounds[:-1][text] + (np.arange(out_bounds[-1]) - out_bounds[:-1][text])
    size = np.minimum(count[text], n)
    total = size.astype(U) * U(0xD6E8FEB86659FD93)
    padded = np.concatenate((words, np.zeros(n, U)))
    for k in range(n):
        total += np.where(k < size, mix(padded[at + k] + U(k + 1)) * factor[k], U(0))
    return mix(total), out_bounds


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
