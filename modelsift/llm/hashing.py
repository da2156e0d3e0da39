"""Words, shingles and character n-grams of whole texts as 64-bit hashes, by numpy over Arrow's bytes.

Texts are handled in chunks of about a megabyte (a longer text is a chunk of its own), so memory is
bounded by the longest text. Nothing here is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i up to n, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (BASE, INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 4 * CHUNK_BYTES:  # of one very long text: not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Bytes of the texts of some rows, one after the other; row i has bytes offsets[i] to offsets[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """The texts in order; null as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(start + 1, end))
        yield Chunk(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def letters_lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case (ASCII and the Latin letters of two bytes that begin with C3), and which bytes are letters."""
    low = ascii_lower(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 32, low).astype(np.uint8)
    return low, ((low >= 97) & (low <= 122)) | (low >= 0x80)


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: all but the space and the controls 9 to 13."""
    return (data != 32) & ((data < 9) | (data > 13))


class Prefixes:
    """Hashes of any byte ranges of a chunk, from one running sum."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


@dataclass
class Runs:
    """Runs of marked bytes (words), none of which crosses a row."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # row i has the runs bounds[i] to bounds[i + 1]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(marked: np.ndarray, offsets: np.ndarray) -> Runs:
    n = len(marked)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = marked[:-1], marked[1:]
    starts = np.flatnonzero(marked & (~before | edge[:n]))
    ends = np.flatnonzero(marked & (~after | edge[1:])) + 1
    return Runs(starts, ends, np.searchsorted(starts, offsets))


def sequence_hashes(h: np.ndarray, width: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every width neighbouring values within a row, and the bounds of the rows' hashes."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total += h[first + k] * np.uint64((2 * k + 1) * BASE % (1 << 64))
    return mixed(total), out_bounds
