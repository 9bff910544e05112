"""Hashes of words and of runs of words for whole Arrow batches of texts, in numpy, and the packed rows in
which large numbers of such hashes are shuffled.

Texts are cut into words at ASCII white space. A word's 64-bit hash sums a fixed random number per byte value
times a fixed random odd number per place; runs of words combine their hashes in the same way. Nothing
here depends on the machine, the task or the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the binary column has about ``most_bytes`` in each; one longer row stands alone."""
    for batch in batches:
        offsets = _offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Words:
    """The words of a binary Arrow column: hash, place in the bytes and row of each; words of a row are
    together, rows in order. A null has none."""

    def __init__(self, column: pa.Array, fold_case: bool = False):
        offsets = _offsets(column)
        self.rows = len(column)
        data = column.buffers()[2]
        # one more place, which holds a space, ends the last word
        self.bytes = np.full(int(offsets[-1] - offsets[0]) + 1, 32, np.uint8)
        if data is not None:
            self.bytes[:-1] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        inside = ~_IS_SPACE[self.bytes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = bounds[:-1][bounds[:-1] < bounds[1:]]  # a row's first byte begins a word, whatever ended the row before
        first[cut] = inside[cut]
        self.start = np.flatnonzero(first)
        used = np.flatnonzero(inside)
        self.first = np.searchsorted(self.start, bounds)  # the first word of each row, and the number of words
        self.count = np.diff(self.first)
        of = np.searchsorted(used, self.start)
        self.length = np.diff(np.append(of, len(used)))
        if len(self.start):
            place = np.arange(len(used)) - np.repeat(of, self.length)
            table = _BYTE_FOLDED if fold_case else _BYTE
            factors = _PLACE[place % 64]
            far = np.flatnonzero(place >= 64)
            if len(far):
                factors[far] = scramble(factors[far] + (place[far] // 64).astype(np.uint64) * _STEP) | np.uint64(1)
            self.hash = scramble(np.add.reduceat(table[self.bytes[used]] * factors, of) + self.length.astype(np.uint64) * _STEP)
        else:
            self.hash = np.zeros(0, np.uint64)

    def runs(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on; of no meaning where they leave the row."""
        n = len(self.hash)
        total = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            total[: n - k] += self.hash[k:] * _PLACE[k]
        return scramble(total + np.uint64(size * int(_STEP) % 2**64))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def run_starts(self, size: int) -> np.ndarray:
        """The words from which ``size`` words of the same row follow."""
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.count)
        return np.flatnonzero(place + size <= np.repeat(self.count, self.count))


def packed6(keys: np.ndarray) -> bytes:
    """The lower 48 bits of each number."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
