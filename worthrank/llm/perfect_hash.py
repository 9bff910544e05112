"""Minimal perfect hashing of 64-bit keys by levels of bit arrays (fingerprint cascades), in numpy.

At every level a key that no other key of its bucket meets in the level's array sets its bit; the others try the next level
with another hash. A key's number is the rank of its bit, so n keys get the numbers 0 to n - 1. Buckets are built apart, in
as many tasks as there are, and put together by concatenating their arrays: a lookup serves all buckets at once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key: an xor of the seed's multiple, then two rounds of multiply and shift."""
    x = keys.astype(U) + U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 0) % U(buckets)).astype(np.int64)


class PerfectHash:
    """``sizes`` and ``starts`` (buckets x levels): the length of each level's array in bits and where it begins in ``words``.
    ``ranks``: the set bits before each word."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, words: np.ndarray):
        self.sizes, self.starts, self.words = sizes, starts, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    @staticmethod
    def build(keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """Of distinct keys, as one bucket."""
        sizes, arrays, level = [], [], 0
        while len(keys):
            size = max(64, -(-int(gamma * len(keys)) // 64) * 64)
            at = (mix(keys, level + 1) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys, level = keys[~alone[at]], level + 1
            if level > 200:
                raise ValueError("keys repeat")
        total = np.cumsum([0, *sizes])
        return PerfectHash(np.array([sizes or [0]], np.int64), np.array([total[:-1] if sizes else [0]], np.int64),
                           np.concatenate(arrays) if arrays else np.zeros(0, U))

    @staticmethod
    def join(parts: dict[int, PerfectHash], buckets: int) -> PerfectHash:
        """One function over the buckets given; keys of other buckets are not found. Numbers follow the order of ``parts``."""
        levels = max([p.sizes.shape[1] for p in parts.values()], default=1)
        sizes, starts = np.zeros((buckets, levels), np.int64), np.zeros((buckets, levels), np.int64)
        at = 0
        for g, p in parts.items():
            own = p.sizes.shape[1]
            sizes[g, :own], starts[g, :own] = p.sizes[0], p.starts[0] + at
            at += 64 * len(p.words)
        return PerfectHash(sizes, starts, np.concatenate([p.words for p in parts.values()]) if parts else np.zeros(0, U))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 or any number for a key that wasn't built in, so verify against the stored keys."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        bucket = bucket_of(keys, len(self.sizes)) if len(self.sizes) > 1 else np.zeros(len(keys), np.int64)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[bucket, level]
            if not size.all():
                inside = size > 0
                left, bucket, size, keys = left[inside], bucket[inside], size[inside], keys[inside]
            if not len(left):
                break
            at = self.starts[bucket, level] + (mix(keys, level + 1) % size.astype(U)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            found = (word >> bit & U(1)).astype(bool)
            below = np.bitwise_count(word[found] & ((U(1) << bit[found]) - U(1)))
            out[left[found]] = self.ranks[at[found] >> 6] + below
            left, bucket, keys = left[~found], bucket[~found], keys[~found]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        """The level sizes and the words of a single bucket."""
        return self.sizes[0].tobytes(), self.words.tobytes()

    @staticmethod
    def unpack(sizes: bytes, words: bytes) -> PerfectHash:
        held = np.frombuffer(sizes, np.int64)
        return PerfectHash(held[None, :], (np.cumsum(held) - held)[None, :], np.frombuffer(words, U))
