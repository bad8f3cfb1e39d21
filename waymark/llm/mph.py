"""Minimal perfect hash over distinct 64-bit keys, with fingerprint and count arrays.

Levels of bit arrays: a key that is alone on its bit of a level stays there,
the others go on to the next level. A key's slot is the number of set bits
before its own, so n keys take the slots 0..n-1. At two bits a key and level
this takes about 3.7 bits a key; the fingerprint (the line's second 64-bit hash)
and the count lie in plain arrays by slot. A key that was never indexed may
land on some slot; its fingerprint tells it apart.
"""

from __future__ import annotations

import struct

import numpy as np

LEVELS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """One shard: where its keys lie, their fingerprints and counts."""

    def __init__(self, sizes: list[int], words: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.prints, self.counts = sizes, words, prints, counts
        self.before, start = [], 0
        for level in words:
            ones = np.bitwise_count(level).astype(np.int64)
            self.before.append(start + np.cumsum(ones) - ones)
            start += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectHash:
        left, sizes, words = keys, [], []
        while len(left):
            if len(words) == LEVELS:
                raise ValueError("the keys of a perfect hash must be distinct")
            size = (2 * len(left) + 63) // 64 * 64
            at = _mixed(left, len(words)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        made = cls(sizes, words, np.empty(0, np.uint64), np.empty(0, np.uint64))
        slot = made.slots(keys)
        made.prints = np.empty(len(keys), np.uint64)
        made.prints[slot] = prints
        made.counts = np.empty(len(keys), np.min_scalar_type(int(counts.max(initial=0))))
        made.counts[slot] = counts
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or some slot for a key that isn't indexed."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words) in enumerate(zip(self.sizes, self.words, strict=True)):
            if not len(left):
                break
            at = _mixed(keys[left], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self.before[level][word] + np.bitwise_count(below).astype(np.int64))[found]
            left = left[~found]
        return out

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where its fingerprint isn't in the array."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64)
        slot = self.slots(keys)
        known = (slot >= 0) & (self.prints[slot] == prints)
        return np.where(known, self.counts[slot].astype(np.int64), 0)

    def dump(self) -> bytes:
        head = struct.pack(f"<QQB{len(self.sizes)}Q", len(self.prints), len(self.sizes), self.counts.itemsize, *self.sizes)
        return head + b"".join(x.tobytes() for x in (*self.words, self.prints, self.counts))

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n, levels, width = struct.unpack_from("<QQB", blob)
        sizes = list(struct.unpack_from(f"<{levels}Q", blob, 17))
        at, words = 17 + 8 * levels, []
        for size in sizes:
            words.append(np.frombuffer(blob, np.uint64, size // 64, at))
            at += size // 8
        return cls(sizes, words, np.frombuffer(blob, np.uint64, n, at), np.frombuffer(blob, f"<u{width}", n, at + 8 * n))
