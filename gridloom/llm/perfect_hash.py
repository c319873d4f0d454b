"""A minimal perfect hash by levels of collision-free bits, built and asked in numpy."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is still without a place.
GAMMA = 2


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits that tell a key from one that shares its slot without belonging to the set."""
    return (_hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1. At each level the keys that alone hold a bit stay there; the others go on.
    A key's slot is the number of bits before its own over all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.size = at

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            words = max(1, -(-GAMMA * len(left) // 64))
            pos = _hash(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(pos.astype(np.int64), minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            levels.append(bits)
            left = left[~alone[pos.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit. A key that was not given may get any slot."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            pos = _hash(keys[open_], level) % np.uint64(len(bits) * 64)
            word, bit = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (rank[word] + below)[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return head.tobytes() + b"".join(x.astype("<u8").tobytes() for x in self.levels)

    @staticmethod
    def load(data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", count, 8).astype(np.int64)
        body = np.frombuffer(data, "<u8", int(sizes.sum()), 8 * (count + 1))
        return PerfectHash(np.split(body, np.cumsum(sizes)[:-1]) if count else [])
