"""Minimal perfect hashing of 64-bit keys: n distinct keys get the numbers 0 to n - 1.

Keys go through levels of bits, each twice as long as the keys that reach it. A key alone on
its bit sets it; the others go on to the next level, under another hash. The number of a key
is how many bits are set before its own, over all levels.
"""

from __future__ import annotations

import numpy as np

_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
MOST_LEVELS = 200


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + _SPREAD[0] * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _SPREAD[1]
        x = (x ^ (x >> np.uint64(27))) * _SPREAD[2]
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Lengths of the levels, and their bits in one string, for distinct keys."""
    sizes, levels, left = [], [], keys
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("the keys are not distinct")
        size = max(64, 2 * len(left))
        places = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(places, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[places]]
    bits = np.concatenate(levels) if levels else np.empty(0, bool)
    return sizes, np.packbits(bits).tobytes()


class PerfectHash:
    """Looks keys up in what ``build`` made."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.starts[-1])).astype(bool)
        self.before = (np.cumsum(self.bits) - self.bits).astype(np.int32)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key. One that was not among the keys gets any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            places = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[places]
            found[left[hit]] = self.before[places[hit]]
            left = left[~hit]
        return found
