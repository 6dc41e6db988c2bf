"""Minimal perfect hashing of a bounded set of keys: levels of bits, in which each key that is alone in its place gets it.

A key's number is how many bits are set before its own, so n keys have the numbers 0 to n - 1. What a key that isn't in the set gets is any
number or none: a stored fingerprint tells.
"""

from __future__ import annotations

import struct

import numpy as np

from .recompression import mix

#: Places for each key that a level has to place, and levels before what is left is listed.
SPREAD, LEVELS = 2.0, 40
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_HEAD = struct.Struct("<III")


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * int(_STEP) % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """The levels' bits in one row, and the keys that no level places; equal keys are among these."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.r_[0, np.cumsum(_POPULATION[bits])]
        self.placed = int(self.before[-1])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: 64-bit hashes."""
        sizes, rows, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(64, -(-int(SPREAD * len(left)) // 64) * 64)
            slot = _slots(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            rows.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[slot]]
            sizes.append(size)
        return cls(sizes, np.concatenate(rows) if rows else np.zeros(0, np.uint8), np.sort(left))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where a key certainly isn't in the set. Keys that are equal share the first of their numbers."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + _slots(keys[left], level, size)
            byte, bit = at >> 3, at & 7
            there = (self.bits[byte] >> bit) & 1 == 1
            below = self.bits[byte[there]] & ((1 << bit[there]) - 1).astype(np.uint8)
            out[left[there]] = self.before[byte[there]] + _POPULATION[below]
            left, start = left[~there], start + size
            if not len(left):
                break
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            there = self.rest[at] == keys[left]
            out[left[there]] = self.placed + at[there]
        return out

    def dump(self) -> bytes:
        head = _HEAD.pack(len(self.sizes), len(self.bits), len(self.rest))
        return head + np.array(self.sizes, "<u4").tobytes() + self.bits.tobytes() + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes | memoryview, at: int = 0) -> tuple[PerfectHash, int]:
        """The hash that begins at a place of `data`, and where it ends."""
        levels, n_bytes, n_rest = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        sizes = np.frombuffer(data, "<u4", levels, at).tolist()
        bits = np.frombuffer(data, np.uint8, n_bytes, at + 4 * levels)
        rest = np.frombuffer(data, "<u8", n_rest, at + 4 * levels + n_bytes)
        return cls(sizes, bits, rest), at + 4 * levels + n_bytes + 8 * n_rest
