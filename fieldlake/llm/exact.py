"""Short byte strings as exact keys, and a hash table over them that compares whole keys.

A string of at most ``SHORT`` bytes is two 64-bit numbers: its bytes, and its length
in the top byte.  Different strings have different keys, so a lookup is never a
guess.  Longer strings are left to a dictionary of bytes.
"""

from __future__ import annotations

import numpy as np

SHORT = 15
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1] * 8, dtype=np.uint64)
_SECOND = np.array([0] * 9 + [(1 << 8 * n) - 1 for n in range(1, 8)], dtype=np.uint64)


def keys(data: bytes, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the key of every run of ``data``; lengths are at most ``SHORT``."""
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    return words[begin] & _FIRST[length], words[begin + 8] & _SECOND[length] | length.astype(np.uint64) << np.uint64(56)


def keys_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a list of short strings."""
    length = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    return keys(b"".join(strings), np.cumsum(length) - length, length)


class KeyTable:
    """Numbers by key, open-addressed; a slot counts as found only if both halves are equal."""

    def __init__(self, expected: int = 0):
        self._allot(max(10, int(4 * expected).bit_length()))

    def _allot(self, bits: int) -> None:
        self.bits, self.mask, self.size = bits, (1 << bits) - 1, 0
        self.one, self.two = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (one ^ two * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slots = self._slots(one, two)
        out = self.values[slots]
        wrong = np.flatnonzero((out >= 0) & ((self.one[slots] != one) | (self.two[slots] != two)))
        slots = slots[wrong]
        while len(wrong):
            slots = (slots + 1) & self.mask
            out[wrong] = self.values[slots]
            again = (out[wrong] >= 0) & ((self.one[slots] != one[wrong]) | (self.two[slots] != two[wrong]))
            wrong, slots = wrong[again], slots[again]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are new and differ from one another; numbers are not negative."""
        if 2 * (self.size + len(one)) > self.mask:
            held = np.flatnonzero(self.values >= 0)
            old = self.one[held], self.two[held], self.values[held]
            self._allot(int(4 * (len(held) + len(one))).bit_length())
            self._put(*old)
        self._put(one, two, values)

    def _put(self, one: np.ndarray, two: np.ndarray, values: np.ndarray) -> None:
        self.size += len(one)
        slots = self._slots(one, two)
        while len(one):
            free = self.values[slots] < 0
            claim = np.full(len(slots), -1, dtype=np.int64)
            taken, first = np.unique(slots[free], return_index=True)
            claim[np.flatnonzero(free)[first]] = taken
            won = claim >= 0
            self.one[slots[won]], self.two[slots[won]], self.values[slots[won]] = one[won], two[won], values[won]
            one, two, values, slots = one[~won], two[~won], values[~won], (slots[~won] + 1) & self.mask


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct key, and which of them each row is."""
    if not len(one):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((one, two))
    change = np.ones(len(order), dtype=bool)
    change[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(change) - 1
    return order[change], back
