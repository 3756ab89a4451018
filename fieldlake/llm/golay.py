"""The binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one of the 4096 codewords: its
index (12 bits) is the word's primary key.  A word has as further keys the
codewords at distance 4; there are five of them if it is at distance 3 from its
own, else none.  Two words that differ in one bit: the primary key of either is
among the keys of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, LENGTH, PARITY = 0b101011100011, 23, 11
KEYS = 6


def remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome of 23-bit words."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - PARITY, out)
    return out


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the index change that the nearest codeword's error makes, and the offsets of up to six keys (-1: none)."""
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(LENGTH), w)], dtype=np.int64)
    leader = np.zeros(1 << PARITY, dtype=np.int64)
    leader[remainder(errors)] = errors
    high = np.arange(1 << LENGTH - PARITY, dtype=np.int64) << PARITY
    codewords = high | remainder(high)
    light = codewords[np.bitwise_count(codewords) == 7]
    offsets = np.full((1 << PARITY, KEYS), -1, dtype=np.int64)
    offsets[:, 0] = 0
    for syndrome in np.flatnonzero(np.bitwise_count(leader) == 3):
        near = light[light & leader[syndrome] == leader[syndrome]]
        offsets[syndrome, 1 : 1 + len(near)] = near >> PARITY
    return leader, offsets


def keys(words: np.ndarray) -> np.ndarray:
    """Key indices of each word, six columns: the primary one, then the further ones or -1."""
    leader, offsets = tables()
    syndrome = remainder(words)
    primary = (words.astype(np.int64) ^ leader[syndrome]) >> PARITY
    more = offsets[syndrome]
    return np.where(more < 0, -1, primary[:, None] ^ more)
