"""Split texts into pre-tokenizer pieces for a whole batch at once.

The pieces are the matches of the public byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every alternative but the contractions is a run of one character class, with at
most one blank before it, so boundaries follow from comparing neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
# The whitespace characters of the pattern's engine.
WHITESPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
HASH_BASE, PLACE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for found in regex.finditer(rf"\p{{{name}}}+", points):
            table[[ord(c) for c in found[0]]] = kind
    table[WHITESPACE] = SPACE
    return table


@dataclass
class Pieces:
    """Pieces of a slice of texts, in order; ``begin`` and ``end`` are code point positions in ``joined``."""

    joined: str
    begin: np.ndarray
    end: np.ndarray
    per_text: np.ndarray
    hashes: np.ndarray


def split(texts: list[str]) -> Pieces:
    """All pieces of all texts, with their hashes.  An empty text has none."""
    joined, points, begin, end, per_text = bounds(texts)
    return Pieces(joined, begin, end, per_text, separate_hashes(points, begin, end))


def bounds(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their code points, where each piece begins and ends there, and the pieces of each text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kind = class_table()[points]
    marks = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    kind[marks] = END

    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    after[-1], after[:-1] = END, kind[1:]
    first = kind != before
    last_space = (kind == SPACE) & (after < SPACE)
    first |= last_space
    blank = last_space & (points == 0x20)
    first[1:] &= ~blank[:-1]  # a single blank belongs to the run that it stands before
    _contractions(points, kind, first)

    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(points))
    real = kind[begin] != END
    begin, end = begin[real], end[real]
    per_text = np.diff(np.searchsorted(begin, marks), prepend=0)
    return joined, points, begin, end, per_text


def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
    padded = np.append(points, [0, 0, 0])
    kinds = np.append(kind, [END, END, END])
    at = np.flatnonzero((points == ord("'")) & first)
    at = at[kinds[at + 1] == LETTER]
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    long &= ~short
    for where, size in ((at[short], 2), (at[long], 3)):
        first[where + 1] = False
        rest = where + size
        first[rest[rest < len(first)]] = True


def separate_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; runs are in order and do not overlap.

    Every value is mixed together with its place in the run before the sum, so no
    pattern of values cancels out, as long patterns do in a polynomial.
    """
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    length = end - begin
    gaps = np.append(begin, len(values)) - np.append(0, end)
    runs = np.empty(2 * len(begin) + 1, dtype=np.int64)
    starts = np.empty_like(runs)
    runs[::2], runs[1::2] = gaps, length
    starts[::2], starts[1::2] = np.append(0, end), begin
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts, runs)
    with np.errstate(over="ignore"):
        np.cumsum(mix((values.astype(np.uint64) + np.uint64(1)) * np.uint64(HASH_BASE) + place.astype(np.uint64) * np.uint64(PLACE)), out=sums[1:])
        return mix(sums[end] - sums[begin] + length.astype(np.uint64))


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of values, the same wherever the run stands; to be mixed before use.

    For windows that overlap; only for lengths far below the 1,024 values at which patterns of two values collide.
    """
    powers, inverse = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        return (sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64) << np.uint64(40)


_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power_cache or len(_power_cache[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(HASH_BASE, -1, 1 << 64)
        _power_cache[:] = [_cumulative(HASH_BASE, size), _cumulative(inverse, size)]
    return _power_cache[0][:n], _power_cache[1][:n]


def _cumulative(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
