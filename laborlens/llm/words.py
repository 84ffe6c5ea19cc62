"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z are lower-cased. The hash is a
polynomial in a fixed odd base over random byte values, then mixed: the same on every machine.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWER = np.multiply.accumulate(np.full(1 << 16, BASE, np.uint64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separates words for features: every ASCII byte that is no letter or digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    start: np.ndarray      # in the flat bytes
    end: np.ndarray
    doc: np.ndarray        # row of the batch
    first: np.ndarray      # of each row, and one past the last: where its words start
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """All words of texts that lie one after the other; ``space`` says which bytes separate words."""
    solid = ~space[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = solid[edges]
    start = np.flatnonzero(begin)
    where = np.flatnonzero(solid)
    at = np.searchsorted(where, start)
    length = np.diff(np.append(at, len(where)))
    inside = np.arange(len(where)) - np.repeat(at, length)
    values = BYTE[FOLD[data[where]]] * POWER[inside & 0xFFFF]
    hashes = mix(np.add.reduceat(values, at)) if len(at) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, start + length, doc, first, hashes)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n words of one text, and the index of their first word."""
    count = max(0, len(w.hash) - n + 1)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[i:i + count]
    at = np.flatnonzero(w.doc[:count] == w.doc[n - 1:n - 1 + count]) if count else np.zeros(0, np.int64)
    return mix(h[at]), at
