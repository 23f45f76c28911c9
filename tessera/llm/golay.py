"""The binary Golay code (23, 12, 7) as a fuzzy hash.

The code is perfect: every 23-bit word lies within distance 3 of exactly one of
the 4096 codewords, whose number is the word's index.  The indices of a word are
its own and those of its 23 neighbours at distance 1: one to six different ones.
Two words at distance 1 or 2 share an index (that of a word between them); at
distance 1 even one's own index is among the other's indices.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
WIDTH = 23


@cache
def table() -> np.ndarray:
    """The index of every 23-bit word."""
    data = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(data)
    for bit in range(12):
        words ^= np.where(data >> bit & 1, GENERATOR << bit, 0)
    errors = [0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(WIDTH), n)]
    out = np.empty(1 << WIDTH, dtype=np.int16)
    for e in errors:
        out[words ^ e] = data
    return out


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its own index, and a row with all its indices, sorted and padded with -1."""
    t = table()
    own = t[words]
    near = np.empty((len(words), WIDTH + 1), dtype=np.int16)
    near[:, 0] = own
    for b in range(WIDTH):
        near[:, b + 1] = t[words ^ (1 << b)]
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near.sort(axis=1)
    return own, near[:, -6:]
