"""The binary Golay code (23, 12): every 23-bit word lies within three bits of one codeword."""

from __future__ import annotations

import functools
import itertools

import numpy as np

BITS = 23
_POLY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    r = words.astype(np.uint32)
    for i in range(BITS - 1, 10, -1):
        r = np.where(r >> np.uint32(i) & np.uint32(1), r ^ np.uint32(_POLY << (i - 11)), r)
    return r


@functools.lru_cache(maxsize=1)
def index_table() -> np.ndarray:
    """The 12-bit index of the nearest codeword, for every 23-bit word (16 MB)."""
    errors = [sum(1 << i for i in c) for n in range(4) for c in itertools.combinations(range(BITS), n)]
    errors = np.array(errors, dtype=np.uint32)
    error_of = np.zeros(1 << 11, dtype=np.uint32)
    error_of[syndrome(errors)] = errors
    out = np.empty(1 << BITS, dtype=np.uint16)
    step = 1 << 20
    for a in range(0, 1 << BITS, step):
        words = np.arange(a, a + step, dtype=np.uint32)
        out[a : a + step] = (words ^ error_of[syndrome(words)]) >> np.uint32(11)
    return out


def ball(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indices of each word and of all words one bit (of the lowest ``bits``) away, (n, bits + 1).

    Two words that differ in at most one bit: the index of either is among those of the other.
    """
    flips = np.array([0, *(1 << j for j in range(bits))], dtype=np.uint32)
    return index_table()[words.astype(np.uint32)[:, None] ^ flips[None, :]]
