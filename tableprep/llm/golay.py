"""The perfect binary Golay code of length 23, built from its generator polynomial.

Every 23-bit word lies within three bits of exactly one codeword; ``indices``
gives the 12-bit index of that codeword for whole arrays of words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DATA_BITS, RADIUS = 23, 12, 3
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    """The syndrome: remainder of a 23-bit word by the generator."""
    for i in range(LENGTH - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and the high bits, and the error pattern of each syndrome."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]

    def span(bits):
        out = np.zeros(1, dtype=np.uint32)
        for b in bits:
            out = np.concatenate([out, out ^ np.uint32(unit[b])])
        return out
    low, high = span(range(12)), span(range(12, LENGTH))
    leaders = np.zeros(1 << 11, dtype=np.uint32)
    for k in range(RADIUS + 1):
        for bits in combinations(range(LENGTH), k):
            s = 0
            for b in bits:
                s ^= unit[b]
            leaders[s] = sum(1 << b for b in bits)
    return low, high, leaders


_LOW, _HIGH, _LEADERS = _tables()


def indices(words: np.ndarray) -> np.ndarray:
    """Index (top 12 bits) of the codeword nearest to each 23-bit word."""
    w = words.astype(np.uint32)
    syndrome = _LOW[w & np.uint32(0xFFF)] ^ _HIGH[w >> np.uint32(12)]
    return (w ^ _LEADERS[syndrome]) >> np.uint32(LENGTH - DATA_BITS)


def ball_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices met within one bit of each word: shape (n, bits + 1), unsorted, with repeats.

    Two words at distance two or less share an index: a word between them is
    within one bit of both, and has one nearest codeword.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    return indices(words.astype(np.uint32)[:, None] ^ flips[None, :])
