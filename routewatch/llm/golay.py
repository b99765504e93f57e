"""The binary Golay code of 23 bits: syndromes, nearest codewords, and codewords within distance 4."""

from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the perfect code (23, 12, 7).
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


_UNIT = [_remainder(1 << bit) for bit in range(LENGTH)]


def _partial(first: int, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for bit in range(bits):
        out[1 << bit:2 << bit] = out[:1 << bit] ^ _UNIT[first + bit]
    return out


_LOW, _HIGH = _partial(0, 12), _partial(12, 11)


def _patterns() -> np.ndarray:
    """By syndrome: the error of weight 3 or less, then the five of weight 4 if the first has weight 3; -1 fills up."""
    out = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    filled = [0] * len(out)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for p in places:
                syndrome ^= _UNIT[p]
            out[syndrome, filled[syndrome]] = sum(1 << p for p in places)
            filled[syndrome] += 1
    return out


PATTERNS = _patterns()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within distance 3: there is exactly one. The top 12 bits tell codewords apart."""
    return (words ^ PATTERNS[syndrome(words), 0]) >> CHECK_BITS


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within distance 4, six columns, -1 where there are fewer.

    If two words differ in one bit at most, the nearest codeword of either is nearby the other.
    """
    errors = PATTERNS[syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK_BITS, -1)
