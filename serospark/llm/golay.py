"""The perfect binary Golay code of length 23 as a fuzzy hash of 23-bit vectors.

``keys(x)`` are the message indices of all codewords within distance 4 of ``x``. That is one codeword
where the nearest is at distance 2 or less, else six (one at distance 3 and five at distance 4). Two
vectors at distance 2 or less have a key in common; ``tests/llm`` checks this for all of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(x: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - CHECK_BITS)
    return x


_ONE = [_remainder(1 << b) for b in range(LENGTH)]


def _table(bits: range) -> np.ndarray:
    out = np.zeros(1, np.int32)
    for b in bits:
        out = np.concatenate([out, out ^ _ONE[b]])
    return out


_LOW, _HIGH = _table(range(12)), _table(range(12, LENGTH))


def syndrome(x: np.ndarray) -> np.ndarray:
    return _LOW[x & 0xFFF] ^ _HIGH[x >> 12]


def _patterns() -> np.ndarray:
    """Error patterns of weight 4 or less by syndrome, nearest first; -1 where there are fewer than six."""
    by: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            value = 0
            for b in at:
                value ^= _ONE[b]
            by[value].append(sum(1 << b for b in at))
    return np.array([p + [-1] * (6 - len(p)) for p in by], np.int64)


PATTERNS = _patterns()


def keys(x: np.ndarray) -> np.ndarray:
    """An array of six message indices per vector, -1 where there is only one."""
    errors = PATTERNS[syndrome(x)]
    return np.where(errors >= 0, (x[:, None] ^ errors) >> CHECK_BITS, -1)
