"""The perfect binary code of length 23, radius 3, as the covering code behind the anchors.

A fingerprint's bits 0-22 and 23-45 are two blocks, each covered within ``RADIUS`` by exactly one
code word; bits 46-63 are covered by the single word zero. An anchor is a pair of code words, named
by their 12 + 12 information bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS, RADIUS = 23, 11, 3
# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BLOCK = (1 << LENGTH) - 1


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECKS)
    return word


@cache
def _parts() -> list[np.ndarray]:
    """Syndromes of the low, middle and high eight bits; a syndrome is linear in its word."""
    return [np.array([_remainder(byte << shift & BLOCK) for byte in range(256)], dtype=np.int64) for shift in (0, 8, 16)]


def syndromes(words: np.ndarray) -> np.ndarray:
    low, middle, high = _parts()
    return low[words & 255] ^ middle[words >> 8 & 255] ^ high[words >> 16]


@cache
def error_table(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the errors to every code word within ``RADIUS + threshold`` (-1: none), and by column how
    far beyond ``RADIUS`` they go. The first column is the one error within the radius."""
    lists: list[list[list[int]]] = [[[] for _ in range(threshold + 1)] for _ in range(1 << CHECKS)]
    single = syndromes(1 << np.arange(LENGTH))
    for weight in range(RADIUS + threshold + 1):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for place in places:
                syndrome ^= int(single[place])
            lists[syndrome][max(0, weight - RADIUS)].append(sum(1 << place for place in places))
    widths = [max(len(row[excess]) for row in lists) for excess in range(threshold + 1)]
    table = np.array([[error for excess, width in enumerate(widths) for error in row[excess] + [-1] * (width - len(row[excess]))] for row in lists], dtype=np.int64)
    return table, np.repeat(np.arange(threshold + 1), widths)


def home_anchors(fingerprints: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius of each fingerprint."""
    table, _ = error_table(0)
    first, second = fingerprints & BLOCK, fingerprints >> LENGTH & BLOCK
    return ((first ^ table[syndromes(first), 0]) >> CHECKS) << 12 | (second ^ table[syndromes(second), 0]) >> CHECKS


def near_anchors(fingerprints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """``(index, anchor)`` of every anchor within the covering radius plus ``threshold``: those whose blocks
    exceed their radius by ``threshold`` bits at most, taken together."""
    table, excess = error_table(threshold)
    pairs = np.array([(i, j) for i, a in enumerate(excess) for j, b in enumerate(excess) if a + b <= threshold])
    first, second = fingerprints & BLOCK, fingerprints >> LENGTH & BLOCK
    errors_a, errors_b = table[syndromes(first)], table[syndromes(second)]
    words_a = np.where(errors_a < 0, -1, (first[:, None] ^ errors_a) >> CHECKS)[:, pairs[:, 0]]
    words_b = np.where(errors_b < 0, -1, (second[:, None] ^ errors_b) >> CHECKS)[:, pairs[:, 1]]
    rows, columns = np.nonzero((words_a >= 0) & (words_b >= 0))
    return rows, words_a[rows, columns] << 12 | words_b[rows, columns]
