"""The perfect binary Golay code (23, 12, 7) and list decoding to radius four.

Two 23-bit words that differ in at most two bits always share a codeword within
distance four of both: a word within two bits of its codeword keeps that single
one; a word three bits away also takes the five codewords four bits away (by
the Steiner system S(4, 7, 23) these cover every neighbour).
"""

from __future__ import annotations

from functools import cache

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, factor of x^23 - 1


def _remainder(word: int) -> int:
    for i in range(N - 1, N - K - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - (N - K))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns (first the coset leader, of weight at most three), and how many."""
    unit = [_remainder(1 << i) for i in range(N)]
    by: list[list[int]] = [[] for _ in range(1 << (N - K))]

    def put(start: int, left: int, word: int, syndrome: int) -> None:
        if not left:
            by[syndrome].append(word)
            return
        for i in range(start, N - left + 1):
            put(i + 1, left - 1, word | 1 << i, syndrome ^ unit[i])

    for weight in range(4):
        put(0, weight, 0, 0)
    leaders = [x[0] for x in by]
    put(0, 4, 0, 0)
    patterns, count = np.zeros((len(by), 6), np.int64), np.ones(len(by), np.int64)
    for s, found in enumerate(by):
        near = [leaders[s]] + ([x for x in found[1:]] if leaders[s].bit_count() == 3 else [])
        patterns[s, : len(near)], count[s] = near, len(near)
    return patterns, count


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    return low, high


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word its codeword indices (12 bits each): (place in words, index) pairs."""
    low, high = _syndromes()
    s = low[words & 0xFFF] ^ high[words >> 12]
    patterns, count = tables()
    n = count[s]
    at = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, (words[at] ^ patterns[s[at], nth]) >> (N - K)
