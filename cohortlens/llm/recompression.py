"""Recompression of word sequences in numpy: rounds that name runs and pairs by content.

A name is a 64-bit hash of what it stands for, so equal strings get equal names
in every task without an exchange of dictionaries. With each symbol goes the
range of words that its existence depends on: a symbol whose range lies inside a
window is the same wherever that window's words stand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U = np.uint64
ROUNDS = 5
RUN_ROUNDS = 2
#: Symbols of so many words take no part in further rounds.
FROZEN = 16
#: Fewest words of a symbol that may stand for a window.
LEAST = 4
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[32] = 0
_BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
#: A second table and base: hashes of words that share nothing with the first ones.
_CHECK = np.random.default_rng(20240301).integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHECK[32] = 0
_CHECK_BASE = np.uint32(0x9E3779B1)


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of a tuple, column by column."""
    h = U(0x243F6A8885A308D3)
    for p in parts:
        h = (h ^ (p.astype(U, copy=False) if isinstance(p, np.ndarray) else U(p))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(32))) * U(0xC4CEB9FE1A85EC53)
        h = h ^ (h >> U(29))
    return h


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0], done = 1, 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * out[done - 1] * U(base)
        done += more
    return out


def powers(base: U, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    return _powers(int(base), 1 << max(12, int(n - 1).bit_length() if n > 1 else 1))[:n]


@dataclass
class Words:
    """Hashes of the words of several documents with a separator before, between and after them."""

    hashes: np.ndarray
    #: 32 further bits of each word, independent of ``hashes``.
    check: np.ndarray
    #: Per document: index of its first word, and its number of words.
    first: np.ndarray
    count: np.ndarray


def hash_words(texts: list[bytes], counts: list[int]) -> Words:
    """Texts have their words joined by single spaces and at least one word each."""
    buf = np.frombuffer(b"\n " + b" \n ".join(texts) + b" \n", np.uint8)
    cuts = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], cuts + 1))
    length = np.diff(np.concatenate((starts, [len(buf) + 1])))
    place = np.arange(len(buf)) - np.repeat(starts, length)[: len(buf)]
    sums = np.add.reduceat(_TABLE[buf] * powers(_BASES[0], int(length.max()) + 1)[place], starts)
    # a word's letters by another table and base, modulo 2^32
    scale = (powers(U(_CHECK_BASE), int(length.max()) + 1) & U(2**32 - 1)).astype(np.uint32)
    check = np.add.reduceat(_CHECK[buf] * scale[place], starts, dtype=np.uint32)
    count = np.array(counts, np.int64)
    first = np.cumsum(count + 1) - count
    return Words(mix(sums, length), check, first, count)


@dataclass
class Symbols:
    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def recompress(w: Words) -> Symbols:
    """The symbols after ROUNDS rounds, over all documents of w; separators stay symbols of their own."""
    name = w.hashes
    n = len(name)
    start = np.arange(n)
    end = start + 1
    lo, hi = start.copy(), end.copy()
    barrier = np.zeros(n, bool)
    barrier[np.concatenate((w.first - 1, [n - 1]))] = True
    for r in range(ROUNDS):
        if r < RUN_ROUNDS:
            # a run's extent depends on the symbols beside it
            fixed = barrier | (end - start >= FROZEN)
            head = np.concatenate(([True], (name[1:] != name[:-1]) | fixed[1:] | fixed[:-1]))
            at = np.flatnonzero(head)
            last = np.concatenate((at[1:], [len(name)])) - 1
            size = last - at + 1
            left, right = np.maximum(at - 1, 0), np.minimum(last + 1, len(name) - 1)
            free = ~fixed[at]
            name_new = np.where(size > 1, mix(name[at], size, 2 * r), name[at])
            lo, hi = np.where(free, lo[left], lo[at]), np.where(free, hi[right], hi[last])
            name, start, end, barrier = name_new, start[at], end[last], barrier[at]
        fixed = barrier | (end - start >= FROZEN)
        opens = ((mix(name, 101 + r) >> U(17)) & U(1)).astype(bool)
        first = opens & ~fixed
        second = ~opens & ~fixed
        merge = np.concatenate((first[:-1] & second[1:], [False]))
        hi_new = np.where(first, np.concatenate((hi[1:], hi[-1:])), hi)
        lo_new = np.where(second, np.concatenate((lo[:1], lo[:-1])), lo)
        keep = ~np.concatenate(([False], merge[:-1]))
        at = np.flatnonzero(keep)
        both = merge[at]
        nxt = np.minimum(at + 1, len(name) - 1)
        name = np.where(both, mix(name[at], name[nxt], 2 * r + 1), name[at])
        # what is merged depends on its two parts alone
        lo, hi = np.where(both, lo[at], lo_new[at]), np.where(both, hi[nxt], hi_new[at])
        start, end, barrier = start[at], np.where(both, end[nxt], end[at]), barrier[at]
    return Symbols(name, start, end, lo, hi)


def representatives(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of all words: the least name among the symbols that the window alone
    determines, and whether there is one. Equal windows have equal representatives."""
    s = recompress(w)
    n = len(w.hashes)
    at = np.flatnonzero(s.end - s.start >= LEAST)
    value, lo, hi = mix(s.name[at], 7), s.lo[at], s.hi[at]
    # symbols a..b-1 have lo >= i and hi <= i + window
    a = np.concatenate(([0], np.cumsum(np.bincount(lo, minlength=n))[: n - 1]))
    upto = np.cumsum(np.bincount(hi, minlength=n + 1))
    b = upto[np.minimum(np.arange(n) + window, n)]
    size = b - a
    has = size > 0
    out = np.zeros(n, U)
    level, width = value, 1
    while has.any():
        # sparse table: windows of width..2*width-1 symbols read two overlapping minima
        now = np.flatnonzero(has & (size >= width) & (size < 2 * width))
        if len(now):
            out[now] = np.minimum(level[a[now]], level[b[now] - width])
        if width * 2 > size.max():
            break
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out, has


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits, of words hashed twice) of the window at each start; the last window-1 are void."""
    n = len(w.hashes)
    out = []
    for base, words in ((_BASES[0], w.hashes), (_BASES[1], mix(w.check.astype(U), 3))):
        inverse = U(pow(int(base), -1, 2**64))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(words * powers(base, n))))
        h = np.zeros(n, U)
        if n >= window:
            h[: n - window + 1] = (sums[window:] - sums[:-window]) * powers(inverse, n)[: n - window + 1]
        out.append(mix(h))
    return out[0], (out[1] >> U(32)).astype(np.uint32)
