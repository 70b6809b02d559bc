"""Words of many texts as flat NumPy arrays of 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than space and the bytes 9 to 13, after A-Z are lower-cased; this is what
``bytes.lower().split()`` yields.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 17

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int) -> np.ndarray:
    p = np.full(_STEP, U(base), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: base**i and base**-i modulo 2**64.
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def _long_word(data: np.ndarray) -> np.uint64:
    """The unmixed hash of a word that is longer than the tables, stretch by stretch."""
    total = U(0)
    for lo in range(0, len(data), _STEP):
        part = _BYTE[data[lo : lo + _STEP]]
        total += (part * _POWER[: len(part)]).sum(dtype=np.uint64) * U(pow(_BASE, lo, 2**64))
    return total


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): words of text i are ``hashes[offsets[i]:offsets[i + 1]]``.

    Bytes are worked through in stretches, so memory beyond that of the words is a few times that of the bytes.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _IS_SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + _STEP, "right")))
            hi = end[j - 1]
            if hi - lo > _STEP:
                words[i] = _long_word(data[lo:hi])
            else:
                total = np.cumsum(_BYTE[data[lo:hi]] * _POWER[: hi - lo], dtype=np.uint64)
                first, last = start[i:j] - lo, end[i:j] - lo
                before = np.where(first > 0, total[first - 1], U(0))
                words[i:j] = (total[last - 1] - before) * _INVERSE[first]
            i = j
        words = mix(words)
    offsets = np.searchsorted(start, np.concatenate(([0], ends_of_text)), "left")
    return words, offsets


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles per text, ascending, and their offsets.

    A text of fewer than k words has one shingle, its whole word sequence; a text without words has none.
    """
    n = np.diff(offsets)
    if len(n) == 1 and n[0] >= k:  # a text by itself, which may be very long
        h = np.zeros(n[0] - k + 1, np.uint64)
        for j in range(k):
            h = mix(h * U(0xD6E8FEB86659FD93) + words[j : j + len(h)] + U(j + 1))
        h = np.unique(h)
        return h, np.array([0, len(h)])
    owner = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, (n > 0).astype(np.int64)))
    count = np.maximum(n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(count)))
    at = offsets[:-1][owner] + np.arange(len(owner)) - first[:-1][owner]
    length = np.minimum(n, k)[owner]
    h = np.zeros(len(owner), np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    for j in range(k):
        has = length > j
        h = np.where(has, mix(h * U(0xD6E8FEB86659FD93) + padded[at + j] + U(j + 1)), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))
