"""Counting quotient filters: sorted fingerprints cut into quotient and remainder, with counts.

A fingerprint of ``width`` bits has a quotient (its first ``q`` bits), which is kept as a place, and a remainder, which is
kept in full, so nothing is lost: filters of any q give back their fingerprints in order and merge by those.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Slots a quotient has, about.
LOAD = 0.75


def _planes(values: np.ndarray, n_bytes: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T


def pack(fingerprints: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of distinct ascending ``fingerprints`` (below 2**width) with their ``counts``.

    Layout: number of slots and q; a bit for each quotient that has a run (occupied); a bit for each slot that ends a run;
    remainders by byte planes; a bit for each slot counted more than once; those counts.
    """
    n = len(fingerprints)
    q = min(width, max(0, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
    rest = U(width - q)
    quotients = fingerprints >> rest if q else np.zeros(n, U)
    remainders = fingerprints & U((1 << int(rest)) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotients[1:] != quotients[:-1]
    many = counts > 1
    parts = [np.array([n, q], "<u8"), np.packbits(occupied), np.packbits(ends), _planes(remainders, (int(rest) + 7) // 8)]
    return b"".join(x.tobytes() for x in [*parts, np.packbits(many), counts[many].astype("<u8")])


def unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in ascending order, and their counts."""
    n, q = (int(x) for x in np.frombuffer(data, "<u8", 2))
    at = 16

    def bits(count: int) -> np.ndarray:
        nonlocal at
        size = (count + 7) // 8
        found = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count)
        at += size
        return found

    runs, ends = np.flatnonzero(bits(1 << q)), bits(n)
    rest = width - q
    n_bytes = (rest + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :n_bytes] = np.frombuffer(data, np.uint8, n * n_bytes, at).reshape(n_bytes, n).T
    at += n * n_bytes
    many = bits(n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<u8", int(many.sum()), at)
    run_of_slot = np.cumsum(ends) - ends
    high = runs[run_of_slot].astype(U) << U(rest) if q else np.zeros(n, U)
    return high | wide.view("<u8").ravel(), counts


def tally(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order and the sums of their counts."""
    if not len(fingerprints):
        return fingerprints, np.zeros(0, np.int64)
    order = np.argsort(fingerprints, kind="stable")
    fingerprints = fingerprints[order]
    first = np.flatnonzero(np.concatenate(([True], fingerprints[1:] != fingerprints[:-1])))
    counts = np.ones(len(order), np.int64) if counts is None else counts[order]
    return fingerprints[first], np.add.reduceat(counts, first)


def merge(filters: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """What all ``filters`` hold together: sorted remainders fall in with their like, and counts add up."""
    entries = [unpack(x, width) for x in filters]
    return tally(np.concatenate([f for f, _ in entries]), np.concatenate([c for _, c in entries]))
