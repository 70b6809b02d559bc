"""Bitmaps of bounded size by the last bits of hashes, aggregated on Spark: a value that is there is always found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(hashes: DataFrame, column: str, count: int, most: int) -> tuple[np.ndarray, int]:
    """A bitmap of ``count`` longs with some 32 bits for each, at most ``most`` bits (a power of two), and its number of bits."""
    bits = 1 << min(most.bit_length() - 1, max(16, (32 * count).bit_length()))
    place = F.col(column).bitwiseAND(bits - 1)
    chunks = hashes.groupBy(F.shiftright(place, 15).alias("chunk")).agg(F.bitmap_construct_agg(place % 32768).alias("bits"))
    found = np.zeros(bits // 8, np.uint8)
    for row in chunks.toLocalIterator():
        found[row["chunk"] * 4096 : (row["chunk"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return found, bits


def marked(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` may be there."""
    place = (hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
