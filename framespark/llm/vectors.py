"""What the vector operators share: which vectors take part, and random rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the usable vectors of a list column in double precision, and their places in the batch.

    Left out are null vectors, those of another length than ``dim``, those with null or non-finite components, and
    zero vectors.
    """
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == dim)
    if not len(places) or not dim:
        return np.zeros((0, dim)), places[:0]
    flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return flat[good], places[good]


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made from one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    ends = np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m, np.float64).reshape(-1)))
