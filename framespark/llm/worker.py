"""What Python workers hold: texts cut out of Arrow batches by bytes, and things kept for the tasks of one stage."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text turned to Python objects at once, about.
SLICE_BYTES = 1 << 20

_kept: dict[Hashable, Any] = {}
_stage: int | None = None


def begin_task() -> None:
    """Lets go of what another stage kept: workers are used again by later stages, whose memory it would take."""
    global _stage
    task = TaskContext.get()
    stage = None if task is None else task.stageId()
    if stage != _stage:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _stage = stage


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, once for all tasks of a stage that this worker runs."""
    begin_task()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def stretches(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of a column's rows of about ``limit`` bytes together and ``rows`` rows at most; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + limit, "right"))
        hi = max(lo + 1, min(hi, lo + rows))
        yield lo, hi
        lo = hi


def texts(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end, their texts in UTF-8) of each stretch; null texts are empty."""
    for lo, hi in stretches(column, limit, rows):
        yield lo, hi, [b"" if v is None else v for v in column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
