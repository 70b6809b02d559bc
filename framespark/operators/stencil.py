"""Separable convolutions over pixel tables by tiles, and the pyramid steps made of them.

A tile of a frame is one group, with a margin of the pixels around it, so work spreads over tiles of bounded size and
a convolution is one shuffle. A task lays its pixels out as an array, mirrors them beyond the frame's ends (reflection
that does not repeat the edge) and adds up shifted arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

#: The side of a tile.
TILE = 128

FRAME = ("stack_id", "frame_idx")
#: Taps of the pyramid's generating kernel times 20 (for its parameter 0.4), and of the binomial one times 16.
GENERATING, BINOMIAL = (1, 5, 8, 5, 1), (1, 4, 6, 4, 1)


def with_size(px: DataFrame, keys: Sequence[str] = ("stack_id",)) -> DataFrame:
    """Adds the frames' height and width, ``h`` and ``w``."""
    size = px.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return px.drop("h", "w").join(size, list(keys))


def _mirrored(lo: int, n: int, size: int, edge: str) -> np.ndarray:
    """For n places from ``lo`` on, the places within a side of ``size`` that they show."""
    at = np.arange(lo, lo + n)
    if edge != "reflect":  # the edge row stands for all rows beyond it
        return np.clip(at, 0, size - 1)
    at = np.abs(at)
    return np.where(at >= size, 2 * (size - 1) - at, at)


def _convolved(a: np.ndarray, taps: Sequence[float], axis: int) -> np.ndarray:
    n, total = a.shape[axis] - len(taps) + 1, None
    for k, tap in enumerate(taps):
        if tap:
            part = a[k : k + n] if axis == 0 else a[:, k : k + n]
            total = part * tap if total is None else total + part * tap
    return np.zeros((n, a.shape[1]) if axis == 0 else (a.shape[0], n)) if total is None else total


def stencil(
    df: DataFrame,
    taps_y: Sequence[float],
    taps_x: Sequence[float] | None,
    cols: Sequence[str],
    keys: Sequence[str] = FRAME,
    out: Sequence[str] | None = None,
    edge: str = "reflect",
    tile: int = TILE,
) -> DataFrame:
    """Convolves ``cols`` by ``taps_y`` along y and ``taps_x`` along x; ``df`` has columns ``h`` and ``w``.

    Results are named ``out`` (by default they replace ``cols``); they are whole numbers where columns and taps are.
    Frames are dense, and their sides are longer than half the taps.
    """
    return stencils(df, {o: (c, taps_y, taps_x or taps_y) for o, c in zip(out or cols, cols, strict=True)}, keys, edge, tile)


def stencils(
    df: DataFrame, results: dict[str, tuple], keys: Sequence[str] = FRAME, edge: str = "reflect", tile: int = TILE
) -> DataFrame:
    """Several convolutions in one pass: ``results`` maps each new column to its source, taps along y and taps along x.

    For other kernels a result is its source, a function of a dense plane with a margin, and the width of that margin.
    """
    out, free = list(results), {o: r[1:] for o, r in results.items() if callable(r[1])}
    results = {o: (r[0], (0.0,) * (2 * r[2] + 1), (0.0,) * (2 * r[2] + 1)) if o in free else r for o, r in results.items()}
    ry, rx = (max(len(r[k]) // 2 for r in results.values()) for k in (1, 2))
    types = {f.name: f.dataType for f in df.schema}
    kinds = {o: "long" if all(isinstance(t, int) for t in (*ty, *tx)) and isinstance(types[c], IntegralType) else "double" for o, (c, ty, tx) in results.items()}
    names = [c for c in df.columns if c not in kinds] + out
    schema = StructType([StructField(c, types[c]) for c in names[: -len(out)]])
    for o in out:
        schema = schema.add(o, kinds[o])

    def tiles(at: str, size: str, r: int) -> Column:
        last = F.expr(f"({size} - 1) div {tile}")
        near = F.expr(f"({at} - {r}) div {tile}"), F.expr(f"({at} + {r}) div {tile}")
        return F.array_distinct(F.array(F.greatest(near[0], F.lit(0)), F.least(near[1], last)))

    def run(table: pa.Table) -> pa.Table:
        y, x, ty, tx, h, w = (table.column(c).to_numpy() for c in ("y", "x", "_ty", "_tx", "h", "w"))
        y0, x0, height, width = ty[0] * tile, tx[0] * tile, h[0], w[0]
        rows, columns = min(tile, height - y0), min(tile, width - x0)
        from_y = _mirrored(y0 - ry, rows + 2 * ry, height, edge) - (y0 - ry)
        from_x = _mirrored(x0 - rx, columns + 2 * rx, width, edge) - (x0 - rx)
        home = np.flatnonzero((y >= y0) & (y < y0 + tile) & (x >= x0) & (x < x0 + tile))
        kept = table.take(pa.array(home))
        done = [kept.column(c) for c in names[: -len(out)]]
        for o, (c, taps_y, taps_x) in results.items():
            dense = np.zeros((rows + 2 * ry, columns + 2 * rx), np.float64 if kinds[o] == "double" else np.int64)
            dense[y - (y0 - ry), x - (x0 - rx)] = table.column(c).to_numpy()
            cut_y, cut_x = ry - len(taps_y) // 2, rx - len(taps_x) // 2  # shorter taps need less of the margin
            dense = dense[from_y][:, from_x][cut_y : len(from_y) - cut_y, cut_x : len(from_x) - cut_x]
            dense = free[o][0](dense) if o in free else _convolved(_convolved(dense, taps_y, 0), taps_x, 1)
            done.append(pa.chunked_array([pa.array(dense[y[home] - y0, x[home] - x0].astype(dense.dtype))]))
        return pa.table(done, names=names)

    spread = df.withColumn("_ty", F.explode(tiles("y", "h", ry))).withColumn("_tx", F.explode(tiles("x", "w", rx)))
    return spread.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def gaussian_taps(sigma: float, size: int | None = None) -> list[float]:
    """Sampled and normalised; the size follows sigma as for 8-bit images unless given."""
    import math

    size = size or (round(sigma * 6 + 1) | 1)
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [v / sum(raw) for v in raw]


def reduce(px: DataFrame, cols: Sequence[str], keys: Sequence[str] = FRAME, taps: Sequence[int] = GENERATING) -> DataFrame:
    """Convolved and every other row and column kept."""
    total = float(sum(taps) ** 2)
    smooth = stencil(px, taps, None, cols, keys)
    kept = smooth.filter((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    halves = {c: F.expr(f"{c} div 2") for c in ("y", "x")} | {c: F.expr(f"({c} + 1) div 2") for c in ("h", "w")}
    return kept.withColumns(halves | {c: F.col(c) / total for c in cols})


def grown(coarse: DataFrame, cols: Sequence[str], keys: Sequence[str] = FRAME, taps: Sequence[int] = GENERATING, tile: int = TILE) -> DataFrame:
    """(keys, y, x, cols) of ``coarse`` at twice its size: zeros between, convolved, times 4.

    Zeros lie on a grid of exactly twice the coarse size, beyond which it is mirrored; what a fine frame lacks of that
    grid goes when the two are joined.
    """
    scale, r, half = 4.0 / sum(taps) ** 2, len(taps) // 2, tile // 2
    m = (r + 1) // 2  # the margin in coarse pixels
    types = {f.name: f.dataType for f in coarse.schema}
    schema = StructType([StructField(k, types[k]) for k in keys]).add("y", "long").add("x", "long")
    for c in cols:
        schema = schema.add(c, "double")

    def run(table: pa.Table) -> pa.Table:
        y, x, ty, tx, h, w = (table.column(c).to_numpy() for c in ("y", "x", "_ty", "_tx", "h", "w"))
        y0, x0 = ty[0] * half, tx[0] * half
        rows, columns = min(half, h[0] - y0), min(half, w[0] - x0)
        from_y = _mirrored(2 * y0 - r, 2 * rows + 2 * r, 2 * h[0], "reflect") - 2 * (y0 - m)
        from_x = _mirrored(2 * x0 - r, 2 * columns + 2 * r, 2 * w[0], "reflect") - 2 * (x0 - m)
        at = 2 * (y - y0 + m), 2 * (x - x0 + m)
        n = 4 * rows * columns
        done = [pa.chunked_array([pa.repeat(table.column(k)[0], n)]) for k in keys]
        done += [np.repeat(2 * y0 + np.arange(2 * rows), 2 * columns), np.tile(2 * x0 + np.arange(2 * columns), 2 * rows)]
        for c in cols:
            dense = np.zeros((2 * (rows + 2 * m), 2 * (columns + 2 * m)))
            dense[at] = table.column(c).to_numpy()
            done.append((_convolved(_convolved(dense[from_y][:, from_x], taps, 0), taps, 1) * scale).ravel())
        return pa.table(done, names=schema.names)

    spread = coarse.select(*keys, "y", "x", "h", "w", *cols)
    for at, size in (("y", "h"), ("x", "w")):
        near = F.expr(f"({at} - {m}) div {half}"), F.expr(f"({at} + {m}) div {half}"), F.expr(f"({size} - 1) div {half}")
        spread = spread.withColumn(f"_t{at}", F.explode(F.array_distinct(F.array(F.greatest(near[0], F.lit(0)), F.least(near[1], near[2])))))
    return spread.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def shuffled(px: DataFrame) -> DataFrame:
    """Pixels that meet others in a join of shuffled and sorted rows. Spark tells their size from the files that they came
    from, which pack well and hold but a quarter of what is ``grown`` of them, and would send them all to the driver."""
    return px.hint("merge")


def expand(coarse: DataFrame, fine: DataFrame, cols: Sequence[str], keys: Sequence[str] = FRAME, taps: Sequence[int] = GENERATING) -> DataFrame:
    """``coarse`` on the grid of ``fine``, which gives ``keys, y, x, h, w``."""
    return fine.select(*keys, "y", "x", "h", "w").join(shuffled(grown(coarse, cols, keys, taps)), [*keys, "y", "x"])
