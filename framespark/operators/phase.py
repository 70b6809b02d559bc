"""Phase correlation of whole frames by stripes: no task holds a frame.

A Fourier transform of a frame is two passes: stripes of rows are transformed along x and cut into blocks of columns, a
shuffle brings a block's pieces together, and blocks are transformed along y. The way back goes from blocks to stripes. A
stripe or block has at most ``CELLS`` values, or one row or column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

FRAME = ("stack_id", "frame_idx")
TARGET = (*FRAME, "target_idx")
#: Values of a stripe or a block.
CELLS = 1 << 19
#: Most rings of a radial profile.
RINGS = 2048
#: A scale this near to one is one, and so is one that moves no edge of the frame by a pixel.
STILL = 0.01


def _sampled(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``plane`` at fractional places, linear between rows, zero beyond."""
    low = np.floor(at).astype(int)
    part = (at - low)[:, None]
    row = lambda k: np.where(((k >= 0) & (k < len(plane)))[:, None], plane[np.clip(k, 0, len(plane) - 1)], 0.0)
    return row(low) * (1 - part) + row(low + 1) * part


def _table(table: pa.Table, keys: Sequence[str], rows: int, **columns: pa.Array) -> pa.Table:
    """Columns of a group's results after the keys of the group, as 64-bit integers."""
    return pa.table({c: pa.array(np.full(rows, table.column(c)[0].as_py(), np.int64)) for c in keys} | columns)


def _schema(keys: Sequence[str], more: str) -> str:
    return ", ".join(f"{c} long" for c in keys) + ", " + more


def _spectra(px: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """(keys, block, h, w, data, sums, counts): the half spectrum of each frame in blocks of columns, and each block's part of
    the power in rings. ``px(keys, y, x, v, h, w, scale)`` is enlarged by ``scale`` around its middle first."""
    keys = list(keys)

    def along_x(table: pa.Table) -> pa.Table:
        h, w, scale, stripe = (table.column(c)[0].as_py() for c in ("h", "w", "scale", "stripe"))
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        high, wide = max(1, cells // w), max(1, cells // h)
        lo, hi = stripe * high, min(h, (stripe + 1) * high)
        base = lo if scale == 1 else int(y.min())
        plane = np.zeros(((hi if scale == 1 else int(y.max()) + 1) - base, w))
        plane[y - base, x] = v
        if scale != 1:
            places = [(np.arange(*span) - (1 - scale) * (n - 1) / 2) / scale for span, n in (((lo, hi), h), ((0, w), w))]
            plane = _sampled(_sampled(plane, places[0] - base).T, places[1]).T
        z = np.fft.rfft(plane * np.hanning(h)[lo:hi, None] * np.hanning(w), axis=1)
        starts = range(0, z.shape[1], wide)
        block, at = pa.array(range(len(starts)), pa.int64()), pa.array([lo] * len(starts), pa.int64())
        data = pa.array([z[:, c : c + wide].tobytes() for c in starts], pa.binary())
        return _table(table, [*keys, "h", "w"], len(starts), block=block, at=at, data=data)

    def along_y(table: pa.Table) -> pa.Table:
        h, w, block = (table.column(c)[0].as_py() for c in ("h", "w", "block"))
        wide = max(1, cells // h)
        left = block * wide
        n = min(wide, w // 2 + 1 - left)
        z = np.zeros((h, n), complex)
        for at, data in zip(table.column("at").to_pylist(), table.column("data"), strict=True):
            piece = np.frombuffer(data.as_buffer(), complex).reshape(-1, n)
            z[at : at + len(piece)] = piece
        z = np.fft.fft(z, axis=0)
        rings = max(1, min(min(h, w) // 2, RINGS))
        column = np.arange(left, left + n)
        ring = (np.hypot(np.fft.fftfreq(h)[:, None], column / w) * 2 * rings).astype(int).ravel()
        twice = np.broadcast_to(np.where((column > 0) & (2 * column < w), 2.0, 1.0), z.shape).ravel()
        sums = np.bincount(ring, twice * np.square(np.abs(z)).ravel(), rings)[:rings]
        counts = np.bincount(ring, twice, rings)[:rings]
        profile = {c: pa.array([a.tolist()], pa.list_(pa.float64())) for c, a in (("sums", sums), ("counts", counts))}
        return _table(table, [*keys, "block", "h", "w"], 1, data=pa.array([z.tobytes()], pa.binary()), **profile)

    high = f"greatest(1L, {cells}L div w)"
    middle = "(1 - scale) * (h - 1) / 2"
    lo = F.expr(f"CASE WHEN scale = 1 THEN y ELSE greatest(0L, CAST(floor(scale * (y - 1) + {middle}) AS BIGINT)) END")
    hi = F.expr(f"CASE WHEN scale = 1 THEN y ELSE least(h - 1, CAST(ceil(scale * (y + 1) + {middle}) AS BIGINT)) END")
    dealt = px.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    dealt = dealt.select(*keys, "y", "x", "v", "h", "w", "scale", F.explode(F.expr(f"sequence(lo div {high}, hi div {high})")).alias("stripe"))
    rows = dealt.groupBy(*keys, "stripe").applyInArrow(along_x, _schema([*keys, "h", "w"], "block long, at long, data binary"))
    spectrum = "data binary, sums array<double>, counts array<double>"
    return rows.groupBy(*keys, "block").applyInArrow(along_y, _schema([*keys, "block", "h", "w"], spectrum))


def _scales(spectra: DataFrame, pairs: DataFrame, scales: tuple[float, float]) -> DataFrame:
    """(TARGET, scale): how much larger the target is than the frame, by the radial profiles of both.

    Rings count by their magnitude in the target, as weak ones are noise; a difference that is the same for all rings is
    brightness.
    """
    rings = spectra.select(*FRAME, F.posexplode(F.arrays_zip("sums", "counts")).alias("ring", "part"))
    rings = rings.groupBy(*FRAME, "ring").agg(F.log(F.sum("part.sums") / F.greatest(F.sum("part.counts"), F.lit(1.0)) + 1e-9).alias("mean"))
    profiles = rings.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("ring", "mean")))["mean"].alias("own"))
    other = profiles.select("stack_id", F.col("frame_idx").alias("target_idx"), F.col("own").alias("other"))
    both = pairs.join(profiles, list(FRAME)).join(other, ["stack_id", "target_idx"]).select(*TARGET, "own", "other")
    grid = np.linspace(*scales, 81)

    def best(own: np.ndarray, other: np.ndarray) -> float:
        at = np.arange(len(own))
        used = slice(2, max(3, int(0.8 * len(own) / max(1.0, scales[1]))))
        weight = np.exp(other - other.max())[used]
        off = np.array([(np.interp((at + 0.5) * s - 0.5, at, own) - other)[used] for s in grid])
        errors = np.square(off - (off @ weight / weight.sum())[:, None]) @ weight
        k = int(np.argmin(errors))
        scale = grid[k]
        if 0 < k < len(grid) - 1:
            a, b, c = errors[k - 1 : k + 2]
            scale += 0.5 * (a - c) / max(a - 2 * b + c, 1e-30) * (grid[1] - grid[0])
        return float(scale) if abs(scale - 1) > max(STILL, 1 / len(own)) else 1.0

    def run(batches):
        for pdf in batches:
            found = [best(np.asarray(a), np.asarray(b)) for a, b in zip(pdf["own"], pdf["other"], strict=True)]
            yield pdf[list(TARGET)].assign(scale=found)

    return both.mapInPandas(run, _schema(TARGET, "scale double"))


def phase_shift(px: DataFrame, pairs: DataFrame, scales: tuple[float, float] = (0.9, 1.1), factor: int = 1, cells: int = CELLS) -> DataFrame:
    """(stack_id, frame_idx, target_idx, dx, dy, scale): a place of a frame, times ``scale`` and plus (dx, dy), is its place in
    the target.

    The scale is found within ``scales`` from radial profiles of the power, to about two pixels at the frame's edge; the frame is enlarged by it and the shift
    is found by phase correlation, to a fraction of a pixel by the centre of mass around the peak. Frames (stack_id,
    frame_idx, y, x, v) are Hann-windowed; those of a stack have one shape, and missing or null pixels count as the mean of
    their frame. Of every ``factor``-th row and column. Pairs of which a frame has no pixels are left out.
    """
    if factor > 1:
        px = px.filter((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).withColumns({c: F.expr(f"{c} div {factor}") for c in ("y", "x")})
    pairs = pairs.select(*(F.col(c).cast("long").alias(c) for c in TARGET)).distinct()
    asked = pairs.select(*FRAME).union(pairs.select("stack_id", "target_idx")).distinct()
    px = px.filter("v IS NOT NULL").select(*(F.col(c).cast("long").alias(c) for c in (*FRAME, "y", "x")), F.col("v").cast("double").alias("v"))
    px = px.join(asked, list(FRAME), "left_semi")
    frames = px.groupBy(*FRAME).agg(F.avg("v").alias("mean"), F.max("y").alias("h"), F.max("x").alias("w"))
    sizes = frames.groupBy("stack_id").agg((F.max("h") + 1).alias("h"), (F.max("w") + 1).alias("w"))
    frames = written(frames.select(*FRAME, "mean").join(sizes, "stack_id"), "frames")
    held = px.join(frames, list(FRAME)).withColumn("v", F.col("v") - F.col("mean")).drop("mean")
    plain = written(_spectra(held.withColumn("scale", F.lit(1.0)), FRAME, cells), "spectra")
    found = written(_scales(plain, pairs, scales), "scales")
    block = ["block", "h", "w", "data"]
    own = plain.select(*FRAME, *block).join(found.filter("scale = 1").drop("scale"), list(FRAME))
    scaled = found.filter("scale <> 1")
    if not scaled.isEmpty():
        own = own.unionByName(_spectra(held.join(scaled, list(FRAME)), TARGET, cells).select(*TARGET, *block))
    other = plain.select("stack_id", F.col("frame_idx").alias("target_idx"), *block).join(found.drop("scale"), ["stack_id", "target_idx"])
    sides = own.select(*TARGET, *block, F.lit(0).alias("side")).unionByName(other.select(*TARGET, *block, F.lit(1).alias("side")))

    def cross(table: pa.Table) -> pa.Table:
        h, w = (table.column(c)[0].as_py() for c in ("h", "w"))
        of = {s: np.frombuffer(d.as_buffer(), complex).reshape(h, -1) for s, d in zip(table.column("side").to_pylist(), table.column("data"), strict=True)}
        both = np.conj(of[0]) * of[1] if len(of) == 2 else np.zeros_like(next(iter(of.values())))
        z = np.fft.ifft(both / np.maximum(np.abs(both), 1e-12), axis=0)
        high = max(1, cells // w)
        starts = range(0, h, high)
        data = pa.array([z[r : r + high].tobytes() for r in starts], pa.binary())
        return _table(table, [*TARGET, "block", "h", "w"], len(starts), stripe=pa.array(range(len(starts)), pa.int64()), data=data)

    def surface(table: pa.Table) -> pa.Table:
        h, w, stripe = (table.column(c)[0].as_py() for c in ("h", "w", "stripe"))
        high, wide = max(1, cells // w), max(1, cells // h)
        lo, n = stripe * high, min(high, h - stripe * high)
        z = np.zeros((n, w // 2 + 1), complex)
        for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
            piece = np.frombuffer(data.as_buffer(), complex).reshape(n, -1)
            z[:, block * wide : block * wide + piece.shape[1]] = piece
        values = np.abs(np.fft.irfft(z, w, axis=1))
        at = values.argmax(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(values.ravel()))
        y, x, peak = pa.array(np.arange(lo, lo + n)), pa.array(at.astype(np.int64)), pa.array(values[np.arange(n), at])
        return _table(table, [*TARGET, "h", "w"], n, y=y, x=x, peak=peak, row=lists)

    crossed = sides.groupBy(*TARGET, "block").applyInArrow(cross, _schema([*TARGET, "block", "h", "w"], "stripe long, data binary"))
    rows = crossed.groupBy(*TARGET, "stripe").applyInArrow(surface, _schema([*TARGET, "h", "w"], "y long, x long, peak double, row array<double>"))
    rows = written(rows, "surface")
    peaks = rows.groupBy(*TARGET, "h", "w").agg(F.max(F.struct("peak", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("p"))
    peaks = peaks.select(*TARGET, "h", "w", (-F.col("p.y")).alias("py"), (-F.col("p.x")).alias("px"))
    near = peaks.select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("ky")).withColumn("y", F.expr("pmod(py + ky, h)"))
    near = near.join(rows.select(*TARGET, "y", "row"), [*TARGET, "y"])
    taps = [F.get("row", F.expr(f"CAST(pmod(px + {k}, w) AS INT)")) for k in range(-2, 3)]
    total = sum(taps[1:], taps[0])
    aside = sum((taps[k] * (k - 2) for k in (1, 3, 4)), taps[0] * -2)
    summed = near.groupBy(*TARGET, "h", "w", "py", "px").agg(F.sum(total).alias("all"), F.sum(total * F.col("ky")).alias("cy"), F.sum(aside).alias("cx"))
    summed = summed.join(found, list(TARGET))
    back = lambda p, n: F.when(F.col(p) > F.expr(f"{n} div 2"), F.col(p) - F.col(n)).otherwise(F.col(p))
    part = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all")).otherwise(0.0)
    shift = lambda p, c, n: factor * (back(p, n) + part(c) + (1 - F.col("scale")) * (F.col(n) - 1) / 2)
    return summed.select(*TARGET, shift("px", "cx", "w").alias("dx"), shift("py", "cy", "h").alias("dy"), "scale")
