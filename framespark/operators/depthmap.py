"""Depth-map fusion: focus energies, weights over frames, and blending by them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import TILE_ROWS, written
from . import tiles
from .stencil import BINOMIAL, FRAME, gaussian_taps, stencil, stencils

PLACE = ("stack_id", "y", "x")
BGR = ("b", "g", "r")


def derivative_taps(size: int, order: int) -> list[int]:
    """Taps of a smoothed derivative: the coefficients of (1 + z)^(size - 1 - order) (z - 1)^order."""
    out = [1]
    for k in range(size - 1):
        sign = -1 if k < order else 1
        out = [a * sign + b for a, b in zip([*out, 0], [0, *out], strict=True)]
    return out


def blur_taps(size: int) -> list[float]:
    """A Gaussian of ``size`` taps: binomial up to 5, else sampled with the sigma that goes with the size."""
    if size <= 5:
        return [v / 2 ** (size - 1) for v in derivative_taps(size, 0)]
    return gaussian_taps(0.3 * ((size - 1) * 0.5 - 1) + 0.8, size)


def _laplacian_taps(size: int) -> tuple[list[int], list[int]]:
    """Taps along and across; of size 1 the second difference alone."""
    return ([1, -2, 1], [0, 1, 0]) if size == 1 else (derivative_taps(size, 2), derivative_taps(size, 0))


def energy_map(px: DataFrame, kind: str = "laplacian", kernel_size: int = 5, blur_size: int = 5) -> DataFrame:
    """(stack_id, frame_idx, y, x, h, w, e) of a gray column ``v``; ``px`` has ``h`` and ``w``.

    ``mod_laplacian`` is another name for ``sobel``. ``kernel_size`` and ``blur_size`` (odd) are those of ``laplacian``.
    """
    v = px.withColumn("v", F.col("v").cast("double"))
    if kind in ("sobel", "mod_laplacian", "tenengrad"):
        both = stencils(v, {"gx": ("v", (1, 2, 1), (-1, 0, 1)), "gy": ("v", (-1, 0, 1), (1, 2, 1))})
        square = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
        e = F.abs("gx") + F.abs("gy") if kind != "tenengrad" else F.when(square > 5, square).otherwise(0.0)
    elif kind == "laplacian":
        smooth = stencil(v, blur_taps(blur_size), None, ["v"], out=["s"])
        along, across = _laplacian_taps(kernel_size)
        both = stencils(smooth, {"l1": ("s", along, across), "l2": ("s", across, along)})
        e = F.abs(F.col("l1") + F.col("l2"))
    elif kind == "variance":
        both = stencil(v.withColumn("v2", F.col("v") * F.col("v")), (1,) * 5, None, ["v", "v2"], out=["s", "s2"])
        e = F.col("s2") / 25 - (F.col("s") / 25) * (F.col("s") / 25)
    else:
        raise ValueError(f"unknown energy: {kind}")
    return both.select(*FRAME, "y", "x", "h", "w", e.alias("e"))


def bilateral_filtered(plane: np.ndarray, radius: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    """A plane with a margin of ``radius``, smoothed within a circle: weights fall with distance and with the difference."""
    h, w = (n - 2 * radius for n in plane.shape)
    here = plane[radius : radius + h, radius : radius + w]
    total, whole = here.copy(), np.ones((h, w))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if (dy or dx) and dy * dy + dx * dx <= radius * radius:
                near = plane[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                gap = near - here
                weight = math.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2)) * np.exp(-gap * gap / (2 * sigma_color**2))
                total += weight * near
                whole += weight
    return total / whole


def bilateral(energy: DataFrame, sigma_color: float = 0.8, sigma_space: float = 2.0, d: int = 1) -> DataFrame:
    """Edge-keeping smoothing of ``e`` within a circle of diameter ``d`` (the four neighbours at least)."""
    radius = max(d // 2, 1)
    return stencils(energy, {"e": ("e", lambda plane: bilateral_filtered(plane, radius, sigma_color, sigma_space), radius)})


def focus_weights(energy: DataFrame, map_: str = "max", temperature: float = 0.0) -> DataFrame:
    """(…, w): each frame's share at each place. ``average``: of the energy. ``max``: of the frames with the most
    energy, or by a softmax of energy over temperature."""
    over = Window.partitionBy(*PLACE)
    if map_ == "average":
        total = F.sum("e").over(over)
        share = F.when(total != 0, F.col("e") / total).otherwise(0.0)
    elif temperature < 1e-4:
        best = (F.round("e", 6) == F.max(F.round("e", 6)).over(over)).cast("double")
        share = best / F.sum(best).over(over)
    else:
        energy = energy.withColumn("m", F.exp((F.col("e") - F.max("e").over(over)) / temperature))
        share = F.col("m") / F.sum("m").over(over)
    return energy.withColumn("wt", share).drop("e", "m")


def weight_power(weights: DataFrame, p: float) -> DataFrame:
    raised = weights.withColumn("wt", F.pow("wt", F.lit(float(p))))
    total = F.sum("wt").over(Window.partitionBy(*PLACE))
    return raised.withColumn("wt", F.when(total != 0, F.col("wt") / total).otherwise(0.0))


def depth_map(weights: DataFrame) -> DataFrame:
    """(stack_id, y, x, depth): the weighted mean frame number, scaled to 0 to 255."""
    frames = weights.groupBy("stack_id").agg(F.count_distinct("frame_idx").alias("n"))
    mean = weights.groupBy(*PLACE).agg((F.sum(F.col("wt") * F.col("frame_idx")) / F.sum("wt")).alias("m"))
    scaled = F.col("m") / F.greatest(F.col("n") - 1, F.lit(1)) * 255
    return mean.join(frames, "stack_id").select(*PLACE, F.floor(F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)), 6)).cast("long").alias("depth"))


def weighted_blend(px: DataFrame, weights: DataFrame, levels: int = 5, depth: int = 8, smooth_size: int = 1) -> DataFrame:
    """Images blended on binomial pyramids of ``levels`` levels (one less are reductions): details are weighted by the
    frames' weights, blurred with ``smooth_size`` taps and reduced like the images.

    ``px`` and ``weights`` are rows of pixels with ``h`` and ``w``, and with ``wt``.
    """
    keys = ["stack_id"]
    both = px.select(*FRAME, "y", "x", "h", "w", *(F.col(c).cast("double") for c in BGR)).join(weights.select(*FRAME, "y", "x", "wt"), [*FRAME, "y", "x"])
    both = both.withColumn("left", F.lit(levels - 1).cast("long"))
    return _blended(written(tiles.parts_of_pixels(both, keys, _margins(smooth_size // 2), planes=(*BGR, "wt")), "parts", **TILE_ROWS), keys, depth, None, smooth_size)


def _margins(more: int) -> list[int]:
    """Pixels beyond a tile that ``n`` levels of blending need: two at the coarsest, and every reduction doubles what it
    needs and adds two; ``more`` for what comes before at the finest."""
    return [m + more for m in (0, 6, 14, 30)]


class _Focus:
    """What a depth map weighs frames by, on planes with margins."""

    def __init__(self, energy: str, kernel_size: int, blur_size: int, smooth_size: int, sigma_color: float, sigma_space: float,
                 map_: str, temperature: float, power: float) -> None:
        self.kind, self.kernel_size, self.blur_size = energy, kernel_size, blur_size
        self.radius, self.sigmas = max(smooth_size // 2, 1) if smooth_size > 0 else 0, (sigma_color, sigma_space)
        self.map, self.temperature, self.power = map_, temperature, power
        if energy not in ("sobel", "mod_laplacian", "tenengrad", "laplacian", "variance"):
            raise ValueError(f"unknown energy: {energy}")
        if map_ not in ("average", "max"):
            raise ValueError(f"unknown map: {map_}")
        before = {"laplacian": blur_size // 2 + max(kernel_size // 2, 1), "variance": 2}.get(energy, 1)
        #: Pixels that an energy needs around it.
        self.reach = before + self.radius

    def energies(self, bgr: np.ndarray, has: list, wants: list, sizes: list[int]) -> np.ndarray:
        """The frame's energies over ``wants``; every step mirrors what the one before it gave at the frame's ends."""

        def near(plane, here, there, ry, rx):
            at = [tiles.mirrored(np.arange(lo - r, hi + r), n) - h[0] for (lo, hi), r, n, h in zip(there, (ry, rx), sizes, here, strict=True)]
            return plane[at[0][:, None], at[1]]

        def grown(ranges, r):
            return [(max(0, lo - r), min(n, hi + r)) for (lo, hi), n in zip(ranges, sizes, strict=True)]

        def taps(plane, here, there, ty, tx):
            return tiles.convolved_by(near(plane, here, there, len(ty) // 2, len(tx) // 2), ty, tx)

        b, g, r = (np.rint(c).astype(np.int64) for c in bgr)
        gray = ((4899 * r + 9617 * g + 1868 * b + 8192) >> 14).astype(float)
        there = grown(wants, self.radius)
        if self.kind == "laplacian":
            blur, (along, across) = blur_taps(self.blur_size), _laplacian_taps(self.kernel_size)
            middle = grown(there, max(self.kernel_size // 2, 1))
            smooth = taps(gray, has, middle, blur, blur)
            e = np.abs(taps(smooth, middle, there, along, across) + taps(smooth, middle, there, across, along))
        elif self.kind == "variance":
            mean, square = (taps(p, has, there, (1,) * 5, (1,) * 5) / 25 for p in (gray, gray * gray))
            e = square - mean * mean
        else:
            gx, gy = taps(gray, has, there, (1, 2, 1), (-1, 0, 1)), taps(gray, has, there, (-1, 0, 1), (1, 2, 1))
            e = np.where(gx * gx + gy * gy > 5, gx * gx + gy * gy, 0.0) if self.kind == "tenengrad" else np.abs(gx) + np.abs(gy)
        return bilateral_filtered(near(e, there, wants, self.radius, self.radius), self.radius, *self.sigmas) if self.radius else e

    def gather(self, norm: np.ndarray | None, e: np.ndarray) -> np.ndarray:
        """What weights need to know of all frames: a sum of powers, or the largest energy and what equals it."""
        if self.map == "average":
            new = np.stack([e, e**self.power])
            return new if norm is None else norm + new
        e = np.round(e, 6) if self.temperature < 1e-4 else e
        if norm is None:
            return np.stack([e, np.ones_like(e)])
        most = np.maximum(norm[0], e)
        if self.temperature < 1e-4:
            count = np.where(norm[0] == most, norm[1], 0) + (e == most)
        else:
            t = self.temperature / self.power
            count = norm[1] * np.exp((norm[0] - most) / t) + np.exp((e - most) / t)
        return np.stack([most, count])

    def weights(self, norm: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A frame's weights, raised to ``power`` and made shares again."""
        if self.map == "average":
            return np.where(norm[0] != 0, e**self.power / np.where(norm[1] == 0, 1, norm[1]), 0.0)
        if self.temperature < 1e-4:
            return (np.round(e, 6) == norm[0]) / norm[1]
        return np.exp((e - norm[0]) / (self.temperature / self.power)) / norm[1]


def _norms(parts: DataFrame, keys: Sequence[str], focus: _Focus, margins: Sequence[int], side: int = tiles.SIDE) -> DataFrame:
    """For each stack and tile what all frames together give (see ``_Focus.gather``), with the margin that blending needs."""
    schema = tiles.tile_schema(parts, keys)
    arrow = tiles.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, norm, wants, spans = None, None, None, None

        def reach(head):
            n = min(head["left"], tiles.STEP)
            return [tiles.Span(head[a], head[b], n, side) for a, b in (("ty", "h"), ("tx", "w"))], margins[n] + focus.reach

        def row():
            where = [s.own[0] for s in spans]
            return tiles.tile_row(arrow, keys, {**tile, "frame_idx": None}, tile["left"], tile["h"], tile["w"], where, norm.reshape(-1))

        for head, has, planes in tiles.frames_of_tiles(batches, keys, reach):
            if tile is None or any(head[c] != tile[c] for c in (*keys, "ty", "tx")):
                if tile is not None:
                    yield row()
                tile, norm = head, None
                spans, margin = reach(head)
                wants = [s.around(0, margin - focus.reach) for s in spans]
            norm = focus.gather(norm, focus.energies(planes, has, wants, [s.size[0] for s in spans]))
        if tile is not None:
            yield row()

    return tiles.met(parts, keys).mapInArrow(run, schema)


def _blend(parts: DataFrame, norms: DataFrame | None, keys: Sequence[str], focus: _Focus | None, smooth_size: int, side: int = tiles.SIDE) -> DataFrame:
    """A pass over the next ``min(left, STEP)`` levels: tile rows of the blended details (null ``frame_idx``), and of each
    frame's next coarse level and weights, or, where that is the last, of its blend (``left`` 0 and null ``frame_idx``).

    The parts' planes are colours and weights, or colours alone with ``norms`` and ``focus`` to weigh them by.
    """
    schema = tiles.tile_schema(parts, keys)
    arrow = tiles.arrow_schema(schema)
    margins, more = _margins(smooth_size // 2), focus.reach if focus else 0
    if norms is not None:
        at = [F.expr(f"{c}0 div {side}").alias(f"t{c}") for c in "yx"]
        first = norms.select(*keys, F.lit(-1).cast("long").alias("frame_idx"), "left", "h", "w", *at, F.lit(0).cast("long").alias("n"), F.lit("").alias("kind"), "data")
        parts = first.unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sums, spans, norm = None, [], [], None

        def reach(head):
            n = min(head["left"], tiles.STEP)
            return [tiles.Span(head[a], head[b], n, side) for a, b in (("ty", "h"), ("tx", "w"))], margins[n] + more

        def add(k: int, planes: np.ndarray, weights: np.ndarray) -> None:
            new = np.concatenate([planes * weights, weights[None]])
            if k == len(sums):
                sums.append(new)
            else:
                sums[k] += new

        def blended() -> Iterator[pa.RecordBatch]:
            n = min(tile["left"], tiles.STEP)
            means = [np.where(s[3] > 1e-8, s[:3] / np.where(s[3] > 1e-8, s[3], 1), 0.0) for s in sums]
            if n:
                data, where = np.concatenate([m.reshape(-1) for m in means[:n]]), [s.own[0] for s in spans]
                yield tiles.tile_row(arrow, keys, {**tile, "frame_idx": None}, tile["left"], tile["h"], tile["w"], where, data)
            if len(means) > n:
                own = [s.own[n] for s in spans]
                yield tiles.tile_row(arrow, keys, {**tile, "frame_idx": None}, 0, spans[0].size[n], spans[1].size[n], own, means[n])

        def normed() -> Iterator[dict]:
            nonlocal norm
            for row in tiles.rows_of(batches):
                if row["frame_idx"] == -1:
                    pending[tuple(row[c] for c in (*keys, "ty", "tx"))] = np.frombuffer(row["data"], "<f8")
                else:
                    yield row

        pending: dict[tuple, np.ndarray] = {}
        for head, has, planes in tiles.frames_of_rows(normed(), keys, reach):
            if tile is None or any(head[c] != tile[c] for c in (*keys, "ty", "tx")):
                if tile is not None:
                    yield from blended()
                tile, sums = head, []
                spans, margin = reach(head)
                norm = pending.pop(tuple(head[c] for c in (*keys, "ty", "tx")), None)
            n, sizes = min(head["left"], tiles.STEP), [s.size[0] for s in spans]
            if focus:
                wants = [s.around(0, margin - more) for s in spans]
                e = focus.energies(planes, has, wants, sizes)
                planes = np.concatenate([tiles.cut(planes, has, wants), focus.weights(norm.reshape(2, *e.shape), e)[None]])
                has = wants
            if smooth_size > 1:
                wants = [s.around(0, margins[n] - smooth_size // 2) for s in spans]
                r, taps = smooth_size // 2, blur_taps(smooth_size | 1)
                at = [tiles.mirrored(np.arange(lo - r, hi + r), size) - h[0] for (lo, hi), size, h in zip(wants, sizes, has, strict=True)]
                smooth = tiles.convolved(planes[3][at[0][:, None], at[1]], taps)
                planes, has = np.concatenate([tiles.cut(planes[:3], has, wants), smooth[None]]), wants
            for k in range(n):
                wants = [s.around(k + 1, _margins(0)[n - k - 1] or tiles.AROUND) for s in spans]
                coarse = tiles.reduced(planes, has, wants, [s.size[k] for s in spans], BINOMIAL)
                out_at = [s.around(k, tiles.AROUND if k else 0) for s in spans]
                here = tiles.cut(planes, has, out_at)
                detail = here[:3] - tiles.expanded(coarse[:3], wants, out_at, [s.size[k + 1] for s in spans], BINOMIAL)
                add(k, detail, here[3])
                planes, has = coarse, wants
            own = [s.own[n] for s in spans]
            planes = tiles.cut(planes, has, own)
            if head["left"] == n:
                add(n, planes[:3], planes[3])
            else:
                yield tiles.tile_row(arrow, keys, head, head["left"] - n, spans[0].size[n], spans[1].size[n], own, planes)
        if tile is not None:
            yield from blended()

    return tiles.met(parts, keys).mapInArrow(run, schema)


def _blended(parts: DataFrame, keys: Sequence[str], depth: int, focus: _Focus | None, smooth_size: int) -> DataFrame:
    """Passes from fine to coarse and back, all stacks at once; what a pass leaves is written."""
    norms = written(_norms(parts, keys, focus, _margins(smooth_size // 2)), "norms", **TILE_ROWS) if focus else None
    done: list[DataFrame] = []
    while True:
        done.append(written(_blend(parts, norms, keys, focus, smooth_size), "blend", **TILE_ROWS))
        active = done[-1].filter("frame_idx is not null")
        if active.select("left").isEmpty():
            break
        parts, norms, focus, smooth_size = tiles.parts_of_tiles(active, keys, _margins(0)), None, None, 1
    margins, image, levels = [tiles.AROUND] * (tiles.STEP + 1), None, None
    for k in range(len(done) - 1, -1, -1):
        details = done[k].filter("frame_idx is null and left > 0")
        last = done[k].filter("frame_idx is null and left = 0")
        coarse = last if image is None else last.unionByName(image)
        levels = details.select(*keys, "left").distinct()
        sized = coarse.drop("left", "frame_idx").join(levels, list(keys)).withColumn("frame_idx", F.lit(0).cast("long"))
        flat = coarse.join(levels.select(*keys), list(keys), "left_anti")  # images of stacks without levels here
        image = tiles.rebuild(details, tiles.parts_of_tiles(sized, keys, margins, shrink=True), keys, BINOMIAL).unionByName(flat)
        if k:
            image = written(image, "image", **TILE_ROWS)
    return tiles.unpack_tiles(image, keys, frames=False, whole=(1 << depth) - 1, signed=True)


def focus_stack_depthmap(
    px: DataFrame, energy: str = "laplacian", map_: str = "max", temperature: float = 0.0, power: float = 1.0, levels: int = 5, depth: int = 8,
    kernel_size: int = 5, blur_size: int = 5, energy_smooth_size: int = 1, sigma_color: float = 0.8, sigma_space: float = 2.0,
    pyramid_smooth_size: int = 1, keys: Sequence[str] = ("stack_id",),
) -> DataFrame:
    """Fusion by a depth map: ``keys, y, x, b, g, r``, for many stacks of any shapes at once.

    The energy of each gray frame is smoothed (unless ``energy_smooth_size`` is 0) and turned to weights over the frames,
    by which the frames are blended on pyramids of ``levels`` levels. Tiles of frames meet twice, first for what all frames
    together give, then to be weighed and blended; a task holds one frame of a tile at a time.
    """
    keys, focus = list(keys), _Focus(energy, kernel_size, blur_size, energy_smooth_size, sigma_color, sigma_space, map_, temperature, power)
    sized = tiles.sized(px, keys)
    sized = sized.select(*keys, "frame_idx", *(F.col(c).cast("long") for c in ("y", "x", "h", "w")), *BGR, F.lit(levels - 1).cast("long").alias("left"))
    margins = [m + focus.reach for m in _margins(pyramid_smooth_size // 2)]
    return _blended(written(tiles.parts_of_pixels(sized, keys, margins), "parts", **TILE_ROWS), keys, depth, focus, pyramid_smooth_size)
