"""Laplacian pyramids and focus fusion by them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce as reduce_by

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import TILE_ROWS, written
from . import tiles
from .stencil import FRAME, GENERATING, grown, reduce, shuffled, stencil

BGR = ("b", "g", "r")


def levels_for(height: int, width: int, min_size: int = 32) -> int:
    """Reductions until the smaller side nears ``min_size``; none leaves a side under 4."""
    n, out = max(0, int(math.log2(min(height, width) / min_size))) if min(height, width) > min_size else 0, 0
    h, w = height, width
    while out < n and min((h + 1) // 2, (w + 1) // 2) >= 4:
        h, w, out = (h + 1) // 2, (w + 1) // 2, out + 1
    return out


def float_gray() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def laplacian_pyramid(px: DataFrame, levels: int, keys: Sequence[str] = FRAME, cols: Sequence[str] = BGR) -> list[DataFrame]:
    """Details from fine to coarse, the coarsest image last; each ``keys, y, x, h, w`` and ``cols`` as doubles.

    The number of levels is a parameter of the plan: frames of one call share a shape (see ``validate_stack``). Coarse
    levels are written, so the plan of a level does not hold those of the levels before it.
    """
    level = tiles.sized(px, [k for k in keys if k != "frame_idx"] or list(keys))
    level = level.select(*keys, *(F.col(c).cast("long") for c in ("y", "x", "h", "w")), *(F.col(c).cast("double") for c in cols))
    out = []
    for _ in range(levels):
        coarse = written(reduce(level, cols, keys), "level")  # each level is read three times
        up = grown(coarse, cols, keys).withColumnsRenamed({c: f"up_{c}" for c in cols})
        detail = level.join(shuffled(up), [*keys, "y", "x"])
        out.append(detail.select(*keys, "y", "x", "h", "w", *((F.col(c) - F.col(f"up_{c}")).alias(c) for c in cols)))
        level = coarse
    return [*out, level]


def focus_argmax(level: DataFrame, keys: Sequence[str] = ("stack_id",), digits: int = 6) -> DataFrame:
    """Per place the colours of the frame with the most energy: the smoothed square of the gray detail.

    Energies are compared to ``digits`` digits and ties go to the first frame, so the result does not depend on the
    order of summation.
    """
    energy = stencil(level.withColumn("e", float_gray() * float_gray()), GENERATING, None, ["e"], [*keys, "frame_idx"])
    best = F.max(F.struct(F.round(F.col("e") / 400, digits), -F.col("frame_idx"), *BGR, "h", "w")).alias("best")
    return energy.groupBy(*keys, "y", "x").agg(best).select(*keys, "y", "x", *(f"best.{c}" for c in (*BGR, "h", "w")))


def base_fusion(level: DataFrame, window: int = 5, keys: Sequence[str] = ("stack_id",), digits: int = 6) -> DataFrame:
    """The coarsest level: the mean of two winners' colours, by windowed entropy and by windowed deviation.

    Entropy adds gray level times its negative log frequency in the frame over the window.
    """
    frame = [*keys, "frame_idx"]
    gray = level.withColumn("v", F.floor(float_gray()))
    hist = gray.groupBy(*frame, "v").agg(F.count("*").alias("n"))
    total = gray.groupBy(*frame).agg(F.count("*").alias("all"))
    logs = hist.join(total, frame).select(*frame, "v", F.log(F.col("n") / F.col("all")).alias("lp"))
    terms = gray.join(logs, [*frame, "v"]).withColumns(
        {"t": -F.col("v") * F.col("lp"), "v2": (F.col("v") * F.col("v")).cast("double"), "v": F.col("v").cast("double")}
    )
    ones = [1] * window
    sums = stencil(terms, ones, None, ["t", "v", "v2"], frame)
    n = float(window * window)
    deviation = F.col("v2") / n - (F.col("v") / n) * (F.col("v") / n)

    def winner(score: Column) -> Column:
        return F.max(F.struct(F.round(score, digits), -F.col("frame_idx"), *BGR))

    both = sums.groupBy(*keys, "y", "x").agg(
        winner(F.col("t")).alias("e"), winner(deviation).alias("d"), F.first("h").alias("h"), F.first("w").alias("w")
    )
    return both.select(*keys, "y", "x", "h", "w", *(((F.col(f"e.{c}") + F.col(f"d.{c}")) / 2).alias(c) for c in BGR))


def collapse(pyramid: list[DataFrame], keys: Sequence[str] = ("stack_id",), cols: Sequence[str] = BGR) -> DataFrame:
    """The image of a pyramid, from its coarsest level up."""
    image = pyramid[-1]
    for detail in pyramid[-2::-1]:
        up = grown(image, cols, keys).withColumnsRenamed({c: f"up_{c}" for c in cols})
        both = detail.join(shuffled(up), [*keys, "y", "x"])
        image = both.select(*keys, "y", "x", "h", "w", *((F.col(c) + F.col(f"up_{c}")).alias(c) for c in cols))
    return image


def focus_stack_pyramid(px: DataFrame, levels: int | None = None, depth: int = 8, keys: Sequence[str] = ("stack_id",), min_size: int = 32) -> DataFrame:
    """All-in-focus images of many stacks at once: ``keys, y, x, b, g, r`` as whole numbers.

    ``px`` has ``keys``, ``frame_idx``, ``y``, ``x`` and colours. Stacks may differ in shape: each has ``levels``
    reductions, by default until the smaller side nears ``min_size``. A stack of one frame comes out as it is, up to
    rounding down. Frames are worked on by tiles, in passes of several levels (see ``tiles``).
    """
    left = tiles.reductions(F.col("h"), F.col("w"), min_size) if levels is None else F.lit(levels).cast("long")
    sizes = tiles.sizes(px, keys, left=left)

    def of(stacks: DataFrame) -> DataFrame:
        sized = px.drop("h", "w", "left").join(stacks, list(keys))
        return sized.select(*keys, "frame_idx", *(F.col(c).cast("long") for c in ("y", "x", "h", "w")), *BGR, "left")

    flat = sizes.filter("left = 0")
    return _fused(tiles.parts_of_pixels(of(sizes.filter("left > 0")), keys), None if flat.isEmpty() else of(flat), depth, keys)


def focus_stack_tiles(frames: DataFrame, depth: int = 8, keys: Sequence[str] = ("stack_id",), min_size: int = 32) -> DataFrame:
    """``focus_stack_pyramid`` of tile rows (see ``tiles.pack_tiles``)."""
    frames = frames.withColumn("left", tiles.reductions(F.col("h"), F.col("w"), min_size))
    flat = frames.filter("left = 0")
    return _fused(tiles.parts_of_tiles(frames.filter("left > 0"), keys), None if flat.select("h").isEmpty() else tiles.unpack_tiles(flat, keys), depth, keys)


def _fused(parts: DataFrame, flat: DataFrame | None, depth: int, keys: Sequence[str]) -> DataFrame:
    """Passes from fine to coarse, the base of all stacks, and passes back. ``flat`` has the pixels of stacks without levels,
    if there are any.

    What a pass leaves is written, so each is done once, and the number of passes is that of the largest frames. So are the
    coarsest images, which the base reads several times.
    """
    columns = [*keys, "frame_idx", "y", "x", "h", "w", *BGR]

    def coarsest(images: DataFrame, passes: int) -> DataFrame:
        return written(images.select(*columns[:-3], *(F.col(c).cast("double") for c in BGR), F.lit(passes).alias("passes")), "bottom")

    bottom = [coarsest(flat, 0)] if flat is not None else []
    done: list[DataFrame] = []
    while True:
        both = written(tiles.fuse_details(parts, keys), "tiles", **TILE_ROWS)
        coarse = both.filter("frame_idx is not null")
        if both.select("left").isEmpty():
            break
        done.append(both.filter("frame_idx is null"))
        bottom.append(coarsest(tiles.unpack_tiles(coarse.filter("left = 0"), keys), len(done)))
        active = coarse.filter("left > 0")
        if active.select("left").isEmpty():
            break
        parts = tiles.parts_of_tiles(active, keys)
    if not bottom:  # no pixels at all
        bottom = [coarsest(tiles.unpack_tiles(coarse, keys), 0)]
    bottom = reduce_by(DataFrame.unionByName, bottom)
    passes = bottom.select(*keys, "passes").distinct()
    base = written(base_fusion(bottom.drop("passes"), keys=keys).join(passes, list(keys)), "base")
    most, image = (1 << depth) - 1, None
    levels = [d.select(*keys, "left").distinct() for d in done]
    margins = [tiles.AROUND] * (tiles.STEP + 1)
    for k in range(len(done) - 1, -1, -1):
        reached = base.filter(F.col("passes") == k + 1).drop("passes").withColumn("frame_idx", F.lit(0).cast("long"))
        parts = tiles.parts_of_pixels(reached.join(levels[k], list(keys)), keys, margins, shrink=True)
        if image is not None:
            finer = image.drop("left", "frame_idx").join(levels[k], list(keys)).withColumn("frame_idx", F.lit(0).cast("long"))
            parts = parts.unionByName(tiles.parts_of_tiles(finer, keys, margins, shrink=True))
        image = tiles.rebuild(done[k], parts, keys)
        if k:
            image = written(image, "image", **TILE_ROWS)
    out = [F.floor(F.round(F.least(F.abs(c), F.lit(float(most))), 6)).cast("long").alias(c) for c in BGR]
    small = base.filter("passes = 0").select(*keys, "y", "x", *out)
    return small if image is None else small.unionByName(tiles.unpack_tiles(image, keys, frames=False, whole=most))
