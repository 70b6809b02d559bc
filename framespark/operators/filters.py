"""Filters on fused images: sharpening, local tone mapping, denoising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .stencil import FRAME, gaussian_taps, stencil


def unsharp_mask(px: DataFrame, radius: float = 1.0, amount: float = 1.0, threshold: float = 0.0, depth: int = 8, cols: tuple[str, ...] = ("b", "g", "r"), keys=FRAME) -> DataFrame:
    """v (1 + amount) - amount * blur, rounded and clipped, where the blur differs by more than ``threshold``."""
    blurred = stencil(px, gaussian_taps(radius), None, list(cols), list(keys), [f"s_{c}" for c in cols])
    blurred = blurred.withColumns({f"s_{c}": F.floor(F.round(f"s_{c}", 6) + 0.5) for c in cols})
    limit, most = threshold * (256 if depth == 16 else 1), float((1 << depth) - 1)

    def sharp(c: str):
        v = F.floor(F.round(F.col(c) * (1 + amount) - amount * F.col(f"s_{c}"), 6) + 0.5)
        v = F.greatest(F.lit(0.0), F.least(v, F.lit(most))).cast("long")
        return v if threshold == 0 else F.when(F.abs(F.col(c) - F.col(f"s_{c}")) > limit, v).otherwise(F.col(c))

    return blurred.withColumns({c: sharp(c) for c in cols}).drop(*(f"s_{c}" for c in cols))


def local_tonemap(px: DataFrame, amount: float = 0.5, clip: float = 2.0, tiles: int = 2, col: str = "v", keys=FRAME) -> DataFrame:
    """Contrast-limited adaptive equalisation of an 8-bit column, mixed with the original by ``amount``.

    Each tile's histogram is clipped and the excess shared out; a pixel blends the tables of the four nearest tiles.
    Sides should be multiples of ``tiles``. All of it is group-bys, windows and joins. ``px`` has ``h`` and ``w``.
    """
    keys = list(keys)
    th, tw = F.col("h") / tiles, F.col("w") / tiles
    tiled = px.withColumns({"ty": F.floor(F.col("y") / th), "tx": F.floor(F.col("x") / tw)})
    counts = tiled.groupBy(*keys, "ty", "tx", F.col(col).cast("long").alias("value")).agg(F.count("*").alias("n"))
    sizes = tiled.groupBy(*keys, "ty", "tx").agg(F.count("*").alias("area"))
    dense = sizes.withColumn("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))))
    dense = dense.join(counts, [*keys, "ty", "tx", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.greatest(F.floor(clip * F.col("area") / 256), F.lit(1))
    tile = Window.partitionBy(*keys, "ty", "tx")
    excess = F.sum(F.greatest(F.col("n") - limit, F.lit(0))).over(tile)
    dense = dense.withColumns({"cut": F.least("n", limit), "excess": excess})
    share, left = F.floor(F.col("excess") / 256), F.col("excess") % 256
    step = F.greatest(F.floor(256 / F.greatest(left, F.lit(1))), F.lit(1))
    extra = F.when((left > 0) & (F.col("value") % step == 0) & (F.floor(F.col("value") / step) < left), 1).otherwise(0)
    running = F.sum(F.col("cut") + share + extra).over(tile.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    lut = dense.select(*keys, "ty", "tx", "value", F.floor(running * 255.0 / F.col("area") + 0.5).alias("out"))
    gy, gx = (F.col("y") + 0.5) / th - 0.5, (F.col("x") + 0.5) / tw - 0.5
    placed = px.withColumns({"gy": gy, "gx": gx})
    four = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1))))
    spread = placed.withColumn("o", four)
    fy, fx = F.col("gy") - F.floor("gy"), F.col("gx") - F.floor("gx")
    wy = F.when(F.col("o.j") == 1, fy).otherwise(1 - fy)
    wx = F.when(F.col("o.i") == 1, fx).otherwise(1 - fx)
    clamp = lambda v: F.greatest(F.lit(0).cast("long"), F.least(v, F.lit(tiles - 1).cast("long")))
    asked = spread.select(*keys, "y", "x", F.col(col).cast("long").alias("value"), (wy * wx).alias("wt"),
                          clamp(F.floor("gy") + F.col("o.j")).alias("ty"), clamp(F.floor("gx") + F.col("o.i")).alias("tx"))
    mixed = asked.join(lut, [*keys, "ty", "tx", "value"]).groupBy(*keys, "y", "x").agg(F.max("value").alias("v0"), F.sum(F.col("wt") * F.col("out")).alias("v1"))
    blend = F.floor(F.round((1 - amount) * F.col("v0") + amount * F.floor(F.round("v1", 6) + 0.5), 6) + 0.5).cast("long")
    return mixed.select(*keys, "y", "x", blend.alias(col))


def local_tonemap_color(px: DataFrame, amount: float = 0.5, clip: float = 2.0, tiles: int = 2, depth: int = 8, keys=FRAME) -> DataFrame:
    """``local_tonemap`` of colour frames of 8 or 16 bits: their Lab lightness is equalised as 8-bit values and mixed with
    the original; a and b stay. ``px`` has ``h`` and ``w``."""
    if amount <= 0:
        return px.drop("h", "w")
    keys = list(keys)
    lab = px.select(*keys, "y", "x", "h", "w", color.bgr_to_lab("b", "g", "r", depth).alias("lab"))
    most = float(color.top(depth))
    eight = lab.withColumn("v", F.floor(F.col("lab.l") / most * 255.0).cast("long"))
    done = local_tonemap(eight, 1.0, clip, tiles, "v", keys).withColumnRenamed("v", "equal")
    lifted = F.floor(F.col("equal") / 255.0 * most)
    mixed = F.floor(F.round((1 - min(amount, 1.0)) * F.col("lab.l") + min(amount, 1.0) * lifted, 6) + 0.5).cast("long")
    both = lab.join(done, [*keys, "y", "x"]).withColumn("l", mixed)
    return both.select(*keys, "y", "x", color.lab_to_bgr("l", "lab.a", "lab.b", depth).alias("c")).select(*keys, "y", "x", "c.*")


def denoise(
    px: DataFrame, h: float = 10.0, template: int = 7, search: int = 21, tile: int = 64, cols: tuple[str, ...] = ("b", "g", "r"), keys=FRAME, depth: int = 8
) -> DataFrame:
    """Non-local means: every pixel becomes the mean of the search window, weighted by patches' likeness.

    Patches are held against each other by mean squared difference; 16-bit frames by the square of the mean over the patch of
    absolute differences added up over the channels, divided by the number of channels, with 256 times ``h``. Frames are
    mirrored at their ends without repeating the edge.

    Works on tiles with a halo of the window and patch radius, one group a tile, so its memory is bounded by ``tile``.
    """
    keys, wide = list(keys), depth == 16
    h = h * 256 if wide else h
    halo = search // 2 + template // 2
    frame_keys = ", ".join(f"{k} long" for k in keys)
    reach = -(-halo // tile)
    near = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1))))
    spread = px.withColumn("o", near).withColumns(
        {"ty": F.floor(F.col("y") / tile) + F.col("o.j"), "tx": F.floor(F.col("x") / tile) + F.col("o.i")}
    )
    inside = (F.col("y") >= F.col("ty") * tile - halo) & (F.col("y") < (F.col("ty") + 1) * tile + halo)
    inside &= (F.col("x") >= F.col("tx") * tile - halo) & (F.col("x") < (F.col("tx") + 1) * tile + halo)
    inside &= (F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile < F.col("h")) & (F.col("tx") * tile < F.col("w"))
    dealt = spread.filter(inside).select(*keys, "ty", "tx", "y", "x", *(F.col(c).cast("double") for c in cols))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        shape = int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1
        image = np.zeros((*shape, len(cols)))
        image[pdf["y"] - y0, pdf["x"] - x0] = pdf[list(cols)].to_numpy()
        padded = np.pad(image, ((halo, halo), (halo, halo), (0, 0)), mode="reflect")
        total, weight = np.zeros_like(image), np.zeros(shape)
        r, t = search // 2, template // 2
        base = padded[r : r + shape[0] + 2 * t, r : r + shape[1] + 2 * t]
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                other = padded[r + dy : r + dy + shape[0] + 2 * t, r + dx : r + dx + shape[1] + 2 * t]
                gap = (np.abs(base - other) if wide else (base - other) ** 2).mean(axis=2)
                area = np.pad(gap.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
                patch = (area[template:, template:] - area[:-template, template:] - area[template:, :-template] + area[:-template, :-template]) / template**2
                patch = np.maximum(patch, 0)
                w = np.exp(-(len(cols) * patch * patch if wide else patch) / (h * h))
                weight += w
                total += w[..., None] * other[t : t + shape[0], t : t + shape[1]]
        done = np.floor(total / weight[..., None] + 0.5).astype(np.int64)
        own = (pdf["y"] // tile == pdf["ty"]) & (pdf["x"] // tile == pdf["tx"])
        out = pdf.loc[own, [*keys, "y", "x"]].copy()
        for k, c in enumerate(cols):
            out[c] = done[out["y"] - y0, out["x"] - x0, k]
        return out

    fields = ", ".join(f"{c} long" for c in cols)
    return dealt.groupBy(*keys, "ty", "tx").applyInPandas(run, f"{frame_keys}, y long, x long, {fields}")


def map_frames(df: DataFrame, fn, schema: str, keys=FRAME) -> DataFrame:
    """A user's function on one frame at a time, as a pandas table; a frame must fit one task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """A user's function on batches of pixels in any order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
