"""Layered stacks: merging folders to layers, ordering, flattening, rotating, retouching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BGR = ("b", "g", "r")


def to_layers(frames: DataFrame, labels: str | None = None, reverse: bool = True) -> DataFrame:
    """(stack_id, layer_idx, label, …): frames of all sources in order; labels are file stems or numbers."""
    order = [F.col(c) for c in (("source_idx", "frame_idx") if "source_idx" in frames.columns else ("frame_idx",))]
    rank = F.row_number().over(Window.partitionBy("stack_id").orderBy(*order))
    n = F.count("*").over(Window.partitionBy("stack_id"))
    label = F.format_string("Layer %03d", F.col("rank")) if labels == "number" else F.regexp_extract("path", r"([^/]*?)\.[^./]+$", 1)
    ranked = frames.withColumns({"rank": rank, "n": n}).withColumn("label", label)
    place = F.col("n") - F.col("rank") if reverse else F.col("rank") - 1
    return ranked.withColumn("layer_idx", place.cast("long")).drop("rank", "n")


def check_layers(frames: DataFrame) -> DataFrame:
    """(stack_id, ok): all frames of a stack share shape, depth and extension."""
    kinds = F.count_distinct("width", "height", "channels", "bit_depth", "ext")
    return frames.groupBy("stack_id").agg((kinds == 1).alias("ok"))


def flatten_layers(layers: DataFrame) -> DataFrame:
    """The topmost of opaque whole-frame layers: the largest ``layer_idx``."""
    top = F.max(F.struct("layer_idx", *BGR)).alias("t")
    return layers.groupBy("stack_id", "y", "x").agg(top).select("stack_id", "y", "x", *(f"t.{c}" for c in BGR))


def read_layers(layers: DataFrame) -> DataFrame:
    """Layers as an editor opens them: reversed, the layer named master first; nameless ones are numbered."""
    back = F.row_number().over(Window.partitionBy("stack_id").orderBy(F.desc("layer_idx")))
    named = layers.withColumn("back", back).withColumn("label", F.coalesce("label", F.concat(F.lit("Layer "), F.col("back").cast("string"))))
    master = F.lower("label") == "master"
    order = Window.partitionBy("stack_id").orderBy(F.when(master, 0).otherwise(1), "back")
    return named.withColumns({"is_master": master, "layer_idx": (F.row_number().over(order) - 1).cast("long")}).drop("back")


def sort_layers(layers: DataFrame, order: str = "asc") -> DataFrame:
    """By label regardless of case; the first whose label holds master or stack stays on top."""
    if order not in ("asc", "desc"):
        raise ValueError(f"bad order: {order}")
    low = F.lower("label")
    pinned = low.contains("master") | low.contains("stack")
    nth = F.row_number().over(Window.partitionBy("stack_id", "p").orderBy("layer_idx"))
    marked = layers.withColumn("p", pinned).withColumn("pin", F.col("p") & (nth == 1))
    key = low.asc() if order == "asc" else low.desc()
    by = Window.partitionBy("stack_id").orderBy(F.when(F.col("pin"), 0).otherwise(1), key, "layer_idx")
    return marked.withColumn("new_idx", (F.row_number().over(by) - 1).cast("long")).drop("p", "layer_idx").withColumnRenamed("new_idx", "layer_idx")


def rotate(px: DataFrame, turn: str) -> DataFrame:
    """All layers turned: cw, ccw or half; ``px`` has ``h`` and ``w``, which change places for quarter turns."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
    ny, nx = {"cw": (x, h - 1 - y), "ccw": (w - 1 - x, y), "half": (h - 1 - y, w - 1 - x)}[turn]
    size = {"h": h, "w": w} if turn == "half" else {"h": w, "w": h}
    return px.withColumns({"y": ny, "x": nx} | size)


def unpivot_channels(px: DataFrame) -> DataFrame:
    keys = [c for c in px.columns if c not in BGR]
    return px.unpivot(keys, list(BGR), "channel", "value")


def pivot_channels(long: DataFrame) -> DataFrame:
    keys = [c for c in long.columns if c not in ("channel", "value")]
    return long.groupBy(*keys).pivot("channel", list(BGR)).agg(F.first("value"))


def pick_colour(px: DataFrame, x: int, y: int, radius: int, depth: int = 8) -> DataFrame:
    """(stack_id, frame_idx, b, g, r): the mean colour of a disc, of 8 bits, cut to whole numbers."""
    dx, dy = F.col("x") - x, F.col("y") - y
    disc = px.filter(dx * dx + dy * dy <= radius * radius)
    k = 256 if depth == 16 else 1
    return disc.groupBy("stack_id", "frame_idx").agg(*(F.floor(F.avg(c) / k).cast("long").alias(c) for c in BGR))


def brush_profile(r: Column, hardness: float) -> Column:
    """The weight of a brush at a share r of its radius; hardness from 0 to 1."""
    if 2 * hardness - 1 >= 1:
        return F.when(r < 1, 1.0).otherwise(0.0)
    inside = F.least(r, F.lit(1.0))
    if hardness >= 0.5:
        return 0.5 * (F.cos(math.pi * F.pow(inside, F.lit(1 / (1 - hardness)))) + 1)
    return F.when(r < 1, 0.5 * (1 - F.cos(math.pi * F.pow(1 - inside, F.lit(1 / (1 + hardness)))))).otherwise(0.0)


def apply_strokes(
    master: DataFrame, layers: DataFrame, strokes: DataFrame, hardness: float = 0.5, opacity: float = 1.0, flow: float = 1.0,
    luminosity: float = 0.0, depth: int = 8, opacity_once: bool = False,
) -> DataFrame:
    """A batch replay of brush strokes: ``strokes(stack_id, x, y, radius, layer_idx)`` painted from layers on master.

    Strokes of one layer add up to at most 1 at every place, whatever their order. Opacity counts in the mask and in
    the blend, as painting does, unless ``opacity_once``.
    """
    r = F.col("radius")
    spread = strokes.withColumnsRenamed({"x": "cx", "y": "cy"})
    spread = spread.withColumn("dy", F.explode(F.sequence(-r, r))).withColumn("dx", F.explode(F.sequence(-r, r)))
    far = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) / (r + 0.5)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), brush_profile(far, hardness))) * opacity * flow
    covered = spread.select("stack_id", "layer_idx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), weight.alias("m"))
    mask = covered.filter("m > 0").groupBy("stack_id", "layer_idx", "y", "x").agg(F.least(F.lit(1.0), F.sum("m")).alias("m"))
    source = layers.select("stack_id", "layer_idx", "y", "x", *(F.col(c).alias(f"s_{c}") for c in BGR))
    paint = mask.join(source, ["stack_id", "layer_idx", "y", "x"]).drop("layer_idx")
    both = master.join(paint, ["stack_id", "y", "x"], "left")
    m = F.col("m") if opacity_once else F.col("m") * opacity
    most = float((1 << depth) - 1)
    mixed = {
        c: F.when(F.col("m").isNull(), F.col(c)).otherwise(
            F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.col(c) * (1 - m) + F.col(f"s_{c}") * m * (1 + luminosity), F.lit(most))), 6)).cast("long")
        )
        for c in BGR
    }
    return both.withColumns(mixed).drop("m", *(f"s_{c}" for c in BGR))
