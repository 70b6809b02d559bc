"""Hot pixels: found on the mean frame, repaired from their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .stencil import BINOMIAL, stencil, with_size

BGR = ("b", "g", "r")


def mean_frame(px: DataFrame, max_frames: int | None = None, depth: int = 8) -> DataFrame:
    """The mean of the first frames of each stack, cut to whole numbers: ``stack_id, y, x, b, g, r``. Values of 16 bits are
    divided by 256 before, so differences are in 8-bit units at either depth."""
    some = px if max_frames is None else px.filter(F.col("frame_idx") < max_frames)
    scale = 256.0 if depth == 16 else 1.0
    return some.groupBy("stack_id", "y", "x").agg(*(F.floor(F.avg(F.col(c) / scale)).cast("long").alias(c) for c in BGR))


def differences(mean: DataFrame, lab: bool = False) -> DataFrame:
    """Absolute differences to the 5 x 5 Gaussian blur (rounded): ``d_b, d_g, d_r`` and their length ``d``, or with ``lab``
    the distance in 8-bit Lab for ``d``."""
    blurred = stencil(with_size(mean), BINOMIAL, None, BGR, ["stack_id"], [f"s_{c}" for c in BGR])
    rounded = {f"d_{c}": F.abs(F.col(c) - F.floor((F.col(f"s_{c}") + 128) / 256)).cast("long") for c in BGR}
    far = F.sqrt(sum((F.col(f"d_{c}") * F.col(f"d_{c}") for c in BGR), F.lit(0)).cast("double"))
    if lab:
        a = color.bgr_to_lab("b", "g", "r", 8)
        b = color.bgr_to_lab(*(F.floor((F.col(f"s_{c}") + 128) / 256).cast("long") for c in BGR), 8)
        far = F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "lab"), F.lit(0)).cast("double"))
    return blurred.withColumns(rounded).withColumn("d", far).select("stack_id", "y", "x", *rounded, "d")


def hot_pixel_curve(diff: DataFrame) -> DataFrame:
    """(stack_id, channel, threshold, n): the pixels of each channel that differ by at least each threshold met."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"d_{c}").alias("threshold")) for c in BGR)))
    counts = diff.select("stack_id", each.alias("p")).groupBy("stack_id", "p.channel", "p.threshold").agg(F.count("*").alias("k"))
    w = Window.partitionBy("stack_id", "channel").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("stack_id", "channel", "threshold", F.sum("k").over(w).alias("n"))


def hot_pixels_rgb(diff: DataFrame, n: int = 0, fixed: int = 13) -> DataFrame:
    """Hot where any channel exceeds its threshold: a fixed one, or the one that about n pixels of it exceed."""
    thresholds = {c: F.lit(fixed) for c in BGR}
    if n > 0:
        reached = hot_pixel_curve(diff).filter(F.col("n") >= n)
        found = reached.groupBy("stack_id").pivot("channel", list(BGR)).agg(F.max("threshold") - 1)
        diff = diff.join(found.withColumnsRenamed({c: f"t_{c}" for c in BGR}), "stack_id", "left")
        thresholds = {c: F.col(f"t_{c}") for c in BGR}
    hot: Column = F.lit(False)
    for c in BGR:
        hot = hot | F.coalesce(F.col(f"d_{c}") > thresholds[c], F.lit(False))
    return diff.filter(hot).select("stack_id", "y", "x")


def hot_pixels_norm(diff: DataFrame, n: int = 0, k: float = 3.0, step: float = 0.01) -> DataFrame:
    """Hot by the length of the colour difference: the n largest (whole bins of ``step``), or beyond mean + k std."""
    if n > 0:
        least = diff.groupBy("stack_id").agg(F.min("d").alias("least"))
        binned = diff.join(least, "stack_id").withColumn("bin", F.floor(F.round((F.col("d") - F.col("least")) / step, 6)))
        counts = binned.groupBy("stack_id", "bin").agg(F.count("*").alias("m"))
        w = Window.partitionBy("stack_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        edge = counts.withColumn("above", F.sum("m").over(w)).filter(F.col("above") >= n).groupBy("stack_id").agg(F.max("bin").alias("edge"))
        return binned.join(edge, "stack_id").filter("bin >= edge").select("stack_id", "y", "x")
    bar = diff.groupBy("stack_id").agg((F.avg("d") + k * F.stddev_pop("d")).alias("bar"))
    return diff.join(bar, "stack_id").filter(F.round("d", 6) >= F.round("bar", 6)).select("stack_id", "y", "x")


def count_guard(hot: DataFrame, limit: int = 2000, strict: bool = False) -> DataFrame:
    """(stack_id, n, too_many): strict raises where a stack has more hot pixels than ``limit``."""
    counts = hot.groupBy("stack_id").agg(F.count("*").alias("n"))
    over = F.col("n") > limit
    if strict:
        return counts.withColumn("too_many", F.when(over, F.raise_error(F.lit("too many hot pixels")).cast("boolean")).otherwise(False))
    return counts.withColumn("too_many", over)


def select_hot_pixels(px: DataFrame, hot: DataFrame) -> DataFrame:
    """The pixels of all frames at hot places."""
    return px.join(hot.select("stack_id", "y", "x"), ["stack_id", "y", "x"], "left_semi")


def union_of_masks(*masks: DataFrame) -> DataFrame:
    """Places that are hot in any of the masks, each once."""
    out = masks[0].select("stack_id", "y", "x")
    for more in masks[1:]:
        out = out.union(more.select("stack_id", "y", "x"))
    return out.distinct()


def repair_hot_pixels(px: DataFrame, hot: DataFrame, kernel: int = 3, how: str = "mean") -> DataFrame:
    """Hot places of every frame get the mean or median of the non-zero values around them, of the original channel.

    The few hot places are exploded to their windows; the pixels themselves are not multiplied.
    """
    r = kernel // 2
    steps = F.array(*(F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j in range(-r, r + 1) for i in range(-r, r + 1)))
    near = hot.withColumn("o", F.explode(steps)).select(
        "stack_id", F.col("y").alias("hy"), F.col("x").alias("hx"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")
    )
    value = (lambda c: F.avg(c)) if how == "mean" else (lambda c: F.median(c))
    around = px.join(near, ["stack_id", "y", "x"]).groupBy("stack_id", "frame_idx", F.col("hy").alias("y"), F.col("hx").alias("x"))
    fixed = around.agg(*(value(F.when(F.col(c) != 0, F.col(c))).alias(f"n_{c}") for c in BGR))
    both = px.join(fixed, ["stack_id", "frame_idx", "y", "x"], "left")
    return both.withColumns({c: F.coalesce(F.floor(F.col(f"n_{c}")).cast("long"), F.col(c)) for c in BGR}).drop(*(f"n_{c}" for c in BGR))
