"""Histograms and balancing of frames against a reference frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..sources.frames import auto_factor

#: Which values each mode balances: names of channels and, per mode, how to get them.
MODES = ("LUMI", "RGB", "HSV", "HLS", "LAB")


#: For each mode in a colour space: there, back, its channels, and those that are balanced.
_SPACES = {
    "HSV": (color.bgr_to_hsv, color.hsv_to_bgr, "hsv", "sv"),
    "HLS": (color.bgr_to_hls, color.hls_to_bgr, "hls", "ls"),
    "LAB": (color.bgr_to_lab, color.lab_to_bgr, "lab", "l"),
}


def channels(mode: str, depth: int = 8) -> dict[str, Column]:
    """The histogrammed channels of a mode."""
    if mode == "LUMI":
        return {"L": color.gray("b", "g", "r")}
    if mode == "RGB":
        return {c.upper(): F.col(c) for c in "bgr"}
    if mode not in _SPACES:
        raise ValueError(f"unknown mode: {mode}")
    to, _, _, own = _SPACES[mode]
    space = to("b", "g", "r", depth)
    return {c.upper(): space[c] for c in own}


def subsample(px: DataFrame, n: int, fast: bool = True, cols: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Every n-th row and column, or the means of n x n blocks (ragged blocks average what they have)."""
    if fast:
        kept = px.filter((F.col("y") % n == 0) & (F.col("x") % n == 0))
        return kept.withColumns({"y": F.expr(f"y div {n}"), "x": F.expr(f"x div {n}")})
    block = [F.expr(f"{c} div {n}").alias(c) for c in ("y", "x")]
    return px.groupBy("stack_id", "frame_idx", *block).agg(*(F.avg(c).alias(c) for c in cols))


def circular_mask(px: DataFrame, mask_size: float) -> DataFrame:
    """Pixels within the circle of ``mask_size`` times half the shorter side; ``px`` has ``h`` and ``w``."""
    dx, dy = F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2
    radius = F.least("w", "h") * mask_size / 2
    return px.filter(dx * dx + dy * dy <= radius * radius)


def histogram(
    px: DataFrame, mode: str = "LUMI", depth: int = 8, factor: int = 1, mask_size: float = 0.0, fast: bool = True
) -> DataFrame:
    """(stack_id, frame_idx, channel, value, n): partial counts before the one shuffle.

    ``factor`` takes every n-th row and column, or, where not ``fast``, the means of n x n blocks of each channel, rounded;
    0 chooses it for each stack so that some two million pixels are left. ``mask_size`` over 0 counts within that circle
    of the thinned frame alone. ``px`` has ``h`` and ``w`` for a mask or a factor of 0.
    """
    named = channels(mode, depth)
    base = px.select("stack_id", "frame_idx", "y", "x", *(c for c in ("h", "w") if c in px.columns), *(v.cast("long").alias(f"c_{k}") for k, v in named.items()))
    n = auto_factor("balance", F.col("h"), F.col("w")) if factor == 0 else F.lit(factor)
    if factor != 1:
        base = base.withColumn("n", n.cast("long"))
        block = {c: F.expr(f"{c} div n") for c in ("y", "x")} | {c: F.expr(f"({c} + n - 1) div n") for c in ("h", "w") if c in px.columns}
        if fast:
            base = base.filter((F.col("y") % F.col("n") == 0) & (F.col("x") % F.col("n") == 0)).withColumns(block)
        else:
            keys = ["stack_id", "frame_idx", *block]
            base = base.withColumns(block).groupBy(*keys).agg(*(F.floor(F.avg(f"c_{k}") + 0.5).cast("long").alias(f"c_{k}") for k in named))
    if mask_size > 0:
        base = circular_mask(base, mask_size)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(f"c_{k}").alias("value")) for k in named)))
    rows = base.select("stack_id", "frame_idx", pairs.alias("p")).select("stack_id", "frame_idx", "p.*")
    return rows.groupBy("stack_id", "frame_idx", "channel", "value").agg(F.count("*").alias("n"))


def reverse_cumulative(hist: DataFrame) -> DataFrame:
    """Adds ``above``: the pixels of each value or more. Windows over a frame's values, of which there are few."""
    falling = Window.partitionBy("stack_id", "frame_idx", "channel").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("above", F.sum("n").over(falling))


def mid_value(hist: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """The mean value of each histogram over an interval."""
    inside = hist.filter(F.col("value") >= lo) if hi is None else hist.filter(F.col("value").between(lo, hi))
    weight = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return inside.groupBy("stack_id", "frame_idx", "channel").agg(weight.alias("mid"))


def reference_rows(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of each stack's reference frame (without frame_idx)."""
    held = rows.join(refs, "stack_id")
    return held.filter(F.col("frame_idx") == F.col("ref_idx")).drop("frame_idx", "ref_idx")


def linear_correction(hist: DataFrame, refs: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Per frame and channel the ratio of the reference's mid value to its own; 1 for the reference, and where a frame's mid
    value is 0, as of the saturation of gray frames."""
    mid = mid_value(hist, lo, hi)
    ref = reference_rows(mid, refs).withColumnRenamed("mid", "ref_mid")
    return mid.join(ref, ["stack_id", "channel"]).select(
        "stack_id", "frame_idx", "channel", F.when(F.col("mid") == 0, 1.0).otherwise(F.col("ref_mid") / F.nullif("mid", F.lit(0.0))).alias("param")
    )


def gamma_fit(hist: DataFrame, refs: DataFrame, depth: int = 8, steps: int = 42, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Per frame and channel the gamma in [0.1, 5] that brings the corrected mid value to the reference's.

    Bisection folded over each frame's histogram, held as one array of at most 2**depth values; mid values are those of
    the values from ``lo`` to ``hi``.
    """
    hist = hist.filter(F.col("value") >= lo) if hi is None else hist.filter(F.col("value").between(lo, hi))
    mid = mid_value(hist)
    ref = reference_rows(mid, refs).withColumnRenamed("mid", "target")
    whole = hist.groupBy("stack_id", "frame_idx", "channel").agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("bins"), F.sum("n").alias("total")
    )
    most = color.top(depth)

    def mid_at(gamma: Column) -> Column:
        add = lambda acc, p: acc + F.floor(F.pow(p["value"] / float(most), 1 / gamma) * most) * p["n"]
        return F.aggregate("bins", F.lit(0).cast("long"), add) / F.col("total")

    def halve(state: Column, _: Column) -> Column:
        centre = (state["lo"] + state["hi"]) / 2
        below = mid_at(centre) < F.col("target")
        return F.struct(F.when(below, centre).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(centre).alias("hi"))

    start = F.struct(F.lit(0.1).alias("lo"), F.lit(5.0).alias("hi"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return whole.join(ref, ["stack_id", "channel"]).select("stack_id", "frame_idx", "channel", folded.alias("param"))


def cumulative(hist: DataFrame, depth: int = 8) -> DataFrame:
    """(…, value, cdf): the share of pixels up to each value, over all values, scaled to the largest value."""
    most = color.top(depth)
    frames = hist.groupBy("stack_id", "frame_idx", "channel").agg(F.sum("n").alias("total"))
    dense = frames.withColumn("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))))
    full = dense.join(hist, ["stack_id", "frame_idx", "channel", "value"], "left")
    w = Window.partitionBy("stack_id", "frame_idx", "channel").orderBy("value")
    running = F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return full.select("stack_id", "frame_idx", "channel", "value", (running / F.col("total") * most).alias("cdf"))


def match_histogram(hist: DataFrame, refs: DataFrame, depth: int = 8) -> DataFrame:
    """(…, value, out): the table that gives each frame the reference's distribution.

    A frame's cumulated share is looked up in the reference's by linear interpolation: knots and asked shares of a frame
    are sorted together, and each share takes the last knot before it. The first plateau becomes a ramp up to the least
    other result; the last one is carried on towards the largest.
    """
    most = color.top(depth)
    cdf = cumulative(hist, depth)
    by = Window.partitionBy("stack_id", "channel")
    ordered = by.orderBy("value")
    # the last value of a plateau is its knot, but for the highest one, of which it is the first
    knots = reference_rows(cdf, refs).select(
        "stack_id", "channel", F.col("value").alias("v0"), F.col("cdf").alias("c0"), F.lead("cdf").over(ordered).alias("c1"),
        F.lag("cdf").over(ordered).alias("before"), F.max("cdf").over(by).alias("most"),
    )
    rises = F.col("c0") < F.col("c1")
    tops = (F.col("c0") == F.col("most")) & (F.col("before").isNull() | (F.col("before") < F.col("most")))
    knots = knots.filter(rises | tops).withColumn("c1", F.when(tops, None).otherwise(F.col("c1")))
    bounds = knots.groupBy("stack_id", "channel").agg(F.min("c0").alias("least"), F.max("c0").alias("most"))
    asked = cdf.join(bounds, ["stack_id", "channel"]).select(
        "stack_id", "frame_idx", "channel", F.greatest("least", F.least("most", "cdf")).alias("c"), F.lit(1).alias("kind"), "value",
        F.lit(None).cast("struct<v0: bigint, c0: double, c1: double>").alias("knot"),
    )
    frames = hist.select("stack_id", "frame_idx", "channel").distinct()
    held = frames.join(knots, ["stack_id", "channel"]).select(
        "stack_id", "frame_idx", "channel", F.col("c0").alias("c"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("value"),
        F.struct("v0", "c0", "c1").alias("knot"),
    )
    along = Window.partitionBy("stack_id", "frame_idx", "channel").orderBy("c", "kind").rowsBetween(Window.unboundedPreceding, 0)
    first = asked.unionByName(held).withColumn("k", F.last("knot", ignorenulls=True).over(along)).filter("kind = 1")
    step = (F.col("c") - F.col("k.c0")) / (F.col("k.c1") - F.col("k.c0"))
    at = F.col("k.v0") + F.when(F.col("k.c1").isNull(), F.lit(0.0)).otherwise(step)
    lut = first.select("stack_id", "frame_idx", "channel", "value", at.alias("raw"))
    frame = Window.partitionBy("stack_id", "frame_idx", "channel")
    lut = lut.withColumns({"l0": F.min_by("raw", "value").over(frame), "l1": F.max_by("raw", "value").over(frame)})
    inner = (F.col("raw") != F.col("l0")) & (F.col("raw") != F.col("l1"))
    low, high = F.col("raw") == F.col("l0"), F.col("raw") == F.col("l1")
    lut = lut.withColumns(
        {
            "lmin": F.min(F.when(inner, F.col("raw"))).over(frame),
            "lmax": F.max(F.when(inner, F.col("raw"))).over(frame),
            "i0": F.max(F.when(low, F.col("value"))).over(frame),
            "n1": F.count_if(high).over(frame),
        }
    )
    ramp = F.when(F.col("i0") > 0, F.col("value") / F.col("i0") * F.col("lmin")).otherwise(0.0)
    carried = F.col("value") + (F.col("value") - most) * (most - F.col("lmax")) / F.col("n1")
    out = F.when(F.col("lmin").isNull(), F.col("raw")).when(low, ramp).when(high, carried).otherwise(F.col("raw"))
    return lut.select("stack_id", "frame_idx", "channel", "value", F.floor(F.round(out, 6)).cast("long").alias("out"))


def correction_summary(corrections: DataFrame, refs: DataFrame) -> DataFrame:
    """The applied correction per frame and channel: exactly 1 for the reference."""
    held = corrections.join(refs, "stack_id")
    param = F.when(F.col("frame_idx") == F.col("ref_idx"), F.lit(1.0)).otherwise(F.col("param"))
    return held.select("stack_id", "frame_idx", "channel", param.alias("param"))


def _of_channel(corrections: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per frame, a column for each channel: the corrections of a frame are few."""
    return corrections.groupBy("stack_id", "frame_idx").pivot("channel", list(names)).agg(F.first("param"))


def _balanced_channels(mode: str) -> list[str]:
    """The names of a mode's corrections: LUMI has one for all three colours."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return ["L"] if mode == "LUMI" else [c.upper() for c in ("bgr" if mode == "RGB" else _SPACES[mode][3])]


def _recoloured(both: DataFrame, mode: str, depth: int, mapped: Callable[[Column, str], Column], untouched: Column) -> DataFrame:
    """Colours with ``mapped(value, name)`` in place of each balanced channel, in the mode's space; ``untouched`` rows stay."""
    names = _balanced_channels(mode)
    if mode in ("LUMI", "RGB"):
        changed = {c: mapped(F.col(c), "L" if mode == "LUMI" else c.upper()) for c in "bgr"}
    else:
        to, back, order, _ = _SPACES[mode]
        ready = lambda space: F.struct(*((mapped(space[c], c.upper()) if c.upper() in names else space[c]).alias(c) for c in order))
        done = color.once(color.once(to("b", "g", "r", depth), ready), lambda space: back(*(space[c] for c in order), depth))
        both = both.withColumn("_done", done)
        changed = {c: F.col("_done")[c] for c in "bgr"}
    return both.withColumns({c: F.when(untouched, F.col(c)).otherwise(v) for c, v in changed.items()}).drop("_done")


def _is_reference(px: DataFrame, refs: DataFrame | None) -> DataFrame:
    """Marks each stack's reference frame in a column ``_ref``."""
    if refs is None:
        return px.withColumn("_ref", F.lit(False))
    marked = px.join(refs.select("stack_id", F.col("ref_idx").alias("_ref_idx")), "stack_id", "left")
    return marked.withColumn("_ref", F.coalesce(F.col("frame_idx") == F.col("_ref_idx"), F.lit(False))).drop("_ref_idx")


def apply_correction(
    px: DataFrame, corrections: DataFrame, mode: str = "LUMI", map_: str = "LINEAR", depth: int = 8, refs: DataFrame | None = None
) -> DataFrame:
    """Pixels with each frame's correction applied to the channels of ``mode`` (LUMI applies it to all three colours).

    Each channel is clipped at the largest value of ``depth``. The frames of ``refs`` stay as they are: a way to a colour
    space and back would round them.
    """
    if map_ not in ("LINEAR", "GAMMA"):
        raise ValueError(f"unknown correction: {map_}")
    most, names = color.top(depth), _balanced_channels(mode)
    wide = _of_channel(corrections, names).withColumnsRenamed({n: f"k_{n}" for n in names})
    both = _is_reference(px, refs).join(wide, ["stack_id", "frame_idx"])

    def mapped(v: Column, name: str) -> Column:
        k = F.col(f"k_{name}")
        if map_ == "GAMMA":
            return F.when(k == 1, v).otherwise(color.gamma_correction(v, k, depth))
        return F.floor(F.greatest(F.lit(0.0), F.least(v * k, F.lit(float(most))))).cast("long")

    return _recoloured(both, mode, depth, mapped, F.col("_ref")).drop("_ref", *(f"k_{n}" for n in names))


def balance_frames(px: DataFrame, refs: DataFrame, mode: str = "LUMI", map_: str = "LINEAR", depth: int = 8,
                   lo: int = 0, hi: int | None = None, factor: int = 1, mask_size: float = 0.0, fast: bool = True) -> tuple[DataFrame, DataFrame]:
    """(balanced pixels, summary of corrections) of many stacks against their reference frames, which stay as they are.

    Corrections come from the pixels that ``factor``, ``fast`` and ``mask_size`` leave (see ``histogram``; a factor of 0 is
    chosen for each stack by its size, see ``auto_factor``), with values from ``lo`` to ``hi``; they are applied to all.
    LAB balances L alone. For MATCH_HIST the summary is the table of each frame and channel.
    """
    hist = histogram(px, mode, depth, factor, mask_size, fast)
    if map_ == "MATCH_HIST":
        lut = match_histogram(hist, refs, depth)
        return apply_lut(px, lut, mode, depth, refs), lut
    if map_ not in ("LINEAR", "GAMMA"):
        raise ValueError(f"unknown correction: {map_}")
    fitted = linear_correction(hist, refs, lo, hi) if map_ == "LINEAR" else gamma_fit(hist, refs, depth, lo=lo, hi=hi)
    summary = correction_summary(fitted, refs)
    return apply_correction(px, summary, mode, map_, depth, refs), summary


def apply_lut(px: DataFrame, lut: DataFrame, mode: str = "LUMI", depth: int = 8, refs: DataFrame | None = None) -> DataFrame:
    """Pixels sent through per-frame tables in the mode's space: each table is one array per frame and channel, indexed by
    value. The frames of ``refs`` stay as they are."""
    names = _balanced_channels(mode)
    entries = F.sort_array(F.collect_list(F.struct("value", "out")))
    maps = lut.groupBy("stack_id", "frame_idx", "channel").agg(F.transform(entries, lambda e: e["out"]).alias("table"))
    wide = maps.groupBy("stack_id", "frame_idx").pivot("channel", names).agg(F.first("table"))
    wide = wide.withColumnsRenamed({n: f"t_{n}" for n in names})
    both = _is_reference(px, refs).join(wide, ["stack_id", "frame_idx"])
    pick = lambda v, name: F.get(F.col(f"t_{name}"), v.cast("int"))
    return _recoloured(both, mode, depth, pick, F.col("_ref")).drop("_ref", *(f"t_{n}" for n in names))
