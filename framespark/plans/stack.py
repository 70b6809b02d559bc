"""User-level plans: lists of steps over many stacks, run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.color import gray
from ..operators import align, balance, depthmap, filters, noise, pyramid, vignette
from ..operators.stencil import with_size
from ..sources.frames import auto_factor
from ..sources.scratch import settled, written
from .bunches import bunches

Step = Callable[[DataFrame], DataFrame]


def stack_pipeline(px: DataFrame, steps: list[Step]) -> DataFrame:
    """The steps in order, each a function from pixels to pixels; frames whose pixels become null are dropped.

    Steps use their input several times (statistics, then pixels), so it is written once between them. What a step writes
    for itself, and its input, are deleted when its result is written.
    """
    for step in steps:
        px = settled(px.sparkSession, partial(step, px), "step", before=px)
    return px.filter(F.col("b").isNotNull())


def mask_noise(
    n: int = 100, max_frames: int = 10, method: str = "norm_lab", kernel: int = 3, how: str = "mean", limit: int = 2000, depth: int = 8
) -> Step:
    """Finds each stack's hot pixels on its mean frame and repairs them in all frames.

    ``method`` is ``norm_lab`` (distance in Lab), ``norm_rgb`` or ``rgb`` (each channel). A stack with more than ``limit`` hot
    pixels is an error.
    """
    if method not in ("norm_lab", "norm_rgb", "rgb"):
        raise ValueError(f"unknown method: {method}")

    def step(px: DataFrame) -> DataFrame:
        diff = noise.differences(noise.mean_frame(px, max_frames, depth), method == "norm_lab")
        hot = written(noise.hot_pixels_rgb(diff, n) if method == "rgb" else noise.hot_pixels_norm(diff, n), "hot")
        many = noise.count_guard(hot, limit).filter("too_many").orderBy("stack_id").first()
        if many:
            raise ValueError(f"too many hot pixels in stack {many['stack_id']}: {many['n']} > {limit}")
        return noise.repair_hot_pixels(px, hot, kernel, how)

    return step


def correct_vignette(steps: int = 100, max_correction: float = 1.0) -> Step:
    def step(px: DataFrame) -> DataFrame:
        sized = with_size(px)
        params = vignette.fit_vignette(vignette.radial_profile(sized, steps))
        return vignette.correct_vignetting(sized, params, max_correction).drop("h", "w")

    return step


def balanced(refs: DataFrame, mode: str = "LUMI", map_: str = "LINEAR") -> Step:
    return lambda px: balance.balance_frames(px, refs, mode, map_)[0]


def aligned(transforms: DataFrame, border: str = "REPLICATE") -> Step:
    """Warps by given transforms; frames without one are left out."""
    return lambda px: align.warp(with_size(px), transforms, border)


TARGET = ("stack_id", "frame_idx", "target_idx")


def _matched(kp: DataFrame, pairs: DataFrame, within: int | None = None) -> DataFrame:
    """``TARGET, kp_id, x0, y0, x1, y1``: mutual nearest keypoints of pairs of frames, by binary descriptors; of those at
    most ``within`` bits apart, if given."""
    pairs = pairs.select(*TARGET)
    met = align.match_cross_check(kp, pairs) if within is None else align.match_within(kp, pairs, within)
    at = lambda k, a: kp.select("stack_id", F.col("frame_idx").alias(a), F.col("kp_id").alias(f"kp{k}"), F.col("x").cast("double").alias(f"x{k}"), F.col("y").cast("double").alias(f"y{k}"))
    placed = met.join(at(0, "frame_idx"), ["stack_id", "frame_idx", "kp0"]).join(at(1, "target_idx"), ["stack_id", "target_idx", "kp1"])
    return placed.select(*TARGET, F.col("kp0").alias("kp_id"), "x0", "y0", "x1", "y1")


def _fitted(matches: DataFrame, least: int, kind: str, method: str, threshold: float, factor: Column | int = 1) -> DataFrame:
    """``TARGET, m, n_inliers, inlier_share, avg_error, max_error, status`` of pairs with enough inliers, in pixels of the
    whole frames; ``matches`` may have their own ``factor``."""
    models = align.robust_fit(matches, threshold, method=method, kind=kind, keys=TARGET).filter(F.col("n_inliers") >= least)
    quality = align.fit_quality(matches, models, 1, threshold, TARGET)
    both = models.select(*TARGET, "m", "n_inliers").join(quality, list(TARGET))
    if "factor" in matches.columns:
        both = both.join(matches.groupBy(*TARGET).agg(F.max("factor").alias("factor")), list(TARGET))
        factor = F.col("factor")
    scaled = {c: F.col(c) * factor for c in ("avg_error", "max_error")}
    both = both.withColumns({**scaled, "m": geometry.rescale_transform("m", factor, "rigid" if kind == "similarity" else kind)})
    return both.withColumn("status", align.quality_status()).drop("factor")


def _allowed(transforms: DataFrame, sizes: DataFrame, kind: str, limits: str) -> DataFrame:
    """Transforms whose distortion is within ``limits`` for their stack's ``h`` and ``w``."""
    held = transforms.join(sizes, "stack_id")
    reasons = geometry.check_affine("m", F.col("h"), F.col("w"), limits) if kind == "similarity" else geometry.check_homography("m", F.col("h"), F.col("w"), limits)["reasons"]
    return held.filter(reasons == "").drop("h", "w")


def estimate_transforms(
    kp: DataFrame, frames: DataFrame, refs: DataFrame, delta_max: int = 2, least: int = 20, sizes: DataFrame | None = None,
    limits: str = "normal", kind: str = "similarity", method: str = "RANSAC", threshold: float = 3.0,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, valid): the frames and targets tried, and the transforms found for them from keypoints with binary
    descriptors: with ``least`` inliers, how well they fit, and, with ``sizes(stack_id, h, w)``, a distortion within ``limits``.
    """
    pairs = align.pair_frames(frames, refs, delta_max)
    valid = _fitted(written(_matched(kp, pairs), "matches"), least, kind, method, threshold)
    return pairs, _allowed(valid, sizes, kind, limits) if sizes is not None else valid


def align_frames(kp: DataFrame, frames: DataFrame, refs: DataFrame, delta_max: int = 2, least: int = 20) -> DataFrame:
    """(stack_id, frame_idx, m): transforms to the reference from a keypoint table with binary descriptors.

    Frames are matched towards the reference; a frame whose nearest target fails falls back to the next.
    """
    pairs, valid = estimate_transforms(kp, frames, refs, delta_max, least)
    return align.compose_chain(align.choose_pairs(pairs, valid), refs)


def _thinned(px: DataFrame, factor: Column) -> DataFrame:
    """Gray frames with every ``factor``-th row and column."""
    thin = px.withColumn("factor", factor).filter((F.col("y") % F.col("factor") == 0) & (F.col("x") % F.col("factor") == 0))
    at = {c: F.expr(f"{c} div factor") for c in ("y", "x")} | {c: F.expr(f"({c} + factor - 1) div factor") for c in ("h", "w")}
    return thin.withColumns(at).select("stack_id", "frame_idx", "y", "x", "h", "w", "factor", gray("b", "g", "r").alias("v"))


def fit_with_fallback(
    px: DataFrame, pairs: DataFrame, factor: int = 0, top_k: int = 500, least: int = 20, kind: str = "similarity", method: str = "RANSAC", threshold: float = 3.0,
    within: int | None = None,
) -> DataFrame:
    """``TARGET, m, n_inliers, …, status, factor`` of pairs of frames thinned by ``factor`` (0: chosen by the size of each
    stack), and, of pairs with fewer than ``least`` matches that agree there, of the whole frames.

    Only the frames of such pairs are searched for keypoints again, and only those pairs are matched and fitted again. ``px``
    has ``h`` and ``w``; keypoints lie at pixels of the thinned frames.
    """
    chosen = F.greatest(auto_factor("align", F.col("h"), F.col("w")), F.lit(1)) if factor == 0 else F.lit(factor)
    thin = written(_thinned(px, chosen.cast("long")), "gray")
    factors = thin.groupBy("stack_id").agg(F.max("factor").alias("factor"))
    kp = written(align.detect_keypoints(thin.drop("factor"), top_k), "keypoints")
    fit = lambda matches: written(_fitted(written(matches, "matches"), least, kind, method, threshold), "fits")
    first = fit(_matched(kp, pairs, within).join(factors, "stack_id")).join(factors, "stack_id")
    poor = pairs.select(*TARGET).join(factors.filter("factor > 1"), "stack_id").join(first, list(TARGET), "left_anti")
    poor = written(poor.select(*TARGET), "poor")
    if poor.isEmpty():
        return first
    again = poor.select("stack_id", "frame_idx").union(poor.select("stack_id", "target_idx")).distinct()
    whole = _thinned(px.join(again, ["stack_id", "frame_idx"], "left_semi"), F.lit(1).cast("long")).drop("factor")
    finer = _matched(written(align.detect_keypoints(whole, top_k), "keypoints"), poor, within)
    return first.unionByName(fit(finer).withColumn("factor", F.lit(1).cast("long")))


def align_stack(
    px: DataFrame, refs: DataFrame, top_k: int = 500, delta_max: int = 2, least: int = 20, limits: str = "normal",
    phase_fallback: bool = False, border: str = "REPLICATE_BLUR", factor: int = 1, kind: str = "similarity", method: str = "RANSAC",
    threshold: float = 3.0, within: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(warped pixels, transforms): stacks of any shapes aligned to their reference frames.

    Keypoints of the gray frames, thinned by ``factor`` (0: by the size of each stack), are detected, matched towards the
    reference (with ``within``, up to so many bits apart and without comparing all) and fitted by a ``kind`` of transform,
    with a fallback to whole frames (see ``fit_with_fallback``). With
    ``phase_fallback`` a frame that has none takes the scale and shift that phase correlation tells for its nearest target.
    Transforms beyond ``limits`` do not count, nor those that a chain adds up to; a frame that no chain leads to the
    reference is left out. ``transforms`` has ``stack_id, frame_idx, m``, and of the frame's own fit ``target_idx``,
    ``n_inliers`` and ``status`` (GOOD or POOR; null for reference frames and phase correlation).
    """
    px = with_size(px)
    sizes = px.groupBy("stack_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    pairs = written(align.pair_frames(px.select("stack_id", "frame_idx").distinct(), refs, delta_max), "pairs")
    valid = written(_allowed(fit_with_fallback(px, pairs, factor, top_k, least, kind, method, threshold, within), sizes, kind, limits), "valid")
    chosen = written(align.choose_pairs(pairs, valid), "chosen")
    if phase_fallback:
        lost = written(pairs.filter("delta = 1").join(chosen.select("stack_id", "frame_idx"), ["stack_id", "frame_idx"], "left_anti").select(*TARGET), "lost")
        thin = _thinned(px, F.lit(max(factor, 1)).cast("long"))
        found = align.phase_shift(thin.select("stack_id", "frame_idx", "y", "x", "v"), lost)
        m = F.array(F.col("scale"), F.lit(0.0), F.col("dx"), F.lit(0.0), F.col("scale"), F.col("dy"), *map(F.lit, (0.0, 0.0, 1.0)))
        found = found.select(*TARGET, geometry.rescale_transform(m, max(factor, 1)).alias("m"))
        chosen = chosen.unionByName(_allowed(found, sizes, "similarity", limits).select(*TARGET, "m"))
    chained = _allowed(align.compose_chain(chosen, refs), sizes, kind, limits)
    fits = chosen.select(*TARGET).join(valid.select(*TARGET, "n_inliers", "status"), list(TARGET), "left")
    chained = written(chained.join(fits, ["stack_id", "frame_idx"], "left"), "transforms")
    warped = with_size(align.warp(px, chained.select("stack_id", "frame_idx", "m"), border))
    if border == "REPLICATE_BLUR":
        warped = align.blur_outside(warped)
    return warped.drop("h", "w"), chained


def auto_aligned(refs: DataFrame, **options) -> Step:
    """``align_stack`` as a step."""
    return lambda px: align_stack(px, refs, **options)[0]


def stack_job(px: DataFrame, refs: DataFrame, steps: list[Step], fuse: Step, after: list[Step]) -> DataFrame:
    """The whole job: steps on frames, fusion to one image a stack, and steps on the images.

    The result is a table in the shared folder, the only one that is left; within ``scratch.scope`` it goes too.
    """
    spark = px.sparkSession
    frames = settled(spark, lambda: stack_pipeline(px, steps), "frames") if steps else px
    image = settled(spark, partial(fuse, frames), "fused", before=frames)
    for step in after:
        image = settled(spark, partial(step, image), "after", before=image)
    return image


def bunched(n: int = 10, overlap: int = 2, algo: str = "pyramid", **options) -> Step:
    """Fusion of each bunch of frames as a step: the bunches' images are the frames of what comes after."""

    def step(px: DataFrame) -> DataFrame:
        return focus_stack_bunch(px, n=n, overlap=overlap, algo=algo, **options).withColumnRenamed("bunch_idx", "frame_idx")

    return step


def sharpened(radius: float = 1.0, amount: float = 0.5, threshold: float = 0.0) -> Step:
    return lambda image: filters.unsharp_mask(with_size(image), radius, amount, threshold, keys=("stack_id",)).drop("h", "w")


def denoised(h: float = 10.0, search: int = 21) -> Step:
    return lambda image: filters.denoise(with_size(image), h, search=search, keys=("stack_id",))


def tone_mapped(amount: float = 0.5, clip: float = 2.0, tiles: int = 2) -> Step:
    return lambda image: filters.local_tonemap_color(with_size(image), amount, clip, tiles, keys=("stack_id",))


def focus_stack(px: DataFrame, algo: str = "pyramid", **options) -> DataFrame:
    return {"pyramid": pyramid.focus_stack_pyramid, "depthmap": depthmap.focus_stack_depthmap}[algo](px, **options)


def focus_stack_bunch(px: DataFrame, levels: int | None = None, n: int = 10, overlap: int = 2, algo: str = "pyramid", **options) -> DataFrame:
    """A fused image for each overlapping bunch: ``stack_id, bunch_idx, y, x, b, g, r``, by pyramid or by depth map."""
    frames = px.select("stack_id", "frame_idx").distinct()
    dealt = px.join(bunches(frames, n, overlap), ["stack_id", "frame_idx"])
    if levels is not None:
        options["levels"] = levels
    return focus_stack(dealt, algo, keys=("stack_id", "bunch_idx"), **options)
