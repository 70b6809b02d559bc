"""Vignetting: radial profiles, a fitted falloff, and its correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import gray, top


def _radius() -> Column:
    dx, dy = F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2
    return F.sqrt(dx * dx + dy * dy)


def _far() -> Column:
    return F.sqrt(F.pow(F.col("w") / 2, F.lit(2.0)) + F.pow(F.col("h") / 2, F.lit(2.0)))


def radial_profile(px: DataFrame, steps: int = 100) -> DataFrame:
    """(stack_id, frame_idx, bin, r_mid, mean_i): mean gray by distance from the centre; empty bins are null."""
    binned = px.withColumn("bin", F.least(F.floor(_radius() / _far() * steps), F.lit(steps - 1)).cast("long"))
    means = binned.withColumn("v", gray("b", "g", "r")).groupBy("stack_id", "frame_idx", "bin").agg(F.avg("v").alias("mean_i"))
    frames = px.groupBy("stack_id", "frame_idx").agg(F.max(_far()).alias("far"))
    grid = frames.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    return grid.join(means, ["stack_id", "frame_idx", "bin"], "left").select(
        "stack_id", "frame_idx", "bin", ((F.col("bin") + 0.5) * F.col("far") / steps).alias("r_mid"), "mean_i"
    )


def falloff(r: np.ndarray, i0: float, k: float, r0: float) -> np.ndarray:
    return i0 / (1 + np.exp(np.minimum(10, np.exp(np.clip(k * (r - r0), -10, 10)))))


def fit_vignette(radial: DataFrame, rounds: int = 200) -> DataFrame:
    """(stack_id, frame_idx, i0, k, r0): least squares of the falloff, parameters not negative.

    A damped Gauss-Newton descent for each profile of at most ``steps`` rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["mean_i"]).sort_values("r_mid")
        key = {"stack_id": pdf["stack_id"].iloc[:1], "frame_idx": pdf["frame_idx"].iloc[:1]}
        r, v = pdf["r_mid"].to_numpy(), pdf["mean_i"].to_numpy()
        far = max(r.max(initial=1.0), 1e-9)
        p = np.array([2 * max(v.max(initial=0.0), 1e-9), 10 / far, 0.8 * far])
        damp, error = 1e-3, np.sum((falloff(r, *p) - v) ** 2)
        for _ in range(rounds):
            base = falloff(r, *p)
            step = np.maximum(np.abs(p), 1e-6) * 1e-6
            slope = np.stack([(falloff(r, *(p + step * np.eye(3)[j])) - base) / step[j] for j in range(3)], axis=1)
            square = slope.T @ slope
            move = np.linalg.lstsq(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), slope.T @ (v - base), rcond=None)[0]
            tried = np.maximum(p + move, 0)
            got = np.sum((falloff(r, *tried) - v) ** 2)
            if got < error:
                done = error - got < 1e-12 * max(error, 1e-12)
                p, error, damp = tried, got, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        return pd.DataFrame(key | {"i0": p[0], "k": p[1], "r0": p[2]})

    return radial.groupBy("stack_id", "frame_idx").applyInPandas(
        run, "stack_id long, frame_idx long, i0 double, k double, r0 double"
    )


def model(r: Column, i0: Column, k: Column, r0: Column) -> Column:
    bent = F.exp(F.greatest(F.lit(-10.0), F.least(k * (r - r0), F.lit(10.0))))
    return i0 / (1 + F.exp(F.least(F.lit(10.0), bent)))


def vignette_radii(params: DataFrame, shares: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """(…, p, radius): where the falloff reaches each share of its centre; ``params`` has ``far``, the corner.

    0 for shares that the centre itself does not reach, the corner's distance where the share is never reached.
    """
    v0 = model(F.lit(0.0), F.col("i0"), F.col("k"), F.col("r0"))
    each = params.withColumn("v0", v0).withColumn("p", F.explode(F.array(*map(F.lit, shares))))
    inner = F.col("i0") / (F.col("p") * F.col("v0")) - 1
    r = F.col("r0") + F.log(F.log(inner)) / F.col("k")
    radius = F.when(F.col("p") >= 1, 0.0).when((inner <= 1) | r.isNull() | F.isnan(r), 0.0)
    clipped = F.greatest(F.lit(0.0), F.least(r, F.col("far")))
    return each.select("stack_id", "frame_idx", "p", radius.otherwise(clipped).alias("radius"))


def correct_vignetting(px: DataFrame, params: DataFrame, max_correction: float = 1.0, black: int = 1, depth: int = 8) -> DataFrame:
    """Pixels divided by the falloff, except nearly black ones; ``px`` has ``h`` and ``w``, ``params`` i0, k, r0."""
    both = px.join(params.select("stack_id", "frame_idx", "i0", "k", "r0"), ["stack_id", "frame_idx"])
    p = F.col("i0"), F.col("k"), F.col("r0")
    v = F.greatest(F.lit(1e-6), F.least(model(_radius(), *p) / model(F.lit(0.0), *p), F.lit(1.0)))
    if max_correction < 1:
        v = (1 - max_correction) + v * max_correction
    dark = F.least("b", "g", "r") < black * (256 if depth == 16 else 1)
    fixed = {c: F.when(dark, F.col(c)).otherwise(F.floor(F.least(F.round(F.col(c) / v, 6), F.lit(float(top(depth))))).cast("long")) for c in "bgr"}
    return both.withColumns(fixed).drop("i0", "k", "r0")
