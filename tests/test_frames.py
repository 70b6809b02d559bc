"""Operators against plain NumPy on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.functions import color, geometry
from framespark.operators import align, depthmap, layers, noise, pyramid
from framespark.operators.stencil import GENERATING, expand, reduce, stencil, with_size
from framespark.plans.bunches import bunches
from framespark.sources import frames as src


def table(spark, images):
    """images: {frame_idx: h x w x 3}"""
    rows = [
        (0, f, y, x, *map(int, image[y, x]))
        for f, image in images.items()
        for y in range(image.shape[0])
        for x in range(image.shape[1])
    ]
    return spark.createDataFrame(rows, "stack_id long, frame_idx long, y long, x long, b long, g long, r long")


def image(df, shape, col="b"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    return out


def convolved(a, taps):
    k, r = np.array(taps, float), len(taps) // 2
    p = np.pad(a, r, mode="reflect")
    p = sum(k[i] * p[i : i + a.shape[0]] for i in range(len(k)))
    return sum(k[i] * p[:, i : i + a.shape[1]] for i in range(len(k)))


@pytest.mark.parametrize("shape", [(3, 3), (5, 8), (9, 7)])
def test_stencil_mirrors_edges(spark, shape):
    a = np.random.default_rng(1).integers(0, 256, (*shape, 3))
    got = stencil(with_size(table(spark, {0: a})), GENERATING, None, ["b"])
    assert np.array_equal(image(got, shape), convolved(a[..., 0], GENERATING))


@pytest.mark.parametrize("shape", [(8, 9), (7, 10)])
def test_reduce_and_expand(spark, shape):
    a = np.random.default_rng(2).integers(0, 256, (*shape, 3))
    px = with_size(table(spark, {0: a}))
    half = reduce(px, ["b"])
    want = convolved(a[..., 0], GENERATING)[::2, ::2] / 400
    assert np.allclose(image(half, want.shape), want)
    wide = np.zeros((2 * want.shape[0], 2 * want.shape[1]))
    wide[::2, ::2] = want
    up = (convolved(wide, GENERATING) / 100)[: shape[0], : shape[1]]
    assert np.allclose(image(expand(half, px, ["b"]), shape), up)


def test_pyramid_of_one_frame_restores_it(spark):
    a = np.random.default_rng(3).integers(0, 256, (12, 16, 3))
    fused = pyramid.focus_stack_pyramid(table(spark, {0: a}), 1)
    assert np.array_equal(image(fused, (12, 16), "g"), a[..., 1])


def test_depth_map_of_one_frame_restores_it(spark):
    a = np.random.default_rng(4).integers(0, 256, (12, 16, 3))
    fused = depthmap.focus_stack_depthmap(with_size(table(spark, {0: a})), levels=1)
    assert np.abs(image(fused, (12, 16), "r") - a[..., 2]).max() <= 1


def test_weights_add_up_to_one(spark):
    images = {f: np.random.default_rng(f).integers(0, 256, (6, 6, 3)) for f in range(3)}
    px = with_size(table(spark, images)).withColumn("v", color.gray("b", "g", "r"))
    for kind, temperature in (("average", 0), ("max", 0), ("max", 100.0)):
        weights = depthmap.focus_weights(depthmap.energy_map(px), kind, temperature)
        sums = [r["s"] for r in weights.groupBy("y", "x").agg(F.sum("wt").alias("s")).collect()]
        assert np.allclose(sums, 1)


@pytest.mark.parametrize("space, limit", [("hsv", 10), ("hls", 10), ("lab", 100)])
def test_colour_round_trip(spark, space, limit):
    px = spark.range(2000).selectExpr("id * 32 % 65536 b", "id * 7919 % 65536 g", "id * 104729 % 65536 r")
    to, back = getattr(color, f"bgr_to_{space}"), getattr(color, f"{space}_to_bgr")
    done = px.select("b", "g", "r", to("b", "g", "r").alias("s")).select("b", "g", "r", back(*(F.col(f"s.{c}") for c in space)).alias("o"))
    worst = done.agg(*(F.max(F.abs(F.col(c) - F.col(f"o.{c}"))).alias(c) for c in "bgr")).first()
    assert max(worst) < (limit if space != "lab" else 400)


def test_hot_pixel_is_found_and_repaired(spark):
    a = np.full((7, 7, 3), 50)
    a[3, 3] = 250
    px = table(spark, {0: a, 1: a})
    hot = noise.hot_pixels_rgb(noise.differences(noise.mean_frame(px)), fixed=80)
    assert [(r["y"], r["x"]) for r in hot.collect()] == [(3, 3)]
    fixed = noise.repair_hot_pixels(px, hot, how="median").filter("y = 3 and x = 3").collect()
    assert {r["b"] for r in fixed} == {50} and len(fixed) == 2


def test_bunches(spark):
    frames = spark.range(12).selectExpr("0L stack_id", "id frame_idx")
    got = {}
    for r in bunches(frames, 5, 1).collect():
        got.setdefault(r["bunch_idx"], []).append(r["frame_idx"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3, 4], 1: [4, 5, 6, 7, 8], 2: [8, 9, 10, 11]}
    with pytest.raises(ValueError):
        bunches(frames, 3, 3)


def test_validation_and_reference(spark):
    rows = [(0, i, f"a/{i}.jpg", 100 if i != 2 else 90, 80, 3, 16 if i == 1 else 8) for i in range(4)]
    frames = spark.createDataFrame(rows, "stack_id long, frame_idx long, path string, width int, height int, channels int, bit_depth int")
    assert [r["status"] for r in src.validate_stack(frames).orderBy("frame_idx").collect()] == ["ok", "depth", "shape", "ok"]
    assert src.resolve_reference(frames, 0).first()["ref_idx"] == 2
    with pytest.raises(Exception):  # noqa: B017
        src.resolve_reference(frames, 9).collect()
    with pytest.raises(Exception):  # noqa: B017
        src.validate_stack(frames, strict=True).collect()


def test_robust_fit_finds_the_similarity(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 512, (120, 2))
    angle = np.radians(15)
    a, b = np.cos(angle), np.sin(angle)
    q = np.column_stack((a * p[:, 0] - b * p[:, 1] + 30, b * p[:, 0] + a * p[:, 1] + 20)) + rng.normal(0, 0.05, p.shape)
    q[:40] += rng.uniform(50, 200, (40, 2))
    rows = [(0, 1, i, *map(float, (*p[i], *q[i]))) for i in range(120)]
    m = spark.createDataFrame(rows, "stack_id long, frame_idx long, kp_id long, x0 double, y0 double, x1 double, y1 double")
    got = align.robust_fit(m, max_iters=64).first()
    assert got["n_inliers"] == 80
    assert abs(np.degrees(np.arctan2(got["m"][3], got["m"][0])) - 15) < 0.007
    assert abs(got["m"][2] - 30) < 0.2 and abs(got["m"][5] - 20) < 0.2
    assert abs(np.hypot(got["m"][0], got["m"][3]) - 1) < 1e-4


def test_geometry(spark):
    one = spark.range(1).select(F.array(*map(F.lit, (2.0, 0.0, 5.0, 0.0, 3.0, -1.0, 0.0, 0.0, 1.0))).alias("m"))
    p = one.select(geometry.decompose_affine("m").alias("p")).select("p.*").first()
    assert (p["sx"], p["sy"], p["rotation"], p["tx"], p["ty"]) == (2, 3, 0, 5, -1)
    unit = one.select(geometry.compose("m", geometry.inverse("m")).alias("u")).first()["u"]
    assert np.allclose(unit, np.eye(3).ravel())


def test_layers_are_sorted_with_master_on_top(spark):
    rows = [(0, i, n) for i, n in enumerate(["b", "Master", "A", "c"])]
    ly = spark.createDataFrame(rows, "stack_id long, layer_idx long, label string")
    names = [r["label"] for r in layers.sort_layers(ly).orderBy("layer_idx").collect()]
    assert names == ["Master", "A", "b", "c"]
    with pytest.raises(ValueError):
        layers.sort_layers(ly, "up")


def test_empty_tables(spark):
    px = table(spark, {0: np.zeros((4, 4, 3), int)}).limit(0)
    assert noise.mean_frame(px).count() == 0
    assert pyramid.focus_stack_pyramid(px, 0).count() == 0
