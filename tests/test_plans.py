"""Operators that SQL has no words for, and whole plans, against plain NumPy and known answers."""

import pathlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import align, balance, depthmap, filters, pyramid, tiles, vignette
from framespark.operators.stencil import with_size
from framespark.plans import stack
from framespark.sources import frames as src
from framespark.sources import scratch
from framespark.sources.scratch import scratch_dir, written
from .test_frames import convolved, image, table


def texture(h, w, seed=1):
    """A smooth random image with corners."""
    a = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float)
    for _ in range(2):
        a = convolved(a, (1, 2, 1)) / 16
    a = (a - a.min()) / (a.max() - a.min()) * 255
    return np.repeat(a.astype(int)[..., None], 3, axis=2)


def test_vignette_fit_finds_its_parameters(spark):
    r = np.linspace(1, 400, 60)
    rows = [(0, f, k, float(a), float(v)) for f, p in enumerate([(300.0, 0.02, 350.0), (180.0, 0.03, 250.0)]) for k, (a, v) in enumerate(zip(r, vignette.falloff(r, *p)))]
    fitted = vignette.fit_vignette(spark.createDataFrame(rows, "stack_id long, frame_idx long, bin long, r_mid double, mean_i double"))
    for got in fitted.collect():
        want = [(300.0, 0.02, 350.0), (180.0, 0.03, 250.0)][got["frame_idx"]]
        at = vignette.falloff(r, got["i0"], got["k"], got["r0"])
        assert np.allclose(at, vignette.falloff(r, *want), rtol=0.01)


def test_vignette_correction_flattens(spark):
    h, w = 48, 64
    y, x = np.mgrid[0:h, 0:w]
    r = np.hypot(x - w / 2, y - h / 2)
    v = vignette.falloff(r, 360.0, 0.08, 38.0)
    a = np.repeat(np.floor(v)[..., None], 3, axis=2)
    flat = image(stack.correct_vignette(steps=20)(table(spark, {0: a})), (h, w))
    assert flat.std() < 0.15 * a[..., 0].std() and abs(flat[h // 2, w // 2] - a[h // 2, w // 2, 0]) <= 2


def _phase(spark, frames, pairs, **options):
    px = table(spark, frames).withColumn("v", F.col("b")).select("stack_id", "frame_idx", "y", "x", "v")
    pairs = spark.createDataFrame(pairs, "stack_id long, frame_idx long, target_idx long")
    return {(r["frame_idx"], r["target_idx"]): r for r in align.phase_shift(px, pairs, **options).collect()}


@pytest.mark.parametrize("cells", [1 << 19, 300])
def test_phase_shift_of_a_moved_frame(spark, cells):
    a = texture(40, 48)
    got = _phase(spark, {0: a, 1: np.roll(a, (3, -4), (0, 1))}, [(0, 0, 1), (0, 1, 0), (0, 0, 5)], cells=cells)
    assert set(got) == {(0, 1), (1, 0)}  # a frame without pixels has no shift
    for pair, sign in (((0, 1), 1), ((1, 0), -1)):
        r = got[pair]
        assert abs(r["dx"] + 4 * sign) < 0.5 and abs(r["dy"] - 3 * sign) < 0.5 and r["scale"] == 1


def test_phase_shift_is_that_of_the_whole_transform(spark):
    a, b = texture(31, 45, 3)[..., 0], texture(31, 45, 4)[..., 0]
    window = np.hanning(31)[:, None] * np.hanning(45)
    f, g = (np.fft.fft2((p - p.mean()) * window) for p in (a, b))
    both = np.conj(f) * g
    surface = np.abs(np.fft.ifft2(both / np.abs(both)))
    y, x = np.unravel_index(surface.argmax(), surface.shape)
    near = np.arange(-2, 3)
    around = surface[np.ix_((y + near) % 31, (x + near) % 45)]
    want = (x - 45 * (x > 22) + around.sum(0) @ near / around.sum(), y - 31 * (y > 15) + around.sum(1) @ near / around.sum())
    for cells in (200, 1 << 19):
        r = _phase(spark, {0: np.repeat(a[..., None], 3, 2), 1: np.repeat(b[..., None], 3, 2)}, [(0, 0, 1)], scales=(0.999, 1.001), cells=cells)[0, 1]
        assert np.allclose((r["dx"], r["dy"]), want, atol=1e-6)


@pytest.mark.parametrize("scale", [0.94, 1.05])
def test_phase_shift_finds_a_scale(spark, scale):
    h, w, dx, dy = 180, 200, 6.0, -4.0
    whole = texture(400, 400, 5)[..., 0].astype(float)
    whole = convolved(convolved(whole, (1, 4, 6, 4, 1)) / 256, (1, 4, 6, 4, 1)) / 256
    whole = (whole - whole.min()) / np.ptp(whole) * 255
    y, x = np.mgrid[0:h, 0:w].astype(float)

    def at(v, u):
        i, j = np.floor(v).astype(int), np.floor(u).astype(int)
        return sum(whole[i + a, j + b] * np.abs(1 - a - (v - i)) * np.abs(1 - b - (u - j)) for a in (0, 1) for b in (0, 1))

    middle = [(1 - scale) * (n - 1) / 2 for n in (h, w)]
    frames = [at(y + 100, x + 100), at((y - middle[0] - dy) / scale + 100, (x - middle[1] - dx) / scale + 100)]
    frames = {k: np.repeat(np.round(f).astype(int)[..., None], 3, axis=2) for k, f in enumerate(frames)}
    r = _phase(spark, frames, [(0, 0, 1)], cells=4000)[0, 1]
    assert abs(r["scale"] - scale) < 0.02
    for got, want, n in ((r["dx"], dx + middle[1], w), (r["dy"], dy + middle[0], h)):
        assert abs(got + (r["scale"] - scale) * n / 2 - want) < 1  # at the middle of the frame


def test_homography_of_exact_matches(spark):
    h = np.array([[1.02, 0.03, 5.0], [-0.02, 0.97, -3.0], [1e-4, -5e-5, 1.0]])
    p = np.random.default_rng(2).uniform(0, 500, (30, 2))
    q = np.column_stack((p, np.ones(30))) @ h.T
    q = q[:, :2] / q[:, 2:]
    rows = [(0, 0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q))]
    few = [(0, 1, *r[2:]) for r in rows[:3]] + [(0, 1, 3, None, 1.0, 1.0, 1.0)]
    schema = "stack_id long, frame_idx long, kp_id long, x0 double, y0 double, x1 double, y1 double"
    got = align.homography_fit(spark.createDataFrame(rows + few + [(0, 0, 99, None, 1.0, 1.0, 1.0)], schema)).collect()
    assert [r["frame_idx"] for r in got] == [0]  # three matches fix no homography
    assert np.allclose(np.array(got[0]["m"]).reshape(3, 3), h, atol=1e-6)
    assert align.homography_fit(spark.createDataFrame([], schema)).count() == 0


def _moved(h, n, outliers, seed, frame):
    """Rows of n matches of a homography, of which the first are outliers."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 500, (n, 2))
    q = np.column_stack((p, np.ones(n))) @ h.T
    q = q[:, :2] / q[:, 2:] + rng.normal(0, 0.02, (n, 2))
    q[:outliers] += rng.uniform(30, 200, (outliers, 2))
    return [(0, frame, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q))]


def test_robust_homographies_in_rounds(spark):
    h = np.array([[1.02, 0.03, 5.0], [-0.02, 0.97, -3.0], [1e-4, -5e-5, 1.0]])
    rows = _moved(h, 90, 0, 1, 1) + _moved(h, 90, 45, 2, 2) + _moved(h, 3, 0, 3, 3) + [(0, 2, 999, None, 1.0, 1.0, 1.0)]
    rows += [(0, 4, i, float(i), 2.0 * i, float(i), 3.0 * i) for i in range(9)]  # all on a line: nothing is fixed
    m = spark.createDataFrame(rows, "stack_id long, frame_idx long, kp_id long, x0 double, y0 double, x1 double, y1 double")
    for method in ("RANSAC", "LMEDS"):
        got = {r["frame_idx"]: r for r in align.robust_fit(m, kind="homography", method=method).collect()}
        assert set(got) == ({1, 2} if method == "RANSAC" else {1, 2} & set(got))
        for r in got.values():
            assert np.allclose(np.array(r["m"]).reshape(3, 3), h, atol=[[1e-3, 1e-3, 0.2], [1e-3, 1e-3, 0.2], [1e-5, 1e-5, 1e-9]])
        if method == "RANSAC":
            assert (got[1]["n_inliers"], got[2]["n_inliers"]) == (90, 45) and got[1]["tried"] == 16 and 16 < got[2]["tried"] <= 500
    keyed = m.filter("frame_idx = 1").withColumn("target_idx", F.lit(7).cast("long"))
    assert align.robust_fit(keyed, keys=stack.TARGET).first()["target_idx"] == 7


def test_fits_fall_back_to_whole_frames(spark):
    """Thinned by four, only the first pair has matches that agree; the other is matched again, on whole frames."""
    big = texture(150, 170)
    px = table(spark, {0: big[20:120, 20:140], 1: big[24:124, 24:144], 2: big[27:127, 25:145]})
    pairs = spark.createDataFrame([(0, 0, 1), (0, 2, 1)], "stack_id long, frame_idx long, target_idx long")
    got = {r["frame_idx"]: r["factor"] for r in stack.fit_with_fallback(with_size(px), pairs, factor=4, top_k=150, least=60).collect()}
    assert got == {0: 4, 2: 1}  # the first moved by whole steps of the thinned frames
    refs = spark.createDataFrame([(0, 1)], "stack_id long, ref_idx long")
    _, found = stack.align_stack(px, refs, top_k=150, least=60, factor=4)
    found = {r["frame_idx"]: r for r in found.collect()}
    assert set(found) == {0, 1, 2} and found[0]["status"] == "GOOD" and found[1]["status"] is None
    assert np.allclose([found[0]["m"][k] for k in (0, 2, 5)], [1, -4, -4], atol=0.2) and np.allclose([found[2]["m"][k] for k in (0, 2, 5)], [1, 1, 3], atol=0.2)


@pytest.mark.parametrize("depth", [8, 16])
def test_denoise_by_definition(spark, depth):
    a = np.random.default_rng(3).integers(0, 1 << depth, (9, 11, 3))
    t, r, h = 1, 2, 10.0 * (256 if depth == 16 else 1)
    pad = np.pad(a, ((t + r, t + r), (t + r, t + r), (0, 0)), mode="reflect").astype(float)
    want = np.zeros(a.shape)
    for y in range(9):
        for x in range(11):
            total, weight = np.zeros(3), 0.0
            patch = lambda j, i: pad[j + r : j + r + 2 * t + 1, i + r : i + r + 2 * t + 1]
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    gap = patch(y, x) - patch(y + dy, x + dx)
                    far = (gap**2).sum(axis=2).mean() / (3 * h**2) if depth == 8 else np.abs(gap).sum(axis=2).mean() ** 2 / (3 * h**2)
                    total += np.exp(-far) * pad[y + dy + r + t, x + dx + r + t]
                    weight += np.exp(-far)
            want[y, x] = np.floor(total / weight + 0.5)
    done = filters.denoise(with_size(table(spark, {0: a})), 10.0, 2 * t + 1, 2 * r + 1, tile=64, depth=depth)
    assert np.array_equal(image(done, (9, 11)), want[..., 0])
    tiled = filters.denoise(with_size(table(spark, {0: a})), 10.0, 2 * t + 1, 2 * r + 1, tile=5, depth=depth)
    assert np.abs(image(tiled, (9, 11))[3:6, 3:8] - want[3:6, 3:8, 0]).max() == 0


def test_keypoints_are_the_strongest_corners(spark):
    a = texture(30, 34)[..., 0]
    px = with_size(table(spark, {0: np.repeat(a[..., None], 3, axis=2)})).withColumn("v", F.col("b"))
    got = sorted(align.detect_keypoints(px, 12).collect(), key=lambda r: r["kp_id"])
    two = lambda a, ty, tx: sum(
        p * q * np.pad(a, 2, mode="reflect")[2 + j : 2 + j + a.shape[0], 2 + i : 2 + i + a.shape[1]]
        for p, j in zip(ty, range(-(len(ty) // 2), len(ty))) for q, i in zip(tx, range(-(len(tx) // 2), len(tx)))
    )
    f = a.astype(float)
    gx, gy = two(f, (1, 2, 1), (-1, 0, 1)), two(f, (-1, 0, 1), (1, 2, 1))
    xx, yy, xy = (two(g, (1,) * 5, (1,) * 5) for g in (gx * gx, gy * gy, gx * gy))
    response = np.round(xx * yy - xy * xy - 0.04 * (xx + yy) ** 2, 3)
    inner = [(y, x) for y in range(4, 26) for x in range(4, 30) if response[y, x] > 0]
    want = sorted(inner, key=lambda p: (-response[p], p))[:12]
    assert [(r["y"], r["x"]) for r in got] == want
    steps = [((37 * i) % 9 - 4, (23 * i + 5) % 9 - 4, (17 * i + 3) % 9 - 4, (29 * i + 7) % 9 - 4) for i in range(32)]
    for r in got:
        assert r["bits"] == sum((a[r["y"] + p, r["x"] + q] < a[r["y"] + u, r["x"] + v]) << i for i, (p, q, u, v) in enumerate(steps))


def test_matching_by_parts_is_matching(spark):
    rng = np.random.default_rng(4)
    rows = [(0, f, i, [float(v) for v in rng.integers(0, 9, 6)], int(rng.integers(0, 1 << 20))) for f in (0, 1) for i in range(30)]
    kp = spark.createDataFrame(rows, "stack_id long, frame_idx long, kp_id long, desc array<float>, bits long")
    pairs = spark.createDataFrame([(0, 0, 1)], "stack_id long, frame_idx long, target_idx long")
    d = np.array([r[3] for r in rows])
    far = np.round(np.sqrt(((d[:30, None] - d[None, 30:]) ** 2).sum(axis=2)), 9)
    want = {(i, int(np.argmin(v))) for i, v in enumerate(far) if np.sort(v)[0] < 0.8 * np.sort(v)[1]}
    bits = np.array([r[4] for r in rows])
    ham = np.bitwise_count(bits[:30, None] ^ bits[None, 30:])
    mutual = {(i, int(np.argmin(v))) for i, v in enumerate(ham) if np.argmin(ham[:, np.argmin(v)]) == i}
    for block in (7, 2048):
        assert {(r["kp0"], r["kp1"]) for r in align.match_knn(kp, pairs, 0.8, block).collect()} == want
        assert {(r["kp0"], r["kp1"]) for r in align.match_cross_check(kp, pairs, block).collect()} == mutual


@pytest.mark.parametrize("block", [2048, 2])
@pytest.mark.parametrize("within", [0, 1, 6, 13])
def test_matching_within_a_distance_is_matching(spark, within, block):
    rng = np.random.default_rng(7)
    words = rng.integers(-(1 << 62), 1 << 62, 40)
    flips = lambda n: sum(1 << int(i) for i in rng.choice(62, n, replace=False))
    rows = [(0, 0, k, int(v)) for k, v in enumerate(words)] + [(0, 1, 100 + k, int(v) ^ flips(k % 16)) for k, v in enumerate(words)]
    rows += [(0, 0, 50, int(words[3])), (0, 1, 200, int(words[3])), (0, 0, 51, -1), (0, 0, 52, 0), (0, 1, 202, 0), (0, 1, 201, -1)]
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 0, 5)], "stack_id long, frame_idx long, target_idx long")
    schema = "stack_id long, frame_idx long, kp_id long, bits long"
    kp = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, align.match_cross_check(kp, pairs).filter(F.col("dist") <= within).collect()))
    with_nulls = spark.createDataFrame([*rows, (0, 0, 60, None), (0, 1, 260, None)], schema)
    got = sorted(map(tuple, align.match_within(with_nulls, pairs, within, block).collect()))
    assert got == want and len(want) > 4
    assert align.match_within(spark.createDataFrame([], schema), pairs, within).count() == 0


def test_chains_by_pointer_jumping(spark):
    m = lambda t: [1.0, 0.0, float(t), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, f, f - 1, m(1)) for f in range(1, 40) if f != 30] + [(0, 50, 51, m(1)), (0, 51, 50, m(1))]
    t = spark.createDataFrame(rows, "stack_id long, frame_idx long, target_idx long, m array<double>")
    refs = spark.createDataFrame([(0, 0)], "stack_id long, ref_idx long")
    got = {r["frame_idx"]: r["m"][2] for r in align.compose_chain(t.filter("frame_idx < 50"), refs).collect()}
    assert got == {f: float(f) for f in range(30)}


def test_whole_alignment(spark):
    big = texture(120, 130)
    shifts = {0: (0, 0), 1: (2, 3), 2: (4, -2)}
    cut = {f: big[20 + dy : 100 + dy, 20 + dx : 110 + dx] for f, (dy, dx) in shifts.items()}
    px = table(spark, cut)
    refs = spark.createDataFrame([(0, 1)], "stack_id long, ref_idx long")
    warped, found = stack.align_stack(px, refs, top_k=200, least=10)
    for r in found.collect():
        dy, dx = (a - b for a, b in zip(shifts[r["frame_idx"]], shifts[1]))
        assert abs(r["m"][2] - dx) < 0.6 and abs(r["m"][5] - dy) < 0.6, r
    done = image(warped.filter("frame_idx = 2"), (80, 90))
    assert np.abs(done[10:70, 10:80] - cut[1][10:70, 10:80, 0]).mean() < 4
    _, near = stack.align_stack(px, refs, top_k=200, within=6, border="REPLICATE")
    near = near.collect()
    assert len(near) == 3 and all(abs(r["m"][2] - (shifts[r["frame_idx"]][1] - 3)) < 0.5 for r in near)
    # without keypoints phase correlation steps in
    _, fallen = stack.align_stack(px, refs, top_k=200, least=10_000, phase_fallback=True)
    assert {r["frame_idx"] for r in fallen.collect()} == {0, 1, 2}
    assert all(abs(r["m"][2] - (shifts[r["frame_idx"]][1] - 3)) < 1.5 for r in fallen.collect())
    _, none = stack.align_stack(px, refs, top_k=200, least=10_000)
    assert [r["frame_idx"] for r in none.collect()] == [1]


def test_stack_job_keeps_a_still_scene(spark):
    a = texture(64, 70)
    px = table(spark, {f: a for f in range(3)})
    refs = spark.createDataFrame([(0, 1)], "stack_id long, ref_idx long")
    fuse = lambda p: pyramid.focus_stack_pyramid(p, 2)
    image_ = stack.stack_job(px, refs, [stack.balanced(refs), stack.auto_aligned(refs, top_k=100, border="REPLICATE")], fuse, [])
    assert np.abs(image(image_, (64, 70)) - a[..., 0]).max() <= 1
    sharp = stack.stack_job(px, refs, [], fuse, [stack.sharpened(1.0, 0.5)])
    assert image(sharp, (64, 70)).std() > a[..., 0].std()


def test_color_tone_mapping_keeps_hue(spark):
    a = texture(16, 16)
    got = filters.local_tonemap_color(with_size(table(spark, {0: a})), 0.5)
    gray = [image(got, (16, 16), c) for c in "bgr"]
    assert max(np.abs(gray[0] - g).max() for g in gray) <= 2  # gray stays gray
    same = filters.local_tonemap_color(with_size(table(spark, {0: a})), 0.0)
    assert np.array_equal(image(same, (16, 16)), a[..., 0])


def png(a):
    """The bytes of an 8-bit RGB image."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row[:, ::-1].astype(np.uint8).tobytes() for row in a)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_frames_are_read_and_written(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 256, (6, 7, 3))
    (tmp_path / "one.png").write_bytes(png(a))
    (tmp_path / "not.png").write_bytes(b"no image")
    read = src.read_frames(spark, str(tmp_path))
    for k, c in enumerate("bgr"):
        assert np.array_equal(image(read, (6, 7), c), a[..., k])
    path = f"{scratch_dir(spark)}/written"
    px = table(spark, {0: a})
    src.write_frames(px, path)
    src.write_frames(px, path, "append")
    assert src.read_pixels(spark, path).count() == 2 * 42
    src.write_frames(px, path, "overwrite")
    assert src.read_pixels(spark, path).count() == 42


def test_masked_histogram_counts_the_circle(spark):
    a = texture(20, 30)
    px = with_size(table(spark, {0: a}))
    y, x = np.mgrid[0:20, 0:30]
    inside = (x - 15) ** 2 + (y - 10) ** 2 <= 81
    got = balance.histogram(px, factor=2, mask_size=0.9).agg(F.sum("n")).first()[0]
    assert got == (inside & (y % 2 == 0) & (x % 2 == 0)).sum()


def test_a_job_leaves_its_result_alone(spark):
    a = texture(40, 44)
    px = table(spark, {f: a for f in range(3)})
    refs = spark.createDataFrame([(0, 1)], "stack_id long, ref_idx long")
    here = pathlib.Path(scratch_dir(spark).removeprefix("file://"))
    before = {p.name for p in here.iterdir()}
    run = lambda: stack.stack_job(px, refs, [stack.balanced(refs, "LAB"), stack.mask_noise(5)], lambda p: pyramid.focus_stack_pyramid(p, 1), [stack.sharpened()])
    assert run().count() == 40 * 44 and len({p.name for p in here.iterdir()} - before) == 1
    with scratch.scope(spark):
        assert run().count() == 40 * 44
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        scratch.written(px, "lost")
        raise ZeroDivisionError
    assert len({p.name for p in here.iterdir()} - before) == 1


def test_tiles_of_any_side_are_the_frames(spark):
    rng = np.random.default_rng(6)
    px = with_size(table(spark, {f: rng.integers(0, 65536, (53, 41, 3)) for f in range(3)}))
    for side in (8, 16, 256):
        packed = tiles.pack_tiles(px, side=side)
        assert packed.count() == 3 * -(-53 // side) * -(-41 // side)
        assert tiles.unpack_tiles(packed).select("frame_idx", "y", "x", "b", "g", "r").exceptAll(px.selectExpr("frame_idx", "y", "x", "double(b)", "double(g)", "double(r)")).count() == 0


@pytest.mark.parametrize("side", [16, 32])
def test_small_tiles_fuse_like_one(spark, side, monkeypatch):
    """Tiles much smaller than the frames, with margins from all neighbours, give what one tile gives."""
    rng = np.random.default_rng(7)
    frames = {f: np.clip(texture(90, 75, f) + rng.integers(-9, 9, (90, 75, 3)), 0, 255) for f in range(3)}
    px = table(spark, frames)
    whole = pyramid.focus_stack_pyramid(px, 4), depthmap.focus_stack_depthmap(px, levels=5, pyramid_smooth_size=3, energy_smooth_size=5)
    whole = [[image(w, (90, 75), c) for c in "bgr"] for w in whole]
    for module in (tiles.parts_of_pixels, tiles.parts_of_tiles, tiles.fuse_details, tiles.rebuild, depthmap._norms, depthmap._blend):
        monkeypatch.setattr(module, "__defaults__", tuple(side if v == tiles.SIDE else v for v in module.__defaults__))
    cut = pyramid.focus_stack_pyramid(px, 4), depthmap.focus_stack_depthmap(px, levels=5, pyramid_smooth_size=3, energy_smooth_size=5)
    for a, b in zip(whole, cut):
        assert all(np.array_equal(x, image(b, (90, 75), c)) for x, c in zip(a, "bgr"))


def test_balancing_keeps_the_reference_frame(spark):
    """Of 8-bit frames in every mode and map: no nulls, the reference as it is, the other frame brought near it."""
    a = texture(24, 30)
    px = table(spark, {0: a, 1: a * 3 // 4})
    refs = spark.createDataFrame([(0, 0)], "stack_id long, ref_idx long")
    for mode, map_ in [*((m, "MATCH_HIST") for m in balance.MODES), ("LAB", "LINEAR"), ("HSV", "LINEAR"), ("HLS", "GAMMA")]:
        done = written(balance.balance_frames(px, refs, mode, map_)[0], "balanced")
        assert done.filter("b is null or g is null or r is null").count() == 0
        kept, moved = (image(done.filter(f"frame_idx = {f}"), (24, 30)) for f in (0, 1))
        assert np.array_equal(kept, a[..., 0]) and abs(moved.mean() - kept.mean()) < 4, (mode, map_)
    with pytest.raises(ValueError):
        balance.balance_frames(px, refs, "YUV")
    with pytest.raises(ValueError):
        balance.balance_frames(px, refs, "RGB", "CUBIC")
