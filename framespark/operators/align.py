"""Alignment: keypoints, descriptor matching, robust transforms, their chain to the reference, and warping."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import geometry
from ..sources.scratch import written
from .phase import phase_shift  # noqa: F401
from .stencil import FRAME, stencil, stencils

PAIR = ("stack_id", "frame_idx")
#: Keypoints of a frame that meet keypoints of its target in one task; fuller frames meet by parts.
BLOCK = 2048


def detect_keypoints(px: DataFrame, top_k: int = 500, k: float = 0.04) -> DataFrame:
    """(stack_id, frame_idx, kp_id, y, x, response, bits) of gray frames: the strongest corners of each frame.

    Corner response from windowed products of slopes; 32 comparisons on a fixed ring describe each corner. ``px`` has
    ``v``, ``h`` and ``w``; frames with a side under 9 have no corners.
    """
    v = px.withColumn("v", F.col("v").cast("double"))
    slopes = stencils(v, {"gx": ("v", (1, 2, 1), (-1, 0, 1)), "gy": ("v", (-1, 0, 1), (1, 2, 1))})
    products = slopes.withColumns({"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")})
    sums = stencil(products, (1,) * 5, None, ["xx", "yy", "xy"])
    trace = F.col("xx") + F.col("yy")
    response = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - k * trace * trace
    inner = (F.col("y") >= 4) & (F.col("x") >= 4) & (F.col("y") < F.col("h") - 4) & (F.col("x") < F.col("w") - 4)
    ranked = sums.withColumn("response", F.round(response, 3)).filter(inner & (F.col("response") > 0))
    order = Window.partitionBy(*FRAME).orderBy(F.desc("response"), "y", "x")
    best = ranked.withColumn("kp_id", F.row_number().over(order) - 1).filter(F.col("kp_id") < top_k)
    best = best.select(*FRAME, F.col("kp_id").cast("long"), "y", "x", "response")
    steps = [((37 * i) % 9 - 4, (23 * i + 5) % 9 - 4, (17 * i + 3) % 9 - 4, (29 * i + 7) % 9 - 4) for i in range(32)]
    ring = F.explode(F.array(*(F.struct(*(F.lit(a).alias(c) for a, c in zip((i, *s), ("i", "ay", "ax", "by", "bx"), strict=True))) for i, s in enumerate(steps))))
    tests = best.withColumn("t", ring).select(*FRAME, "kp_id", "t.i", *((F.col(c) + F.col(f"t.{e}{c}")).alias(f"{e}{c}") for e in "ab" for c in "yx"))
    at = lambda e: px.select(*FRAME, F.col("y").alias(f"{e}y"), F.col("x").alias(f"{e}x"), F.col("v").alias(f"v{e}"))
    read = tests.join(at("a"), [*FRAME, "ay", "ax"]).join(at("b"), [*FRAME, "by", "bx"])
    bits = read.groupBy(*FRAME, "kp_id").agg(F.sum(F.when(F.col("va") < F.col("vb"), F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), F.col("i")).cast("long")).otherwise(0)).alias("bits"))
    return best.join(bits, [*FRAME, "kp_id"])


def _meet(kp: DataFrame, pairs: DataFrame, col: str, keep: int, block: int = BLOCK) -> DataFrame:
    """(stack_id, frame_idx, target_idx, way, kp, other, dist): the ``keep`` nearest that each keypoint has in each part of
    the other frame; way 0 is from a frame to its target, way 1 back. Frames meet part by part, so a task holds two
    parts, and no pair but those kept leaves it."""
    parts = kp.groupBy(*PAIR).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = kp.select(*PAIR, F.col("kp_id").alias("kp"), F.col(col).alias("d")).join(parts, list(PAIR))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("kp"), F.col("parts")).cast("int"))
    other = parts.select("stack_id", F.col("frame_idx").alias("of"), F.col("parts").alias("others"))
    each = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    pairs = pairs.select(*PAIR, "target_idx")
    left = placed.join(pairs, list(PAIR)).join(other, (F.col("of") == F.col("target_idx")) & (placed["stack_id"] == other["stack_id"]))
    left = left.select(pairs["stack_id"], pairs["frame_idx"], "target_idx", F.lit(0).alias("way"), F.col("part").alias("p0"), each.alias("p1"), "kp", "d")
    there = placed.withColumnRenamed("frame_idx", "target_idx").join(pairs, ["stack_id", "target_idx"])
    right = there.join(other.withColumnRenamed("of", "frame_idx"), list(PAIR)).select(
        *PAIR, "target_idx", F.lit(1).alias("way"), each.alias("p0"), F.col("part").alias("p1"), "kp", "d"
    )

    def distances(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
        if pa.types.is_integer(a.type):
            return np.bitwise_count(a.to_numpy()[:, None] ^ b.to_numpy()[None, :]).astype(np.float64)
        x, y = (pa.concat_arrays(c.chunks).flatten().to_numpy().astype(np.float64).reshape(len(c), -1) for c in (a, b))
        out, step = np.zeros((len(x), len(y))), max(1, (1 << 20) // max(1, y.size))
        for lo in range(0, len(x), step):
            out[lo : lo + step] = ((x[lo : lo + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        return np.round(np.sqrt(out), 9)

    def run(table: pa.Table) -> pa.Table:
        way = table.column("way").to_numpy()
        sides = [table.filter(pa.array(way == k)).sort_by("kp") for k in (0, 1)]  # so that the first of equals has the least id
        found = []
        if all(t.num_rows for t in sides):
            dist = distances(sides[0].column("d"), sides[1].column("d"))
            ids = [t.column("kp").to_numpy() for t in sides]
            for k, d in ((0, dist), (1, dist.T.copy())):
                own = np.arange(len(d))
                for n in range(min(keep, d.shape[1])):
                    at = d.argmin(axis=1)
                    found.append((np.full(len(d), k, np.int32), ids[k], ids[1 - k][at], d[own, at]))
                    if n + 1 < keep:
                        if k == 0 and n == 0:
                            d = d.copy()
                        d[own, at] = np.inf
        kinds = [("way", np.int32), ("kp", np.int64), ("other", np.int64), ("dist", np.float64)]
        columns = [np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, (_, t) in enumerate(kinds)]
        names = {c: pa.array(np.full(len(columns[0]), table.column(c)[0].as_py(), np.int64)) for c in (*PAIR, "target_idx")}
        return pa.table(names | {n: pa.array(v) for (n, _), v in zip(kinds, columns, strict=True)})

    schema = "stack_id long, frame_idx long, target_idx long, way int, kp long, other long, dist double"
    return left.unionByName(right).groupBy(*PAIR, "target_idx", "p0", "p1").applyInArrow(run, schema)


def match_knn(kp: DataFrame, pairs: DataFrame, ratio: float = 0.75, block: int = BLOCK) -> DataFrame:
    """Nearest descriptors by Euclidean distance that are nearer than ``ratio`` times the second nearest."""
    met = _meet(kp, pairs, "desc", 2, block).filter("way = 0")
    order = Window.partitionBy(*PAIR, "target_idx", "kp").orderBy("dist", "other")
    two = met.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    nearest = two.groupBy(*PAIR, "target_idx", F.col("kp").alias("kp0")).agg(
        *(F.max(F.when(F.col("rank") == k, F.col(c))).alias(n) for k, c, n in ((1, "other", "kp1"), (1, "dist", "dist"), (2, "dist", "second")))
    )
    return nearest.filter(F.col("dist") < ratio * F.col("second")).select(*PAIR, "target_idx", "kp0", "kp1", "dist")


def match_cross_check(kp: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of binary descriptors that are each other's nearest by Hamming distance; ties go to the lower id."""
    return _mutual(_meet(kp, pairs, "bits", 1, block))


def match_within(kp: DataFrame, pairs: DataFrame, within: int = 11, block: int = BLOCK) -> DataFrame:
    """The matches of ``match_cross_check`` that are at most ``within`` bits apart, found without comparing all keypoints.

    The bits are dealt out to ``within div 2 + 1`` tables: two words at most ``within`` apart differ by at most one bit in one
    of them, so each word looks its own and its one-bit neighbours up in every table, and what it meets is compared in
    full. Of equal words of a frame only the least id can match, so they count once; entries of a table with more than
    ``block`` words are met by parts. Keypoints without bits match nothing.
    """
    if not 0 <= within < 64:
        raise ValueError(f"within must be from 0 to 63: {within}")
    signed = lambda word: F.lit(word - (1 << 64) if word >> 63 else word).cast("long")
    tables = within // 2 + 1
    dealt = [range(k, 64, tables) for k in range(tables)]
    key = [F.col("bits").bitwiseAND(signed(sum(1 << i for i in each))) for each in dealt]
    words = kp.filter("bits IS NOT NULL").groupBy(*PAIR, "bits").agg(F.min("kp_id").alias("kp"))
    pairs = pairs.select(*PAIR, "target_idx").distinct()
    met = pairs.select("stack_id", F.col("target_idx").alias("frame_idx")).distinct()
    entries = words.join(met, list(PAIR), "left_semi").select("stack_id", F.col("frame_idx").alias("target_idx"), "kp", "bits", F.posexplode(F.array(*key)).alias("table", "key"))
    at = ["stack_id", "target_idx", "table", "key"]
    full = entries.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.join(full, at, "left").withColumn("part", F.pmod(F.xxhash64("kp"), parts).cast("int"))
    entries = entries.select(*at, "part", F.col("kp").alias("kp1"), F.col("bits").alias("other"))
    asked = [F.struct(F.lit(k).alias("table"), v.alias("key")) for k, own in enumerate(key) for v in (own, *(own.bitwiseXOR(signed(1 << i)) for i in dealt[k]))]
    probes = words.join(pairs, list(PAIR)).select(*PAIR, "target_idx", "kp", "bits", F.explode(F.array(*asked)).alias("at"))
    probes = probes.select(*PAIR, "target_idx", F.col("kp").alias("kp0"), "bits", "at.table", "at.key").join(full, at, "left")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dist = F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))).cast("long")
    found = probes.join(entries, [*at, "part"]).withColumn("dist", dist).filter(F.col("dist") <= within)
    ways = F.array(*(F.struct(F.lit(k).alias("way"), F.col(a).alias("kp"), F.col(b).alias("other")) for k, a, b in ((0, "kp0", "kp1"), (1, "kp1", "kp0"))))
    return _mutual(found.select(*PAIR, "target_idx", "dist", F.inline(ways)))


def _mutual(met: DataFrame) -> DataFrame:
    """Matches that are nearest both ways, of ``met(stack_id, frame_idx, target_idx, way, kp, other, dist)``."""
    best = F.min(F.struct("dist", "other")).alias("best")
    nearest = met.groupBy(*PAIR, "target_idx", "way", "kp").agg(best)
    # a pair that holds both ways is met twice
    kp0 = F.when(F.col("way") == 0, F.col("kp")).otherwise(F.col("best.other")).alias("kp0")
    kp1 = F.when(F.col("way") == 0, F.col("best.other")).otherwise(F.col("kp")).alias("kp1")
    both = nearest.groupBy(*PAIR, "target_idx", kp0, kp1).agg(F.count("*").alias("ways"), F.first("best.dist").cast("long").alias("dist"))
    return both.filter("ways = 2").select(*PAIR, "target_idx", "kp0", "kp1", "dist")


def best_matches(matches: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank``, matches of a pair of frames by distance, then by keypoint; with ``most`` the first so many alone."""
    order = Window.partitionBy(*PAIR, "target_idx").orderBy("dist", "kp0")
    ranked = matches.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def pair_frames(frames: DataFrame, refs: DataFrame, delta_max: int = 2) -> DataFrame:
    """(stack_id, frame_idx, target_idx, delta): each frame's candidates towards the reference, never past it."""
    held = frames.select(*PAIR).join(refs, "stack_id").filter("frame_idx <> ref_idx")
    delta = F.explode(F.sequence(F.lit(1), F.lit(delta_max)))
    way = F.signum((F.col("ref_idx") - F.col("frame_idx")).cast("double")).cast("long")
    near = held.withColumn("delta", delta).filter(F.col("delta") <= F.abs(F.col("ref_idx") - F.col("frame_idx")))
    return near.select(*PAIR, (F.col("frame_idx") + way * F.col("delta")).alias("target_idx"), "delta")


def choose_pairs(candidates: DataFrame, valid: DataFrame) -> DataFrame:
    """Per frame the nearest target for which ``valid`` has a transform."""
    found = candidates.join(valid, [*PAIR, "target_idx"])
    best = F.min_by(F.struct("target_idx", "m"), "delta").alias("t")
    return found.groupBy(*PAIR).agg(best).select(*PAIR, "t.target_idx", "t.m")


def match_counts(matches: DataFrame, least: int = 20) -> DataFrame:
    n = matches.groupBy(*PAIR).agg(F.count("*").alias("n"))
    return n.withColumn("enough", F.col("n") >= least)


def similarity_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, n): the least-squares similarity of matched points in closed form, from sums alone."""
    x, y, u, v = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    s = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(u).alias("u"), F.sum(v).alias("v"),
        F.sum(x * x + y * y).alias("q"), F.sum(x * u + y * v).alias("c"), F.sum(x * v - y * u).alias("d"),
    )
    n, x, y, u, v, q, c, d = (F.col(k) for k in ("n", "x", "y", "u", "v", "q", "c", "d"))
    spread = q - (x * x + y * y) / n
    a, b = (c - (x * u + y * v) / n) / spread, (d - (x * v - y * u) / n) / spread
    m = F.array(a, -b, (u - a * x + b * y) / n, b, a, (v - b * x - a * y) / n, *map(F.lit, (0.0, 0.0, 1.0)))
    return s.select(*keys, m.alias("m"), n.cast("long").alias("n"))


#: Matches that fix a transform, by kind.
SAMPLE = {"similarity": 2, "homography": 4}
#: Strides and offsets of the arithmetic sequences that pick matches.
PICKS = ((7919, 104729), (6101, 15485), (5477, 7001), (4337, 3083))


def _picked(hyp: DataFrame, kind: str) -> DataFrame:
    """Adds ``i0, i1, …``, the numbers of the matches of each hypothesis; those that pick one twice are left out."""
    n, h = F.col("n"), F.col("hyp")
    first = (h * PICKS[0][0] + PICKS[0][1]) % n
    second = (first + 1 + (h * PICKS[1][0] + PICKS[1][1]) % (n - 1)) % n
    at = [first, second, *((h * a + b) % n for a, b in PICKS[2 : SAMPLE[kind]])]
    hyp = hyp.withColumns({f"i{k}": v for k, v in enumerate(at)})
    return hyp.filter(F.size(F.array_distinct(F.array(*(F.col(f"i{k}") for k in range(len(at)))))) == len(at))


def _similarity_of_two() -> tuple[Column, Column]:
    """(the exact similarity of points 0 and 1, whether they fix one)."""
    dx, dy, du, dv = (F.col(f"{c}_1") - F.col(f"{c}_0") for c in ("x0", "y0", "x1", "y1"))
    size = dx * dx + dy * dy
    a, b = (dx * du + dy * dv) / size, (dx * dv - dy * du) / size
    x, y, u, v = (F.col(f"{c}_0") for c in ("x0", "y0", "x1", "y1"))
    return F.array(a, -b, u - a * x + b * y, b, a, v - b * x - a * y, *map(F.lit, (0.0, 0.0, 1.0))), size > 0


def _homography_of_four() -> tuple[Column, Column]:
    """(the exact homography of points 0 to 3, whether no three of them lie on a line), in closed form.

    Each side's points are the image of the projective base: three of them, scaled so that they add up to the fourth. The
    homography goes from one base to the other; the inverse is the adjugate, as scale does not count.
    """

    def side(x: str, y: str) -> tuple[list[list[Column]], list[Column]]:
        p = [(F.col(f"{x}_{k}"), F.col(f"{y}_{k}")) for k in range(4)]
        area = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
        scale = [area(p[3], p[1], p[2]), area(p[0], p[3], p[2]), area(p[0], p[1], p[3])]
        base = [[s * q[0] for s, q in zip(scale, p)], [s * q[1] for s, q in zip(scale, p)], scale]
        return base, [*scale, area(p[0], p[1], p[2])]

    (a, of_a), (b, of_b) = side("x0", "y0"), side("x1", "y1")
    ways = [(1, 2), (2, 0), (0, 1)]
    adjugate = [[a[r0][c0] * a[r1][c1] - a[r0][c1] * a[r1][c0] for r0, r1 in ways] for c0, c1 in ways]
    m = [sum((b[i][k] * adjugate[k][j] for k in (1, 2)), b[i][0] * adjugate[0][j]) for i in range(3) for j in range(3)]
    sound = F.lit(True)
    for t in (*of_a, *of_b):
        sound = sound & (F.abs(t) > 1e-6)
    return F.transform(F.array(F.array(*m)), lambda h: F.transform(h, lambda v: v / h[8]))[0], sound


def robust_fit(
    matches: DataFrame, threshold: float = 3.0, max_iters: int = 2000, method: str = "RANSAC", kind: str = "similarity", confidence: float = 0.999,
    keys: Sequence[str] = PAIR,
) -> DataFrame:
    """(keys, m, n_inliers, n, tried): a transform for each of ``keys``, robust to outliers.

    A hypothesis is the exact similarity of two matches, or the exact homography of four, picked by an arithmetic sequence,
    so any run gives the same; samples that fix no transform are left out. RANSAC keeps the hypothesis that most matches
    fit within ``threshold`` pixels, LMEDS the one with the least median residual; of equals the first. The result is
    fitted to its inliers.

    RANSAC tries hypotheses in rounds, each twice as large as the one before: a frame leaves once its share of inliers
    makes a better sample improbable (``confidence``) or at ``max_iters``. LMEDS tries as many as ``confidence`` asks for
    when 45 in 100 matches are outliers. Only sums leave the join of a frame's matches with its round.
    """
    if method not in ("RANSAC", "LMEDS") or kind not in SAMPLE:
        raise ValueError(f"unknown method or kind: {method}, {kind}")
    keys, size, points = list(keys), SAMPLE[kind], ("x0", "y0", "x1", "y1")
    frame = Window.partitionBy(*keys)
    numbered = matches.dropna(subset=list(points)).withColumns({"i": F.row_number().over(frame.orderBy("kp_id")) - 1, "n": F.count("*").over(frame)})
    numbered = written(numbered.filter(F.col("n") >= size).select(*keys, "i", "n", *points), "numbered")
    p = numbered.drop("n")
    frames = numbered.groupBy(*keys).agg(F.max("n").alias("n"))
    rest = math.log(max(1 - confidence, 1e-12))
    fixed = min(max_iters, math.ceil(rest / math.log(1 - 0.55**size)))
    state = frames.select(*keys, "n", F.lit(0).cast("long").alias("tried"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<double>").alias("m"))
    done, batch = 0, 16 if method == "RANSAC" else fixed
    u, v = geometry.apply("m", F.col("x0"), F.col("y0"))
    error = F.round(F.sqrt(F.pow(u - F.col("x1"), F.lit(2.0)) + F.pow(v - F.col("y1"), F.lit(2.0))), 6)
    left: list[DataFrame] = []
    while done < max_iters:
        batch = min(batch, max_iters - done)
        hyp = _picked(state.select(*keys, "n", F.explode(F.sequence(F.lit(done), F.lit(done + batch - 1))).alias("hyp")), kind)
        for k in range(size):
            q = p.select(*keys, F.col("i").alias(f"i{k}"), *(F.col(c).alias(f"{c}_{k}") for c in points))
            hyp = hyp.join(q, [*keys, f"i{k}"])
        model, sound = _similarity_of_two() if kind == "similarity" else _homography_of_four()
        models = hyp.filter(sound).select(*keys, "hyp", model.alias("m"))
        scored = models.join(p.drop("i"), keys).withColumn("e", error)
        score = F.count_if(F.col("e") <= threshold).cast("double") if method == "RANSAC" else -F.percentile("e", F.lit(0.5))
        scored = scored.groupBy(*keys, "hyp").agg(score.alias("score"), F.first("m").alias("m"))
        best = scored.groupBy(*keys).agg(F.max(F.struct("score", -F.col("hyp"), "m")).alias("new"))
        better = F.col("new").isNotNull() & (F.col("score").isNull() | (F.col("new.score") > F.col("score")))
        done += batch
        state = state.join(best, keys, "left").select(
            *keys, "n", F.lit(done).cast("long").alias("tried"),
            F.when(better, F.col("new.score")).otherwise(F.col("score")).alias("score"), F.when(better, F.col("new.m")).otherwise(F.col("m")).alias("m"),
        )
        all_good = F.pow(F.coalesce("score", F.lit(0.0)) / F.col("n"), F.lit(float(size)))
        needed = F.when(all_good >= 1, 0.0).when(all_good <= 0, float(max_iters)).otherwise(F.ceil(rest / F.log(1 - all_good)))
        over = F.lit(method == "LMEDS" or done >= max_iters) | (F.col("tried") >= needed)
        state = written(state.withColumn("over", over), "rounds")
        left.append(state.filter("over").drop("over"))
        state = state.filter("not over").drop("over")
        if method == "LMEDS" or state.isEmpty():
            break
        batch *= 2
    found = left[0]
    for more in left[1:]:
        found = found.unionByName(more)
    found = found.filter("m is not null")
    inliers = p.drop("i").join(found.select(*keys, "m"), keys).filter(error <= threshold).drop("m")
    fitted = similarity_sums(inliers, keys).withColumnRenamed("n", "n_inliers") if kind == "similarity" else homography_fit(inliers, keys)
    if kind == "homography":
        fitted = fitted.join(inliers.groupBy(*keys).agg(F.count("*").alias("n_inliers")), keys)
    return fitted.join(found.select(*keys, "n", "tried"), keys)


def fit_quality(matches: DataFrame, models: DataFrame, subsample: int = 1, threshold: float = 3.0, keys: Sequence[str] = PAIR) -> DataFrame:
    """Share of inliers, mean error over the root of their number, worst error, and GOOD, POOR or FAILED."""
    keys = list(keys)
    both = matches.join(models.select(*keys, "m"), keys)
    u, v = geometry.apply("m", F.col("x0"), F.col("y0"))
    e = F.sqrt(F.pow(u - F.col("x1"), F.lit(2.0)) + F.pow(v - F.col("y1"), F.lit(2.0)))
    both = both.withColumn("e", F.round(e, 6))
    inlier = F.col("e") <= threshold
    n = F.count_if(inlier)
    stats = both.groupBy(*keys).agg(
        (n / F.count("*")).alias("inlier_share"),
        (F.avg(F.when(inlier, F.col("e"))) / F.sqrt(n.cast("double")) * subsample).alias("avg_error"),
        (F.max(F.when(inlier, F.col("e"))) * subsample).alias("max_error"),
    )
    return stats.withColumn("status", quality_status())


def quality_status() -> Column:
    """GOOD, POOR or FAILED by a fit's share of inliers and its mean and worst error."""
    good = (F.col("inlier_share") >= 0.75) & (F.col("avg_error") <= 1) & (F.col("max_error") <= 30)
    return F.when(F.col("avg_error").isNull(), "FAILED").when(good, "GOOD").otherwise("POOR")


def homography_fit(matches: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """(keys, m): a homography by normalised linear equations of all matches.

    The normal matrix of the equations is made of 24 sums of products, which Spark adds up whatever the number of matches;
    only the sums of a frame are solved in Python. Frames with fewer than four matches with all coordinates are left out.
    """
    points = ["x0", "y0", "x1", "y1"]
    known = matches.dropna(subset=points)
    scale = lambda a, b: F.greatest(F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2), F.lit(1e-9))
    frames = known.groupBy(*keys).agg(
        *(F.avg(c).alias(f"mean_{c}") for c in points), scale("x0", "y0").alias("scale_0"), scale("x1", "y1").alias("scale_1"), F.count("*").alias("n")
    ).filter("n >= 4")
    x, y, u, v = ((F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c[1]}") for c in points)
    point, one = (x, y, F.lit(1.0)), F.lit(1.0)
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [F.sum(point[i] * point[j] * by).alias(f"s{k}_{i}{j}") for k, by in enumerate((one, u, v, u * u + v * v)) for i, j in upper]
    norms = [*(f"mean_{c}" for c in points), "scale_0", "scale_1"]
    summed = known.select(*keys, *points).join(frames, list(keys)).groupBy(*keys, *norms).agg(*sums)

    def solve(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = []
            for r in pdf.to_dict("records"):
                plain, by_u, by_v, by_both = (np.array([[r[f"s{k}_{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) for k in range(4))
                none = np.zeros((3, 3))
                normal = np.block([[plain, none, -by_u], [none, plain, -by_v], [-by_u, -by_v, by_both]])
                t, s = (
                    np.array([[1 / size, 0, -mx / size], [0, 1 / size, -my / size], [0, 0, 1]])
                    for size, mx, my in ((r[f"scale_{k}"], r[f"mean_x{k}"], r[f"mean_y{k}"]) for k in (0, 1))
                )
                m = np.linalg.inv(s) @ np.linalg.eigh(normal)[1][:, 0].reshape(3, 3) @ t
                found.append((m / m[2, 2]).ravel().tolist())
            yield pdf[list(keys)].assign(m=found)

    schema = StructType([f for f in summed.schema if f.name in keys]).add("m", ArrayType(DoubleType()))
    return summed.mapInPandas(solve, schema)


def compose_chain(transforms: DataFrame, refs: DataFrame) -> DataFrame:
    """(stack_id, frame_idx, m): each frame's way to the reference.

    ``transforms(stack_id, frame_idx, target_idx, m)``: frame to target. By pointer jumping: in every round each way is
    prolonged by its end's own way, so rounds are logarithmic in the longest chain and no row holds a stack. A frame
    whose chain is broken, or runs in a circle, is left out.
    """
    unit = F.array(*map(F.lit, (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0))).cast("array<double>")
    ways = transforms.join(refs, "stack_id").filter("frame_idx <> ref_idx").select(*PAIR, F.col("target_idx").alias("at"), "ref_idx", "m")
    longest = ways.groupBy("stack_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # more rounds than any chain needs: what still goes on runs in a circle
        end = ways.select("stack_id", F.col("frame_idx").alias("at"), F.col("at").alias("to"), F.col("m").alias("more"))
        on = F.col("to").isNotNull()
        ways = ways.join(end, ["stack_id", "at"], "left").select(
            *PAIR, F.coalesce("to", "at").alias("at"), "ref_idx", F.when(on, geometry.compose("m", "more")).otherwise(F.col("m")).alias("m"), on.alias("moved")
        )
        ways = written(ways, "ways")
        if ways.filter("moved").isEmpty():
            break
        ways = ways.drop("moved")
    found = ways.filter("at = ref_idx").select(*PAIR, "m")
    return found.unionByName(refs.select("stack_id", F.col("ref_idx").alias("frame_idx"), unit.alias("m")))


def without_transform(frames: DataFrame, chained: DataFrame) -> DataFrame:
    """The frames that no chain of transforms leads to the reference."""
    return frames.join(chained.select(*PAIR), list(PAIR), "left_anti")


def warp(px: DataFrame, transforms: DataFrame, border: str = "REPLICATE", value: int = 0, cols: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Frames resampled to their target's grid: bilinear samples at the inverse image of every place.

    ``m`` maps a frame to its target; ``px`` has ``h`` and ``w``. Beyond the frame's edge REPLICATE takes the edge
    and CONSTANT takes ``value``; REPLICATE_BLUR replicates and adds ``outside`` for ``blur_outside``. The result
    rounds down after six digits.
    """
    held = px.select(*FRAME, "y", "x", "h", "w").join(transforms.select(*FRAME, geometry.inverse("m").alias("inv")), list(FRAME))
    u, v = geometry.apply("inv", F.col("x").cast("double"), F.col("y").cast("double"))
    held = held.withColumns({"u": F.round(u, 9), "v": F.round(v, 9)})
    taps = F.explode(F.array(*(F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j in (0, 1) for i in (0, 1))))
    spread = held.withColumn("t", taps)
    fy, fx = F.floor("v"), F.floor("u")
    wy = F.when(F.col("t.dy") == 1, F.col("v") - fy).otherwise(1 - (F.col("v") - fy))
    wx = F.when(F.col("t.dx") == 1, F.col("u") - fx).otherwise(1 - (F.col("u") - fx))
    sy, sx = fy + F.col("t.dy"), fx + F.col("t.dx")
    beyond = (sy < 0) | (sx < 0) | (sy >= F.col("h")) | (sx >= F.col("w"))
    clamp = lambda s, n: F.greatest(F.lit(0).cast("long"), F.least(s, F.col(n) - 1))
    asked = spread.select(
        *FRAME, F.col("y").alias("ty"), F.col("x").alias("tx"), (wy * wx).alias("wt"), beyond.alias("beyond"),
        clamp(sy, "h").alias("y"), clamp(sx, "w").alias("x"),
    )
    found = asked.join(px.select(*FRAME, "y", "x", *cols), [*FRAME, "y", "x"])
    pick = (lambda c: F.when(F.col("beyond"), F.lit(float(value))).otherwise(F.col(c))) if border == "CONSTANT" else F.col
    out = found.groupBy(*FRAME, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(
        *(F.floor(F.round(F.sum(pick(c) * F.col("wt")), 6)).cast("long").alias(c) for c in cols), F.max("beyond").alias("outside")
    )
    return out if border == "REPLICATE_BLUR" else out.drop("outside")


def blur_outside(px: DataFrame, sigma: float = 50.0, size: int = 21, cols: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Gaussian blur where ``outside`` is true, the frame as it is elsewhere; ``px`` has ``h`` and ``w``."""
    from .stencil import gaussian_taps

    blurred = stencil(px, gaussian_taps(sigma, size), None, list(cols), out=[f"s_{c}" for c in cols])
    fixed = {c: F.when(F.col("outside"), F.floor(F.round(f"s_{c}", 6)).cast("long")).otherwise(F.col(c)) for c in cols}
    return blurred.withColumns(fixed).drop("outside", *(f"s_{c}" for c in cols))
