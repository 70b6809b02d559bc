"""Plane transforms as column expressions over arrays of nine doubles, row by row of a 3 x 3 matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _m(m: Column | str) -> list[Column]:
    m = F.col(m) if isinstance(m, str) else m
    return [m[i] for i in range(9)]


def compose(first: Column | str, then: Column | str) -> Column:
    """The transform that does ``first`` and then ``then``."""
    a, b = _m(first), _m(then)
    return F.array(*(b[3 * i] * a[j] + b[3 * i + 1] * a[3 + j] + b[3 * i + 2] * a[6 + j] for i in range(3) for j in range(3)))


def decompose_affine(m: Column | str) -> Column:
    """(sx, sy, rotation, shear, tx, ty), angles in degrees, shear within -180 to 180."""
    a, b, tx, c, d, ty, *_ = _m(m)
    rotation = F.degrees(F.atan2(b, a))
    raw = F.degrees(F.atan2(-c, d)) - rotation
    shear = F.pmod(raw + 180, F.lit(360.0)) - 180
    return F.struct(
        F.sqrt(a * a + b * b).alias("sx"), F.sqrt(c * c + d * d).alias("sy"), rotation.alias("rotation"),
        shear.alias("shear"), tx.alias("tx"), ty.alias("ty"),
    )


#: Limits of a normal and of a large affine distortion (rotation, least and most scale, shear, share of
#: the width or height), and of a homography (area ratio, aspect ratio, corner angle).
AFFINE_LIMITS = {"normal": (10.0, 0.9, 1.1, 5.0, 0.1), "large": (20.0, 0.5, 1.5, 10.0, 0.2)}
HOMOGRAPHY_LIMITS = {"normal": (1.5, 2.0, 10.0), "large": (2.0, 4.0, 12.0)}


def _number(v: Column | float) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def check_affine(m: Column | str, height: Column | float, width: Column | float, limits: str = "normal") -> Column:
    """The reasons against a transform, joined by '; '; empty if it is valid."""
    rotation, low, high, shear, share = AFFINE_LIMITS[limits]
    height, width, p = _number(height), _number(width), decompose_affine(m)
    scales = [((p[s] < low) | (p[s] > high), f"{s[1]}-scale") for s in ("sx", "sy")]
    far = [(F.abs(p["tx"]) > width * share, "x-translation"), (F.abs(p["ty"]) > height * share, "y-translation")]
    reasons = [(F.abs(p["rotation"]) > rotation, "rotation"), *scales, (F.abs(p["shear"]) > shear, "shear"), *far]
    return F.concat_ws("; ", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in reasons))))


def apply(m: Column | str, x: Column, y: Column) -> tuple[Column, Column]:
    m = _m(m)
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def check_homography(m: Column | str, height: Column | float, width: Column | float, limits: str = "normal") -> Column:
    """(area_ratio, aspect, angle, reasons): the image of the frame's corners held against the frame.

    The aspect is that of the least rectangle around the four corners; one of its sides lies along an edge.
    """
    area_limit, aspect_limit, angle_limit = HOMOGRAPHY_LIMITS[limits]
    height, width, zero = _number(height), _number(width), F.lit(0.0)
    placed = [apply(m, x, y) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))]
    points = F.array(*(F.struct(u.alias("x"), v.alias("y")) for u, v in placed))

    def measure(c: Column) -> Column:
        p = [(c[i]["x"], c[i]["y"]) for i in range(4)]
        edges = list(zip(p, p[1:] + p[:1], strict=True))
        twice = sum((a[0] * b[1] - b[0] * a[1] for a, b in edges), F.lit(0.0))
        ratio = F.abs(twice) / 2 / (width * height)
        sides = F.array(*(_box(p, a, b) for a, b in edges))
        boxes = F.transform(sides, lambda e: F.struct(F.round(e["s"] * e["t"], 6).alias("area"), (F.greatest(e["s"], e["t"]) / F.least(e["s"], e["t"])).alias("aspect")))
        angle = F.array_max(F.array(*(_off_square(p[i - 1], p[i], p[(i + 1) % 4]) for i in range(4))))
        return F.struct(ratio.alias("ratio"), F.array_min(boxes)["aspect"].alias("aspect"), angle.alias("angle"))

    def judge(q: Column) -> Column:
        ratio = q["ratio"]
        reasons = [((ratio > area_limit) | (ratio < 1 / area_limit), "area"), (q["aspect"] > aspect_limit, "aspect"), (q["angle"] > angle_limit, "angle")]
        text = F.concat_ws("; ", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in reasons))))
        return F.struct(ratio.alias("area_ratio"), q["aspect"].alias("aspect"), q["angle"].alias("angle"), text.alias("reasons"))

    # lambdas over one-element arrays name what is used many times, so that it is worked out once
    return F.transform(F.transform(F.array(points), measure), judge)[0]


def _box(p: list[tuple[Column, Column]], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The sides of the rectangle around points p that lies along the edge from a to b."""
    ux, uy = b[0] - a[0], b[1] - a[1]
    norm = F.sqrt(ux * ux + uy * uy)
    along = F.array(*((q[0] * ux + q[1] * uy) / norm for q in p))
    across = F.array(*((q[1] * ux - q[0] * uy) / norm for q in p))
    return F.struct((F.array_max(along) - F.array_min(along)).alias("s"), (F.array_max(across) - F.array_min(across)).alias("t"))


def _off_square(a: tuple[Column, Column], q: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """How many degrees the corner at q is off a right angle."""
    ax, ay, bx, by = a[0] - q[0], a[1] - q[1], b[0] - q[0], b[1] - q[1]
    cosine = (ax * bx + ay * by) / F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    return F.abs(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(cosine, F.lit(1.0))))) - 90)


def rescale_transform(m: Column | str, subsample: Column | float, kind: str = "rigid") -> Column:
    """A transform found on subsampled frames, for whole frames."""
    v = _m(m)
    s = _number(subsample)
    if kind == "rigid":
        return F.array(v[0], v[1], v[2] * s, v[3], v[4], v[5] * s, *v[6:])
    return F.array(v[0], v[1], v[2] * s, v[3], v[4], v[5] * s, v[6] / s, v[7] / s, v[8])


def inverse(m: Column | str) -> Column:
    a, b, c, d, e, f, g, h, i = _m(m)
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    parts = (
        e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d,
    )
    return F.array(*(p / det for p in parts))
