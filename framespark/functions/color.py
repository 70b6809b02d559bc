"""Colour spaces and tone curves as column expressions: no Python runs on pixels.

Colour spaces follow the depth of the channels: at 8 bits hue is half the degrees and values are the nearest whole numbers,
at 16 bits hue fills the range and values are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Channel = Column | str


def _c(x: Channel) -> Column:
    return F.col(x) if isinstance(x, str) else x


def top(depth: int) -> int:
    return (1 << depth) - 1


def bit8(v: Channel, depth: int = 16) -> Column:
    return F.shiftright(_c(v), 8) if depth == 16 else _c(v)


def gray(b: Channel, g: Channel, r: Channel) -> Column:
    """Luma by integer weights that add up to 2**14, rounded."""
    return F.shiftright(4899 * _c(r) + 9617 * _c(g) + 1868 * _c(b) + 8192, 14)


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it: else expressions within expressions grow too
    large to be planned."""
    return F.transform(F.array(value), f)[0]


def _whole(v: Column, most: int) -> Column:
    """Clipped to the range and cut to a whole number."""
    return F.floor(F.greatest(F.lit(0.0), F.least(v, F.lit(float(most))))).cast("long")


def _level(v: Column, most: int, depth: int) -> Column:
    """As a channel's value: the nearest whole number at 8 bits, the one below at 16."""
    return _whole(v + 0.5 if depth == 8 else v, most)


def _turn(degrees: Column, depth: int) -> Column:
    """A hue as a channel's value: half the degrees at 8 bits (0 to 179), a share of all values at 16."""
    if depth == 8:
        return F.pmod(F.floor(degrees / 2 + 0.5), F.lit(180)).cast("long")
    return _whole(degrees / 360 * top(depth), top(depth))


def _degrees(h: Channel, depth: int) -> Column:
    return _c(h).cast("double") * 2 if depth == 8 else _unit(h, depth=depth)[0] * 360


def _hue(b: Column, g: Column, r: Column, high: Column, delta: Column) -> Column:
    """Degrees; of equal channels the test for blue counts before that for green, and that before red."""
    red = 60 * (g - b) / delta
    red = F.when(red < 0, red + 360).otherwise(red)
    return (
        F.when(delta == 0, F.lit(0.0))
        .when(high == b, 60 * (r - g) / delta + 240)
        .when(high == g, 60 * (b - r) / delta + 120)
        .otherwise(red)
    )


def _unit(*channels: Channel, depth: int) -> list[Column]:
    return [_c(c).cast("double") / top(depth) for c in channels]


def bgr_to_hsv(b: Channel, g: Channel, r: Channel, depth: int = 16) -> Column:
    b, g, r = _unit(b, g, r, depth=depth)
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    delta, m = high - low, top(depth)
    s = F.when(high == 0, F.lit(0.0)).otherwise(delta / high)
    return _struct(h=_turn(_hue(b, g, r, high, delta), depth), s=_level(s * m, m, depth), v=_level(high * m, m, depth))


def bgr_to_hls(b: Channel, g: Channel, r: Channel, depth: int = 16) -> Column:
    b, g, r = _unit(b, g, r, depth=depth)
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    delta, m, light = high - low, top(depth), (high + low) / 2
    s = F.when(delta == 0, F.lit(0.0)).when(light < 0.5, delta / (high + low)).otherwise(delta / (2 - high - low))
    return _struct(h=_turn(_hue(b, g, r, high, delta), depth), l=_level(light * m, m, depth), s=_level(s * m, m, depth))


def _from_chroma(h: Column, c: Column, low: Column, depth: int) -> Column:
    """The channels of a hue in degrees, a chroma and the least channel; 360 itself lies in no sextant."""
    sextant = h / 60
    x = c * (1 - F.abs(F.pmod(sextant, F.lit(2.0)) - 1))
    zero = F.lit(0.0)
    orders = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]  # red, green, blue

    def pick(k: int) -> Column:
        out = zero
        for i, channels in enumerate(orders):
            out = F.when((sextant >= i) & (sextant < i + 1), channels[k]).otherwise(out)
        return _level((out + low) * top(depth), top(depth), depth)

    return _struct(b=pick(2), g=pick(1), r=pick(0))


def hsv_to_bgr(h: Channel, s: Channel, v: Channel, depth: int = 16) -> Column:
    s, v = _unit(s, v, depth=depth)
    return _from_chroma(_degrees(h, depth), v * s, v - v * s, depth)


def hls_to_bgr(h: Channel, l: Channel, s: Channel, depth: int = 16) -> Column:  # noqa: E741
    light, s = _unit(l, s, depth=depth)
    c = (1 - F.abs(2 * light - 1)) * s
    return _from_chroma(_degrees(h, depth), c, light - c / 2, depth)


#: Linear RGB to XYZ and back, and the white point.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE_X, WHITE_Z = 0.950456, 1.088754
EDGE = 6 / 29


def _lab_scale(depth: int) -> tuple[float, int, int, int]:
    """What L and what a and b are multiplied by, the largest a and b, the largest L."""
    return (2.55, 1, 255, 255) if depth == 8 else (652.8, 256, 65535, 65280)


def bgr_to_lab(b: Channel, g: Channel, r: Channel, depth: int = 16) -> Column:
    """Lab as whole numbers. At 16 bits L is scaled by 652.8, and a and b, shifted by 128, by 256; at 8 bits L is scaled by
    2.55, and a and b are shifted by 128."""
    linear = [
        F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
        for c in _unit(r, g, b, depth=depth)
    ]
    x, y, z = (sum((k * c for k, c in zip(row[1:], linear[1:], strict=True)), row[0] * linear[0]) for row in TO_XYZ)
    fx, fy, fz = (
        F.when(t > EDGE**3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * EDGE * EDGE) + 4 / 29)
        for t in (x / WHITE_X, y, z / WHITE_Z)
    )
    light, shift, most, full = _lab_scale(depth)
    return _struct(
        l=_level((116 * fy - 16) * light, full, depth),
        a=_level((500 * (fx - fy) + 128) * shift, most, depth),
        b=_level((200 * (fy - fz) + 128) * shift, most, depth),
    )


def lab_to_bgr(l: Channel, a: Channel, b: Channel, depth: int = 16) -> Column:  # noqa: E741
    light, shift, _, _ = _lab_scale(depth)
    fy = (_c(l) / light + 16) / 116
    fx, fz = (_c(a) / float(shift) - 128) / 500 + fy, fy - (_c(b) / float(shift) - 128) / 200
    x, y, z = (F.when(f > EDGE, f * f * f).otherwise(3 * EDGE * EDGE * (f - 4 / 29)) for f in (fx, fy, fz))

    def channels(xyz: Column) -> Column:
        linear = []
        for row in FROM_XYZ:
            c = sum((k * xyz[v] for k, v in zip(row[1:], "yz", strict=True)), row[0] * xyz["x"])
            linear.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
        return _struct(r=linear[0], g=linear[1], b=linear[2])

    def curved(rgb: Column) -> Column:
        bent = {n: F.when(rgb[n] <= 0.0031308, 12.92 * rgb[n]).otherwise(1.055 * F.pow(rgb[n], F.lit(1 / 2.4)) - 0.055) for n in "bgr"}
        return _struct(**{n: _level(c * top(depth), top(depth), depth) for n, c in bent.items()})

    return once(once(_struct(x=x * WHITE_X, y=y, z=z * WHITE_Z), channels), curved)


def white_balance(b: Channel, g: Channel, r: Channel, target_rgb: tuple[float, float, float], depth: int = 8) -> Column:
    mean = sum(target_rgb) / 3
    scale = [mean / t if t else 1.0 for t in target_rgb]
    r, g, b = (_whole(_c(c).cast("double") * k, top(depth)) for c, k in zip((r, g, b), scale, strict=True))
    return _struct(b=b, g=g, r=r)


def gamma_correction(v: Channel, gamma: float | Column, depth: int = 8) -> Column:
    m = top(depth)
    return _whole(F.pow(_c(v).cast("double") / m, 1 / (gamma if isinstance(gamma, Column) else F.lit(float(gamma)))) * m, m)


def contrast_correction(v: Channel, k: float, depth: int = 8) -> Column:
    """A curve that fixes both ends and the middle; -k undoes k."""
    m, e = top(depth), F.exp(F.lit(float(k)))
    x = 2 * _c(v).cast("double") / m - 1
    y = x * e / (1 + (e - 1) * F.abs(x))
    return _whole((y + 1) / 2 * m, m)


def lumi_contrast(b: Channel, g: Channel, r: Channel, luminosity: float, contrast: float, depth: int = 8) -> Column:
    gamma = F.exp(F.lit(0.5 * luminosity))
    b, g, r = (gamma_correction(contrast_correction(c, 0.5 * contrast, depth), gamma, depth) for c in (b, g, r))
    return _struct(b=b, g=g, r=r)


def saturation_vibrance(b: Channel, g: Channel, r: Channel, saturation: float, vibrance: float, depth: int = 16) -> Column:
    hls = bgr_to_hls(b, g, r, depth)
    s = contrast_correction(hls["s"], -vibrance, depth)
    s = gamma_correction(s, F.exp(F.lit(0.5 * saturation)), depth)
    return hls_to_bgr(hls["h"], hls["l"], s, depth)
