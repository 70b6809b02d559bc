"""SQL for the queries' results, for DuckDB. Stencils are written as plain sums over mirrored taps."""

from __future__ import annotations

from .fixtures import SQL_EXIF, SQL_FILES, SQL_GRAY, SQL_KEYPOINTS, SQL_MATCHES, SQL_PIXELS, SQL_SHARP, SQL_WIDE

G5, B5 = (1, 5, 8, 5, 1), (1, 4, 6, 4, 1)
FRAME = ("stack_id", "frame_idx")


def mirrored(v: str, n: str) -> str:
    return f"CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= {n} THEN 2 * ({n} - 1) - ({v}) ELSE {v} END"


def taps(ty, tx) -> str:
    rows = [(j - len(ty) // 2, i - len(tx) // 2, a * b) for j, a in enumerate(ty) for i, b in enumerate(tx) if a * b]
    return "(VALUES " + ", ".join(f"({j}, {i}, {w!r})" for j, i, w in rows) + ") t(dy, dx, k)"


def conv(src: str, out: str, cols: dict[str, str], ty, tx=None, keys=FRAME, keep: tuple[str, ...] = (), where: str = "TRUE", scale: str = "1") -> str:
    """A common table: ``cols`` maps results to expressions over the tapped row ``b``."""
    k = ", ".join(f"a.{c}" for c in keys)
    same = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    sums = ", ".join(f"sum(t.k * ({e})) / {scale} {c}" for c, e in cols.items())
    kept = "".join(f", a.{c}" for c in keep)
    return f"""{out} AS MATERIALIZED (
        SELECT {k}, a.y, a.x, a.h, a.w{kept}, {sums.replace("t.k", "a.k_")} FROM (
            SELECT a.*, t.k k_, {mirrored("a.y + t.dy", "a.h")} y_, {mirrored("a.x + t.dx", "a.w")} x_
            FROM {src} a CROSS JOIN {taps(ty, tx or ty)} WHERE {where}) a
        JOIN {src} b ON {same} AND b.y = a.y_ AND b.x = a.x_
        GROUP BY {k}, a.y, a.x, a.h, a.w{kept})"""


def sized(src: str, out: str, keys: str = "stack_id") -> str:
    return f"{out} AS MATERIALIZED (SELECT *, max(y) OVER (PARTITION BY {keys}) + 1 h, max(x) OVER (PARTITION BY {keys}) + 1 w FROM {src})"


def reduced(src: str, out: str, cols, keys=FRAME, t=G5) -> str:
    total = sum(t) ** 2
    c = conv(src, f"{out}_", {c: f"b.{c}" for c in cols}, t, keys=keys, where="a.y % 2 = 0 AND a.x % 2 = 0", scale=f"{total}.0::DOUBLE")
    names = ", ".join((*keys, *cols))
    return c + f", {out} AS MATERIALIZED (SELECT {names}, y // 2 y, x // 2 x, (h + 1) // 2 h, (w + 1) // 2 w FROM {out}_)"


def expanded(coarse: str, fine: str, out: str, cols, keys=FRAME, t=G5) -> str:
    k = ", ".join(f"a.{c}" for c in keys)
    same = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    my, mx = mirrored("a.y + t.dy", "(2 * ((a.h + 1) // 2))"), mirrored("a.x + t.dx", "(2 * ((a.w + 1) // 2))")
    sums = ", ".join(f"coalesce(sum(t.k * b.{c}), 0) / {sum(t) ** 2 / 4!r}::DOUBLE {c}" for c in cols)
    return f"""{out} AS MATERIALIZED (
        SELECT {k}, a.y, a.x, {sums.replace("t.k", "a.k_")} FROM (
            SELECT a.*, t.k k_, {my} y_, {mx} x_ FROM {fine} a CROSS JOIN {taps(t, t)}) a
        LEFT JOIN {coarse} b ON {same} AND a.y_ % 2 = 0 AND a.x_ % 2 = 0 AND b.y = a.y_ // 2 AND b.x = a.x_ // 2
        GROUP BY {k}, a.y, a.x)"""


def plus(a: str, b: str, out: str, cols, sign: str, keys=FRAME, keep: tuple[str, ...] = ("h", "w")) -> str:
    kept = "".join(f", {a}.{c}" for c in keep)
    names = ", ".join((*keys, "y", "x"))
    return f"{out} AS MATERIALIZED (SELECT {names}{kept}, {', '.join(f'{a}.{c} {sign} {b}.{c} {c}' for c in cols)} FROM {a} JOIN {b} USING ({names}))"


BGR = ("b", "g", "r")
LUMA = "((4899 * r + 9617 * g + 1868 * b + 8192) >> 14)"
FGRAY = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
REF = "refs AS (SELECT stack_id, count(DISTINCT frame_idx) // 2 ref_idx FROM px GROUP BY 1)"
HIST = f"hist AS (SELECT stack_id, frame_idx, 'L' channel, {LUMA} AS \"value\", count(*) n FROM px GROUP BY ALL)"
MID = 'mid AS (SELECT stack_id, frame_idx, channel, sum("value" * n) / sum(n) mid FROM hist GROUP BY ALL)'
LINEAR = """corr AS (SELECT m.stack_id, m.frame_idx, m.channel, CASE WHEN m.frame_idx = ref_idx THEN 1.0::DOUBLE ELSE r.mid / m.mid END param
    FROM mid m JOIN refs USING (stack_id) JOIN mid r ON r.stack_id = m.stack_id AND r.channel = m.channel AND r.frame_idx = ref_idx)"""
MEAN = "mean AS (SELECT stack_id, y, x, CAST(floor(avg(b)) AS BIGINT) b, CAST(floor(avg(g)) AS BIGINT) g, CAST(floor(avg(r)) AS BIGINT) r FROM px GROUP BY ALL)"
DIFF = ", ".join(
    (
        MEAN,
        sized("mean", "meanz"),
        conv("meanz", "blurred", {f"s{c}": f"b.{c}" for c in BGR}, B5, keys=("stack_id",), keep=BGR),
        "diff_ AS (SELECT stack_id, y, x, " + ", ".join(f"abs({c} - CAST(floor((s{c} + 128) / 256) AS BIGINT)) d_{c}" for c in BGR) + " FROM blurred)",
        "diff AS (SELECT *, sqrt((d_b * d_b + d_g * d_g + d_r * d_r)::DOUBLE) d FROM diff_)",
    )
)
CURVE = """each AS (SELECT stack_id, 'b' channel, d_b threshold FROM diff UNION ALL SELECT stack_id, 'g', d_g FROM diff UNION ALL SELECT stack_id, 'r', d_r FROM diff),
    curve AS (SELECT a.stack_id, a.channel, a.threshold, count(*)::BIGINT n FROM (SELECT DISTINCT * FROM each) a
              JOIN each e ON e.stack_id = a.stack_id AND e.channel = a.channel AND e.threshold >= a.threshold GROUP BY ALL)"""
HOT = "hot AS (SELECT stack_id, y, x FROM diff WHERE d_b > 40 OR d_g > 40 OR d_r > 40)"
SIZED = sized("px", "pz")
HSV = """c AS (SELECT *, b / 65535.0::DOUBLE fb, g / 65535.0::DOUBLE fg, r / 65535.0::DOUBLE fr FROM px),
 d AS (SELECT *, greatest(fb, fg, fr) hi, least(fb, fg, fr) lo FROM c),
 e AS (SELECT *, CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN hi = fb THEN 60 * (fr - fg) / (hi - lo) + 240
        WHEN hi = fg THEN 60 * (fb - fr) / (hi - lo) + 120
        WHEN 60 * (fg - fb) / (hi - lo) < 0 THEN 60 * (fg - fb) / (hi - lo) + 360 ELSE 60 * (fg - fb) / (hi - lo) END hue FROM d)"""
_PX4 = "stack_id, frame_idx, y, x"


def _cut(v: str, most: int = 65535) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, least({v}, {most}.0::DOUBLE))) AS BIGINT)"


def _near(v: str, most: int = 255) -> str:
    return f"CAST(floor(greatest(0.0::DOUBLE, least({v} + 0.5, {most}.0::DOUBLE))) AS BIGINT)"


def _level(v: str, depth: int, most: int | None = None) -> str:
    return _near(v, most or 255) if depth == 8 else _cut(v, most or 65535)


def _sextants(h: str, c: str, low: str, depth: int = 16) -> str:
    """Channels from hue (degrees), chroma and least channel, as columns b, g, r."""
    s = f"({h} / 60)"
    x = f"({c} * (1 - abs(({s} - 2 * floor({s} / 2)) - 1)))"
    parts = {"r": (c, x, "0", "0", x, c), "g": (x, c, c, x, "0", "0"), "b": ("0", "0", x, c, c, x)}
    out = []
    for name in "bgr":
        cases = " ".join(f"WHEN {s} >= {i} AND {s} < {i + 1} THEN {v}" for i, v in enumerate(parts[name]))
        out.append(_level(f"((CASE {cases} ELSE 0 END) + {low}) * {(1 << depth) - 1}", depth) + f" {name}")
    return ", ".join(out)


def _lab(depth: int = 16) -> str:
    lin = ", ".join(f"CASE WHEN f{c} <= 0.04045 THEN f{c} / 12.92::DOUBLE ELSE pow((f{c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END l{c}" for c in "rgb")
    rows = {"x": (0.412453, 0.357580, 0.180423, 0.950456), "yy": (0.212671, 0.715160, 0.072169, 1.0), "z": (0.019334, 0.119193, 0.950227, 1.088754)}
    xyz = ", ".join(f"({a!r}::DOUBLE * lr + {b!r}::DOUBLE * lg + {c!r}::DOUBLE * lb) / {w!r}::DOUBLE t{n}" for n, (a, b, c, w) in rows.items())
    e = 6 / 29
    f = ", ".join(f"CASE WHEN t{n} > {e**3!r}::DOUBLE THEN pow(t{n}, {1 / 3!r}::DOUBLE) ELSE t{n} / {3 * e * e!r}::DOUBLE + {4 / 29!r}::DOUBLE END f{n}" for n in rows)
    m = f"{(1 << depth) - 1}.0::DOUBLE"
    k, shift, full = (2.55, 1, 255) if depth == 8 else (652.8, 256, 65280)
    values = (_level(f"(116 * fyy - 16) * {k}::DOUBLE", depth, full), *(_level(f"({n} + 128) * {shift}", depth) for n in ("500 * (fx - fyy)", "200 * (fyy - fz)")))
    return f"""c AS (SELECT *, b / {m} fb, g / {m} fg, r / {m} fr FROM px),
        l AS (SELECT *, {lin} FROM c), t AS (SELECT *, {xyz} FROM l), f AS (SELECT {_PX4}, {f} FROM t),
        lab AS (SELECT {_PX4}, {values[0]} l, {values[1]} a, {values[2]} b FROM f)"""


def _from_lab(depth: int = 16) -> str:
    e = 6 / 29
    cube = lambda v: f"CASE WHEN {v} > {e!r}::DOUBLE THEN {v} * {v} * {v} ELSE {3 * e * e!r}::DOUBLE * ({v} - {4 / 29!r}::DOUBLE) END"
    rows = {"r": (3.240479, -1.537150, -0.498535), "g": (-0.969256, 1.875992, 0.041556), "b": (0.055648, -0.204043, 1.057311)}
    lin = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {a!r}::DOUBLE * vx + {b!r}::DOUBLE * vy + {c!r}::DOUBLE * vz)) l{n}" for n, (a, b, c) in rows.items())
    out = ", ".join(_level(f"(CASE WHEN l{n} <= 0.0031308 THEN 12.92::DOUBLE * l{n} ELSE 1.055::DOUBLE * pow(l{n}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * {(1 << depth) - 1}", depth) + f" {n}" for n in "bgr")
    k, shift = (2.55, 1) if depth == 8 else (652.8, 256)
    return f"""g1 AS (SELECT {_PX4}, (l / {k}::DOUBLE + 16) / 116 fy, a, b FROM lab),
        g2 AS (SELECT *, (a / {shift}.0::DOUBLE - 128) / 500 + fy fx, fy - (b / {shift}.0::DOUBLE - 128) / 200 fz FROM g1),
        g3 AS (SELECT {_PX4}, ({cube("fx")}) * 0.950456::DOUBLE vx, {cube("fy")} vy, ({cube("fz")}) * 1.088754::DOUBLE vz FROM g2),
        g4 AS (SELECT {_PX4}, {lin} FROM g3) SELECT {_PX4}, {out} FROM g4"""


#: At 8 bits: tables from px to ``sp`` and statements from ``bal`` to colours, by mode; and the channels that are balanced.
_HUE8 = HSV.replace("65535.0", "255.0")
_H8 = "floor(hue / 2 + 0.5)::BIGINT % 180 h"
_S8 = _near("(hi - lo) / (CASE WHEN (hi + lo) / 2 < 0.5 THEN hi + lo ELSE 2 - hi - lo END) * 255")
SPACES8 = {
    "HSV": (
        f"{_HUE8}, sp AS (SELECT {_PX4}, {_H8}, CASE WHEN hi = 0 THEN 0 ELSE {_near('(hi - lo) / hi * 255')} END s, {_near('hi * 255')} v FROM e)",
        f"i AS (SELECT {_PX4}, h * 2.0::DOUBLE hh, s / 255.0::DOUBLE ss, v / 255.0::DOUBLE vv FROM bal) SELECT {_PX4}, {_sextants('hh', '(vv * ss)', '(vv - vv * ss)', 8)} FROM i",
        "hsv", "sv",
    ),
    "HLS": (
        f"{_HUE8}, sp AS (SELECT {_PX4}, {_H8}, {_near('(hi + lo) / 2 * 255')} l, CASE WHEN hi = lo THEN 0 ELSE {_S8} END s FROM e)",
        f"i AS (SELECT {_PX4}, h * 2.0::DOUBLE hh, (1 - abs(2 * (l / 255.0::DOUBLE) - 1)) * (s / 255.0::DOUBLE) cc, l / 255.0::DOUBLE ll FROM bal) SELECT {_PX4}, {_sextants('hh', 'cc', '(ll - cc / 2)', 8)} FROM i",
        "hls", "ls",
    ),
    "LAB": (_lab(8).replace("lab AS", "sp AS"), _from_lab(8).replace("FROM lab", "FROM bal"), "lab", "l"),
}


def balanced8(mode: str, map_: str, bisect: str, match: str) -> str:
    """Frames of 8 bits balanced in a colour space: each (stack, channel) is a stack of its own until pixels meet its table."""
    to, back, order, own = SPACES8[mode]
    n = len(own)
    hist = " UNION ALL ".join(f"SELECT stack_id * 4 + {i} stack_id, frame_idx, 'L' channel, {c} AS \"value\", count(*) n FROM sp GROUP BY ALL" for i, c in enumerate(own))
    values = "(SELECT * FROM (SELECT DISTINCT stack_id, frame_idx FROM hist), (SELECT range AS \"value\" FROM range(0, 256)))"
    if map_ == "LINEAR":
        lut = f"{MID}, {LINEAR}, lut AS (SELECT stack_id, frame_idx, \"value\", {_cut('\"value\" * param', 255)} AS out FROM {values} JOIN corr USING (stack_id, frame_idx))"
    elif map_ == "GAMMA":
        lut = f"{MID}, {bisect}, lut AS (SELECT stack_id, frame_idx, \"value\", {_cut('pow(\"value\"::DOUBLE / 255, 1 / ((lo + hi) / 2)) * 255', 255)} AS out FROM {values} JOIN it USING (stack_id, frame_idx) WHERE i = 42)"
    else:
        match = match.replace("FROM px) f", "FROM hist) f")
        at = match.rindex("SELECT stack_id, frame_idx, 'L'")
        lut = match[:at] + ", lut AS MATERIALIZED (" + match[at:] + ")"
    joins = " ".join(f'JOIN lut k{c} ON k{c}.stack_id = sp.stack_id * 4 + {i} AND k{c}.frame_idx = sp.frame_idx AND k{c}."value" = sp.{c}' for i, c in enumerate(own))
    cols = ", ".join(f"k{c}.out {c}" if c in own else f"sp.{c}" for c in order)
    refs = f"{REF.replace('refs AS', 'refs0 AS')}, refs AS (SELECT stack_id * 4 + range stack_id, ref_idx FROM refs0, range({n}))"
    at = back.rindex(f"SELECT {_PX4}")
    done = back[:at] + (", " if at and not back[:at].rstrip().endswith(",") else "") + "done AS (" + back[at:] + ")"
    out = ", ".join(f"CASE WHEN px.frame_idx = ref_idx THEN px.{c} ELSE done.{c} END {c}" for c in BGR)
    return (f"WITH RECURSIVE {SQL_PIXELS}, {to}, {refs}, hist AS ({hist}), {lut}, bal AS (SELECT sp.stack_id, sp.frame_idx, sp.y, sp.x, {cols} FROM sp {joins}), "
            f"{done} SELECT px.stack_id, px.frame_idx, px.y, px.x, {out} FROM px JOIN done USING ({_PX4}) JOIN refs0 ON refs0.stack_id = px.stack_id")  # fmt: skip


def _contrast(v: str, k: float, most: int) -> str:
    import math

    e = math.exp(k)
    x = f"(2 * {v}::DOUBLE / {most} - 1)"
    return _cut(f"({x} * {e!r}::DOUBLE / (1 + {e - 1!r}::DOUBLE * abs({x})) + 1) / 2 * {most}", most)


def _gamma(v: str, g: float, most: int) -> str:
    return _cut(f"pow({v}::DOUBLE / {most}, {1 / g!r}::DOUBLE) * {most}", most)


def _pyramid(keys=("stack_id",)) -> str:
    """Common tables up to ``fused`` for one level of reduction, from ``pz``."""
    frame = (*keys, "frame_idx")
    k = ", ".join(keys)
    best = lambda s, t, out: f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, y, x ORDER BY {s} DESC, frame_idx) rk FROM {t}) WHERE rk = 1)"
    tables = [
        f"f0 AS (SELECT {', '.join(frame)}, y, x, h, w, b::DOUBLE b, g::DOUBLE g, r::DOUBLE r FROM pz)",
        reduced("f0", "f1", BGR, frame),
        expanded("f1", "f0", "u0", BGR, frame),
        plus("f0", "u0", "l0", BGR, "-", frame),
        f"l0g AS (SELECT *, {FGRAY} v FROM l0)",
        conv("l0g", "e0", {"e": "b.v * b.v"}, G5, keys=frame, keep=BGR),
        best("round(e / 400, 6)", "e0", "w0"),
        f"b1 AS (SELECT *, CAST(floor({FGRAY}) AS BIGINT) v FROM f1)",
        f"b1n AS (SELECT {', '.join(frame)}, v, count(*) n FROM b1 GROUP BY ALL)",
        f"b1a AS (SELECT {', '.join(frame)}, count(*) alln FROM b1 GROUP BY ALL)",
        f"b1t AS (SELECT b1.*, -v * ln(n::DOUBLE / alln) t FROM b1 JOIN b1n USING ({', '.join(frame)}, v) JOIN b1a USING ({', '.join(frame)}))",
        conv("b1t", "b1s", {"t": "b.t", "s": "b.v", "s2": "b.v * b.v"}, (1,) * 5, keys=frame, keep=BGR),
        best("round(t, 6)", "b1s", "we"),
        best("round(s2 / 25 - (s / 25) * (s / 25), 6)", "b1s", "wd"),
        f"base AS (SELECT {k}, y, x, we.h, we.w, {', '.join(f'(we.{c} + wd.{c}) / 2 {c}' for c in BGR)} FROM we JOIN wd USING ({k}, y, x))",
        f"d0 AS (SELECT {k}, y, x, h, w, b, g, r FROM w0)",
        expanded("base", "d0", "ub", BGR, keys),
        plus("d0", "ub", "img", BGR, "+", keys),
    ]
    out = ", ".join(f"CAST(floor(round(least(abs({c}), 255.0::DOUBLE), 6)) AS BIGINT) {c}" for c in BGR)
    return ", ".join(tables) + f", fused AS (SELECT {k}, y, x, {out} FROM img)"


def pyramid_deep(levels: int) -> str:
    """Common tables up to ``fused`` for several levels of reduction, from ``pz``."""
    names = ", ".join(FRAME)
    best = lambda s, t, out: f"{out} AS MATERIALIZED (SELECT stack_id, y, x, h, w, b, g, r FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, y, x ORDER BY {s} DESC, frame_idx) rk FROM {t}) WHERE rk = 1)"
    tables = [f"f0 AS (SELECT {names}, y, x, h, w, b::DOUBLE b, g::DOUBLE g, r::DOUBLE r FROM pz)"]
    for k in range(levels):
        tables += [
            reduced(f"f{k}", f"f{k + 1}", BGR),
            expanded(f"f{k + 1}", f"f{k}", f"u{k}", BGR),
            plus(f"f{k}", f"u{k}", f"l{k}", BGR, "-"),
            f"l{k}g AS (SELECT *, {FGRAY} v FROM l{k})",
            conv(f"l{k}g", f"e{k}", {"e": "b.v * b.v"}, G5, keep=BGR),
            best("round(e / 400, 6)", f"e{k}", f"w{k}"),
        ]
    n = levels
    tables += [
        f"t0 AS (SELECT *, CAST(floor({FGRAY}) AS BIGINT) v FROM f{n})",
        f"tn AS (SELECT {names}, v, count(*) n FROM t0 GROUP BY ALL)",
        f"ta AS (SELECT {names}, count(*) alln FROM t0 GROUP BY ALL)",
        f"t1 AS (SELECT t0.*, -v * ln(n::DOUBLE / alln) t FROM t0 JOIN tn USING ({names}, v) JOIN ta USING ({names}))",
        conv("t1", "t2", {"t": "b.t", "s": "b.v", "s2": "b.v * b.v"}, (1,) * 5, keep=BGR),
        best("round(t, 6)", "t2", "we"),
        best("round(s2 / 25 - (s / 25) * (s / 25), 6)", "t2", "wd"),
        f"i{n} AS MATERIALIZED (SELECT stack_id, y, x, we.h, we.w, {', '.join(f'(we.{c} + wd.{c}) / 2 {c}' for c in BGR)} FROM we JOIN wd USING (stack_id, y, x))",
    ]
    for k in range(n - 1, -1, -1):
        tables += [expanded(f"i{k + 1}", f"w{k}", f"v{k}", BGR, ("stack_id",)), plus(f"w{k}", f"v{k}", f"i{k}", BGR, "+", ("stack_id",))]
    out = ", ".join(f"CAST(floor(round(least(abs({c}), 255.0::DOUBLE), 6)) AS BIGINT) {c}" for c in BGR)
    return ", ".join(tables) + f", fused AS (SELECT stack_id, y, x, {out} FROM i0)"


def blend_deep(levels: int) -> str:
    """Common tables up to ``blended`` for several levels, from ``pz`` and the weights ``wb``."""
    mean = ", ".join(f"CASE WHEN sum(wt) > 1e-8 THEN sum({c} * wt) / sum(wt) ELSE 0 END {c}" for c in BGR)
    tables = [f"g0 AS MATERIALIZED (SELECT {_PX4}, h, w, b::DOUBLE b, g::DOUBLE g, r::DOUBLE r, wt FROM pz JOIN wb USING ({_PX4}))"]
    for k in range(levels):
        tables += [
            reduced(f"g{k}", f"g{k + 1}", ("b", "g", "r", "wt"), t=B5),
            expanded(f"g{k + 1}", f"g{k}", f"u{k}", BGR, t=B5),
            plus(f"g{k}", f"u{k}", f"l{k}", BGR, "-", keep=("h", "w", "wt")),
            f"s{k} AS MATERIALIZED (SELECT stack_id, y, x, h, w, {mean} FROM l{k} GROUP BY stack_id, y, x, h, w)",
        ]
    tables.append(f"i{levels} AS MATERIALIZED (SELECT stack_id, y, x, h, w, {mean} FROM g{levels} GROUP BY stack_id, y, x, h, w)")
    for k in range(levels - 1, -1, -1):
        tables += [expanded(f"i{k + 1}", f"s{k}", f"v{k}", BGR, ("stack_id",), B5), plus(f"s{k}", f"v{k}", f"i{k}", BGR, "+", ("stack_id",))]
    out = ", ".join(f"floor(round(greatest(0, least({c}, 255)), 6))::BIGINT {c}" for c in BGR)
    return ", ".join(tables) + f", blended AS (SELECT stack_id, y, x, {out} FROM i0)"


def _energy(kind: str) -> str:
    v = {"v": "b.v"}
    if kind == "variance":
        return conv("pz", "en_", {"s": "b.v::DOUBLE", "s2": "(b.v * b.v)::DOUBLE"}, (1,) * 5) + ", en AS MATERIALIZED (SELECT *, s2 / 25 - (s / 25) * (s / 25) e FROM en_)"
    if kind == "laplacian":
        s = conv("pz", "sm", v, B5, scale="256.0::DOUBLE")
        one = conv("sm", "la", {"l1": "b.v"}, (1, 0, -2, 0, 1), (1, 4, 6, 4, 1))
        two = conv("sm", "lb", {"l2": "b.v"}, (1, 4, 6, 4, 1), (1, 0, -2, 0, 1))
        return f"{s}, {one}, {two}, en AS MATERIALIZED (SELECT {_PX4}, la.h, la.w, abs(l1 + l2) e FROM la JOIN lb USING ({_PX4}))"
    gx, gy = conv("pz", "sx", {"gx": "b.v"}, (1, 2, 1), (-1, 0, 1)), conv("pz", "sy", {"gy": "b.v"}, (-1, 0, 1), (1, 2, 1))
    e = "abs(gx) + abs(gy)" if kind == "sobel" else "CASE WHEN gx * gx + gy * gy > 5 THEN gx * gx + gy * gy ELSE 0 END"
    return f"{gx}, {gy}, en AS MATERIALIZED (SELECT {_PX4}, sx.h, sx.w, ({e})::DOUBLE e FROM sx JOIN sy USING ({_PX4}))"


def _bilateral(radius: int = 1) -> str:
    import math

    r = range(-radius, radius + 1)
    near = ", ".join(f"({j}, {i}, {math.exp(-(j * j + i * i) / 8)!r}::DOUBLE)" for j in r for i in r if 0 < j * j + i * i <= radius * radius)
    wt = f"a.sp * exp(-((b.e - a.e) * (b.e - a.e)) / {2 * 0.8**2!r}::DOUBLE)"
    return f"""sm2 AS MATERIALIZED (SELECT a.stack_id, a.frame_idx, a.y, a.x, a.h, a.w, (a.e + sum({wt} * b.e)) / (1 + sum({wt})) e
        FROM (SELECT a.*, t.sp, {mirrored("a.y + t.dy", "a.h")} y_, {mirrored("a.x + t.dx", "a.w")} x_ FROM en a CROSS JOIN (VALUES {near}) t(dy, dx, sp)) a
        JOIN en b ON a.stack_id = b.stack_id AND a.frame_idx = b.frame_idx AND b.y = a.y_ AND b.x = a.x_
        GROUP BY a.stack_id, a.frame_idx, a.y, a.x, a.h, a.w, a.e)"""


GRAYZ = f"{SQL_GRAY}, {SIZED}"
FRAMES = """frames AS (SELECT *, CAST(row_number() OVER (PARTITION BY stack_id ORDER BY dir, path) - 1 AS BIGINT) frame_idx FROM (
    SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) ext, regexp_extract(path, '^(.*?)/?[^/]*$', 1) dir FROM files)
    WHERE ext IN ('tif', 'jpg', 'png', 'cr2'))"""
FR = f"{SQL_FILES}, {FRAMES}"
FREF = "refs AS (SELECT stack_id, CAST(count(*) // 2 AS BIGINT) ref_idx FROM frames GROUP BY 1)"
XMP = f"""{SQL_EXIF}, xmp AS (SELECT file_key, 'exif:FNumber="' || fnum || '/10" exif:ISOSpeedRatings="' || iso || '" <exif:ExposureTime>1/' || den ||
    '</exif:ExposureTime> exif:DateTimeOriginal="' || "day" || 'T10:20:30"' xmp FROM texts)"""
#: The fields of XMP above, as they are read.
PARSED = """parsed AS (
    SELECT file_key, 'FNumber' field, fnum || '/10' AS "value", fnum num, 10::BIGINT den FROM texts UNION ALL
    SELECT file_key, 'ISOSpeedRatings', iso::VARCHAR, NULL, NULL FROM texts UNION ALL
    SELECT file_key, 'ExposureTime', '1/' || den, 1, den FROM texts UNION ALL
    SELECT file_key, 'DateTimeOriginal', replace("day", '-', ':') || ' 10:20:30', NULL, NULL FROM texts)"""
