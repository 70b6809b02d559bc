"""A query for every operator, over tables derived from the given ones, and SQL to hold its result against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import oracles as o
from .functions import color, geometry
from .operators import align, balance, depthmap, filters, layers, metadata, noise, pyramid, tiles, vignette
from .operators.stencil import BINOMIAL, GENERATING, gaussian_taps, reduce, expand, stencil, with_size
from .plans import stack
from .plans.bunches import bunches
from .sources import frames as src
from .sources.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PX = ("stack_id", "frame_idx", "y", "x")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _frames(s, d) -> DataFrame:
    return src.scan_catalog(fx.frame_files(s, d))


def _refs(px: DataFrame) -> DataFrame:
    return src.resolve_reference(px.select("stack_id", "frame_idx").distinct())


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- sources, validation, projections -------------------------------------------------------------------------


@query(f"WITH {o.FR} SELECT stack_id, frame_idx, path, ext FROM frames")
def S1_scan_catalog(s, d):
    return _frames(s, d).select("stack_id", "frame_idx", "path", "ext")


@query(f"""WITH {o.SQL_FILES}, f AS (SELECT stack_id, '/data/in/' || path path FROM files)
    SELECT stack_id, path, row_number() OVER (PARTITION BY stack_id ORDER BY path) - 1 frame_idx FROM f""")
def S2_scan_filelist(s, d):
    return src.scan_filelist(fx.frame_files(s, d).select("stack_id", "path"), "/data/in").select("stack_id", "path", "frame_idx")


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, count(*) n, sum(b + g + r)::BIGINT total FROM px GROUP BY ALL")
def S4_read_pixels(s, d):
    path = f"{scratch_dir(s)}/{uuid.uuid4().hex}"
    src.write_frames(fx.pixels(s, d), path)
    return src.read_pixels(s, path).groupBy("stack_id", "frame_idx").agg(F.count("*").alias("n"), F.sum(F.col("b") + F.col("g") + F.col("r")).alias("total"))


@query(f"WITH {fx.SQL_LARGE} SELECT stack_id, frame_idx, y, x, b, g, r FROM px")
def S4_read_tiles(s, d):
    path = f"{scratch_dir(s)}/{uuid.uuid4().hex}"
    src.write_tiles(fx.large_pixels(s, d), path)
    px = tiles.unpack_tiles(src.read_tiles(s, path))
    return px.select(*PX, *(F.col(c).cast("long") for c in "bgr"))


@query(f"""WITH {o.FR} SELECT stack_id, path, 'stack_' || regexp_extract(path, '([^/]*?)\\.[^./]+$', 1) || '_pyram.' ||
    CASE WHEN ext = 'cr2' THEN 'tif' ELSE regexp_extract(path, '\\.([^./]+)$', 1) END out_name FROM frames""")
def S5_output_names(s, d):
    return src.output_names(_frames(s, d), "stack_", "pyramid").select("stack_id", "path", "out_name")


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, y, x, b, g, r FROM px")
def S6_write_frames(s, d):
    """Written by stack and read again."""
    path = f"{scratch_dir(s)}/frames-{uuid.uuid4().hex}"
    src.write_frames(fx.pixels(s, d), path)
    return src.read_pixels(s, path).withColumn("stack_id", F.col("stack_id").cast("long")).select(*PX, "b", "g", "r")


@query(f"""WITH {o.FR} SELECT stack_id, regexp_extract(path, '([^/]*?)\\.[^./]+$', 1) AS "label",
    count(*) OVER (PARTITION BY stack_id) - 1 - frame_idx layer_idx FROM frames""")
def S7_to_layers(s, d):
    return layers.to_layers(_frames(s, d)).select("stack_id", "label", "layer_idx")


@query(f"""WITH {o.SQL_PIXELS} SELECT stack_id, y, x, b, g, r FROM px WHERE frame_idx = 3""")
def S8_flatten_layers(s, d):
    return layers.flatten_layers(fx.pixels(s, d).withColumnRenamed("frame_idx", "layer_idx"))


_LAYERS = """ly AS (SELECT o_orderkey % 97 stack_id, row_number() OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) - 1 layer_idx,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Stack ' || o_custkey WHEN o_orderkey % 41 = 0 THEN 'Master' WHEN o_orderkey % 5 = 0 THEN NULL
         ELSE substr('aBcDeFgH', (o_orderkey % 8 + 1)::INT, 1) || o_custkey END AS "label" FROM orders)"""


def _layer_rows(s, d):
    rows = fx.table(s, d, "orders").selectExpr(
        "o_orderkey % 97 stack_id", "row_number() OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) - 1 layer_idx",
        """CASE WHEN o_orderkey % 7 = 0 THEN concat('Stack ', o_custkey) WHEN o_orderkey % 41 = 0 THEN 'Master' WHEN o_orderkey % 5 = 0 THEN NULL
           ELSE concat(substr('aBcDeFgH', CAST(o_orderkey % 8 + 1 AS INT), 1), o_custkey) END label""",
    )
    return rows


@query(f"""WITH {_LAYERS}, b AS (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY layer_idx DESC) back FROM ly),
    n AS (SELECT stack_id, back, coalesce("label", 'Layer ' || back) AS "label" FROM b)
    SELECT stack_id, "label", lower("label") = 'master' is_master,
           row_number() OVER (PARTITION BY stack_id ORDER BY CASE WHEN lower("label") = 'master' THEN 0 ELSE 1 END, back) - 1 layer_idx FROM n""")
def S9_read_layers(s, d):
    return layers.read_layers(_layer_rows(s, d)).select("stack_id", "label", "is_master", "layer_idx")


@query(f"""WITH {_LAYERS}, k AS (SELECT * FROM ly WHERE "label" IS NOT NULL),
    f AS (SELECT *, contains(lower("label"), 'master') OR contains(lower("label"), 'stack') p FROM k),
    q AS (SELECT *, p AND row_number() OVER (PARTITION BY stack_id, p ORDER BY layer_idx) = 1 pin FROM f)
    SELECT stack_id, "label", pin, row_number() OVER (PARTITION BY stack_id ORDER BY CASE WHEN pin THEN 0 ELSE 1 END, lower("label"), layer_idx) - 1 layer_idx FROM q""")
def S10_sort_layers(s, d):
    return layers.sort_layers(_layer_rows(s, d).filter("label IS NOT NULL")).select("stack_id", "label", "pin", "layer_idx")


@query(f"""WITH {o.FR} SELECT stack_id, sum(width::BIGINT * height * channels * (bit_depth // 8))::BIGINT bytes,
    sum(width::BIGINT * height * channels * (bit_depth // 8)) > 5000000000 over_limit FROM frames GROUP BY 1""")
def S12_estimate_bytes(s, d):
    return src.estimate_bytes(_frames(s, d), 5_000_000_000)


@query(f"""WITH {o.FR}, w AS (SELECT *, first_value(width) OVER q w0, first_value(height) OVER q h0, first_value(bit_depth) OVER q d0 FROM frames
    WINDOW q AS (PARTITION BY stack_id ORDER BY frame_idx))
    SELECT stack_id, frame_idx, CASE WHEN width <> w0 OR height <> h0 THEN 'shape' WHEN bit_depth <> d0 THEN 'depth' ELSE 'ok' END status FROM w""")
def V1_validate_stack(s, d):
    return src.validate_stack(_frames(s, d)).select("stack_id", "frame_idx", "status")


@query(f"""WITH {o.SQL_FILES} SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('tif', 'tiff', 'jpg', 'jpeg') tif_or_jpg,
    lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'cr2' raw FROM files""")
def F1_extension_predicates(s, d):
    return fx.frame_files(s, d).select("path", src.has_kind("path", "tif", "jpg").alias("tif_or_jpg"), src.has_kind("path", "raw").alias("raw"))


@query(f"WITH {o.FR} SELECT stack_id, 0 AS ref, count(*) // 2 ref_idx FROM frames GROUP BY 1 UNION ALL SELECT stack_id, -1, count(*) - 1 FROM frames GROUP BY 1 "
       "UNION ALL SELECT stack_id, 3, 2 FROM frames GROUP BY 1")
def F2_resolve_reference(s, d):
    f = _frames(s, d)
    parts = [src.resolve_reference(f, k).withColumn("ref", F.lit(k)) for k in (0, -1, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, y // 3 y, x // 3 x, b, g, r FROM px WHERE y % 3 = 0 AND x % 3 = 0")
def F3_fast_subsample(s, d):
    return balance.subsample(fx.pixels(s, d), 3).select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, y // 4 y, x // 4 x, round(avg(b), 6) b, round(avg(g), 6) g, round(avg(r), 6) r FROM px GROUP BY ALL")
def F4_area_subsample(s, d):
    return _rounded(balance.subsample(fx.pixels(s, d), 4, fast=False), "b", "g", "r")


@query("""WITH s AS (SELECT p_partkey, (p_partkey * 37) % 9000 + 100 h, (p_partkey * 53) % 12000 + 100 w FROM part)
    SELECT p_partkey, (1 + floor(h::DOUBLE * w / 1048576 / 2))::BIGINT balance, (1 + floor((h / 1000.0::DOUBLE) * (w / 1000.0::DOUBLE) / 2))::BIGINT vignetting,
           floor(sqrt(1 + floor((h / 1024.0::DOUBLE) * (w / 1024.0::DOUBLE) / 2)))::BIGINT align FROM s""")
def F5_auto_factor(s, d):
    sizes = fx.table(s, d, "part").selectExpr("p_partkey", "(p_partkey * 37) % 9000 + 100 height", "(p_partkey * 53) % 12000 + 100 width")
    return sizes.select("p_partkey", *(src.auto_factor(r).alias(r) for r in ("balance", "vignetting", "align")))


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED} SELECT stack_id, frame_idx, y, x, b, g, r FROM pz WHERE pow(x - w / 2.0, 2) + pow(y - h / 2.0, 2) <= pow(least(w, h) * 0.9 / 2, 2)")
def F6_circular_mask(s, d):
    return balance.circular_mask(with_size(fx.pixels(s, d)), 0.9).select(*PX, "b", "g", "r")


@query(f'WITH {o.SQL_PIXELS}, {o.HIST} SELECT stack_id, frame_idx, channel, round(sum("value" * n) / sum(n), 6) mid FROM hist WHERE "value" BETWEEN 30 AND 220 GROUP BY ALL')
def F7_intensity_interval(s, d):
    return _rounded(balance.mid_value(balance.histogram(fx.pixels(s, d)), 30, 220), "mid")


@query(f"WITH {o.SQL_WIDE} SELECT stack_id, frame_idx, y, x, b >> 8 b, g >> 8 g, r >> 8 r FROM px")
def F9_bit8(s, d):
    return fx.pixels(s, d, wide=True).select(*PX, *(color.bit8(c).alias(c) for c in "bgr"))


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, y, x, {o.LUMA} v FROM px")
def F10_gray(s, d):
    return fx.pixels(s, d).select(*PX, color.gray("b", "g", "r").alias("v"))


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED} SELECT 'cw' turn, stack_id, frame_idx, x y, h - 1 - y x, b FROM pz UNION ALL "
       "SELECT 'ccw', stack_id, frame_idx, w - 1 - x, y, b FROM pz UNION ALL SELECT 'half', stack_id, frame_idx, h - 1 - y, w - 1 - x, b FROM pz")
def F11_rotate(s, d):
    px = with_size(fx.pixels(s, d))
    a, b, c = (layers.rotate(px, t).select(F.lit(t).alias("turn"), *PX, "b") for t in ("cw", "ccw", "half"))
    return a.unionByName(b).unionByName(c)


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, y, x, b, g, r FROM px")
def F12_split_merge(s, d):
    return layers.pivot_channels(layers.unpivot_channels(fx.pixels(s, d)))


# ---- colour ---------------------------------------------------------------------------------------------------


def _space(s, d, f) -> DataFrame:
    return fx.pixels(s, d, wide=True).select(*PX, f.alias("c")).select(*PX, "c.*")


_HSV_SQL = f"hsv AS (SELECT {o._PX4}, {o._cut('hue / 360 * 65535')} h, CASE WHEN hi = 0 THEN 0 ELSE {o._cut('(hi - lo) / hi * 65535')} END s, {o._cut('hi * 65535')} v FROM e)"
_HLS_SQL = f"""hls AS (SELECT {o._PX4}, {o._cut('hue / 360 * 65535')} h, {o._cut('(hi + lo) / 2 * 65535')} l,
    CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 < 0.5 THEN {o._cut('(hi - lo) / (hi + lo) * 65535')} ELSE {o._cut('(hi - lo) / (2 - hi - lo) * 65535')} END s FROM e)"""
_U = "65535.0::DOUBLE"


@query(f"WITH {o.SQL_WIDE}, {o.HSV}, {_HSV_SQL} SELECT * FROM hsv")
def C1_bgr_to_hsv(s, d):
    return _space(s, d, color.bgr_to_hsv("b", "g", "r"))


@query(f"WITH {o.SQL_WIDE}, {o.HSV}, {_HSV_SQL}, i AS (SELECT {o._PX4}, h / {_U} * 360 hh, s / {_U} ss, v / {_U} vv FROM hsv) "
       f"SELECT {o._PX4}, {o._sextants('hh', '(vv * ss)', '(vv - vv * ss)')} FROM i")
def C2_hsv_to_bgr(s, d):
    return C1_bgr_to_hsv(s, d).select(*PX, color.hsv_to_bgr("h", "s", "v").alias("c")).select(*PX, "c.*")


@query(f"WITH {o.SQL_WIDE}, {o.HSV}, {_HLS_SQL} SELECT * FROM hls")
def C3_bgr_to_hls(s, d):
    return _space(s, d, color.bgr_to_hls("b", "g", "r"))


_HLS_BACK = f"i AS (SELECT {o._PX4}, h / {_U} * 360 hh, (1 - abs(2 * (l / {_U}) - 1)) * (s / {_U}) cc, l / {_U} ll FROM hls)"


@query(f"WITH {o.SQL_WIDE}, {o.HSV}, {_HLS_SQL}, {_HLS_BACK} SELECT {o._PX4}, {o._sextants('hh', 'cc', '(ll - cc / 2)')} FROM i")
def C4_hls_to_bgr(s, d):
    return C3_bgr_to_hls(s, d).select(*PX, color.hls_to_bgr("h", "l", "s").alias("c")).select(*PX, "c.*")


@query(f"WITH {o.SQL_WIDE}, {o._lab()} SELECT * FROM lab")
def C5_bgr_to_lab(s, d):
    return _space(s, d, color.bgr_to_lab("b", "g", "r"))


@query(f"WITH {o.SQL_WIDE}, {o._lab()}, {o._from_lab()}")
def C6_lab_to_bgr(s, d):
    return C5_bgr_to_lab(s, d).select(*PX, color.lab_to_bgr("l", "a", "b").alias("c")).select(*PX, "c.*")


def _space8_queries(name: str, mode: str, to, back) -> None:
    """There, and there and back, at 8 bits."""
    there, again, order, _ = o.SPACES8[mode]

    def forth(s, d):
        return fx.pixels(s, d).select(*PX, to("b", "g", "r", 8).alias("c")).select(*PX, "c.*")

    def home(s, d):
        return forth(s, d).select(*PX, back(*order, 8).alias("c")).select(*PX, "c.*")

    low = mode.lower()
    number = int(name)
    for f, title, sql in (
        (forth, f"C{number}_bgr_to_{low}_8bit", f"WITH {o.SQL_PIXELS}, {there} SELECT * FROM sp"),
        (home, f"C{number + 1}_{low}_to_bgr_8bit", f"WITH {o.SQL_PIXELS}, {there}, {again.replace('FROM bal', 'FROM sp')}"),
    ):
        f.__name__ = title
        query(sql)(f)


_space8_queries("1", "HSV", color.bgr_to_hsv, color.hsv_to_bgr)
_space8_queries("3", "HLS", color.bgr_to_hls, color.hls_to_bgr)
_space8_queries("5", "LAB", color.bgr_to_lab, color.lab_to_bgr)


@query(f"WITH {o.SQL_PIXELS} SELECT {o._PX4}, {o._cut('b::DOUBLE * (140.0::DOUBLE / 100)', 255)} b, {o._cut('g::DOUBLE * (140.0::DOUBLE / 120)', 255)} g, {o._cut('r::DOUBLE * (140.0::DOUBLE / 200)', 255)} r FROM px")
def C7_white_balance(s, d):
    return fx.pixels(s, d).select(*PX, color.white_balance("b", "g", "r", (200.0, 120.0, 100.0)).alias("c")).select(*PX, "c.*")


@query(f"WITH {o.SQL_PIXELS} SELECT {o._PX4}, {', '.join(o._gamma(c, 1.7, 255) + ' ' + c for c in 'bgr')} FROM px")
def C8_gamma_correction(s, d):
    return fx.pixels(s, d).select(*PX, *(color.gamma_correction(c, 1.7).alias(c) for c in "bgr"))


@query(f"WITH {o.SQL_PIXELS} SELECT {o._PX4}, {', '.join(o._contrast(c, 0.8, 255) + ' ' + c for c in 'bgr')} FROM px")
def C9_contrast_correction(s, d):
    return fx.pixels(s, d).select(*PX, *(color.contrast_correction(c, 0.8).alias(c) for c in "bgr"))


@query(f"WITH {o.SQL_PIXELS}, k AS (SELECT {o._PX4}, {', '.join(o._contrast(c, 0.3, 255) + ' ' + c for c in 'bgr')} FROM px) "
       f"SELECT {o._PX4}, {', '.join(o._gamma(c, __import__('math').exp(0.2), 255) + ' ' + c for c in 'bgr')} FROM k")
def C10_lumi_contrast(s, d):
    return fx.pixels(s, d).select(*PX, color.lumi_contrast("b", "g", "r", 0.4, 0.6).alias("c")).select(*PX, "c.*")


@query(f"WITH {o.SQL_WIDE}, {o.HSV}, {_HLS_SQL.replace('hls AS', 'hls0 AS')}, hls1 AS (SELECT {o._PX4}, h, l, {o._contrast('s', -0.3, 65535)} s FROM hls0), "
       f"hls AS (SELECT {o._PX4}, h, l, {o._gamma('s', __import__('math').exp(0.25), 65535)} s FROM hls1), {_HLS_BACK} SELECT {o._PX4}, {o._sextants('hh', 'cc', '(ll - cc / 2)')} FROM i")
def C11_saturation_vibrance(s, d):
    return _space(s, d, color.saturation_vibrance("b", "g", "r", 0.5, 0.3))


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, floor(avg(b))::BIGINT b, floor(avg(g))::BIGINT g, floor(avg(r))::BIGINT r FROM px WHERE (x - 12) * (x - 12) + (y - 3) * (y - 3) <= 9 GROUP BY ALL")
def C12_pick_colour(s, d):
    return layers.pick_colour(fx.pixels(s, d), 12, 3, 3)


# ---- statistics and balancing ---------------------------------------------------------------------------------


@query(f'WITH {o.SQL_PIXELS}, {o.HIST} SELECT * FROM hist UNION ALL SELECT stack_id, frame_idx, \'B\', b, count(*) FROM px GROUP BY ALL UNION ALL '
       "SELECT stack_id, frame_idx, 'G', g, count(*) FROM px GROUP BY ALL UNION ALL SELECT stack_id, frame_idx, 'R', r, count(*) FROM px GROUP BY ALL")
def A1_histogram(s, d):
    px = fx.pixels(s, d)
    return balance.histogram(px).unionByName(balance.histogram(px, "RGB"))


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.MID} SELECT stack_id, frame_idx, channel, round(mid, 6) mid FROM mid")
def A2_mid_value(s, d):
    return _rounded(balance.mid_value(balance.histogram(fx.pixels(s, d))), "mid")


_APPLY = ", ".join(o._cut(f"{c} * param", 255) + f" {c}" for c in "bgr")


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.MID}, {o.REF}, {o.LINEAR} SELECT {o._PX4}, {_APPLY} FROM px JOIN corr USING (stack_id, frame_idx)")
def A3_linear_balance(s, d):
    px = fx.pixels(s, d)
    return balance.balance_frames(px, _refs(px))[0].select(*PX, "b", "g", "r")


_BISECT = """tgt AS (SELECT m.stack_id, m.channel, mid target FROM mid m JOIN refs ON refs.stack_id = m.stack_id AND m.frame_idx = ref_idx),
    it AS (SELECT stack_id, frame_idx, 0 i, 0.1::DOUBLE lo, 5.0::DOUBLE hi FROM mid UNION ALL
      SELECT it.stack_id, it.frame_idx, i + 1, CASE WHEN q.m < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN q.m < target THEN hi ELSE (lo + hi) / 2 END
      FROM it JOIN tgt USING (stack_id), LATERAL (SELECT sum(floor(pow("value"::DOUBLE / 255, 1 / ((lo + hi) / 2)) * 255) * n) / sum(n) m FROM hist
        WHERE hist.stack_id = it.stack_id AND hist.frame_idx = it.frame_idx) q WHERE i < 42)"""


@query(f"WITH RECURSIVE {o.SQL_PIXELS}, {o.HIST}, {o.MID}, {o.REF}, {_BISECT} SELECT stack_id, frame_idx, 'L' channel, round((lo + hi) / 2, 6) param FROM it WHERE i = 42")
def A4_gamma_balance(s, d):
    px = fx.pixels(s, d)
    return _rounded(balance.gamma_fit(balance.histogram(px), _refs(px)), "param")


_MATCH = """dense AS (SELECT f.stack_id, f.frame_idx, v.range AS "value", coalesce(h.n, 0) n, sum(coalesce(h.n, 0)) OVER (PARTITION BY f.stack_id, f.frame_idx) total
      FROM (SELECT DISTINCT stack_id, frame_idx FROM px) f, range(0, 256) v LEFT JOIN hist h ON h.stack_id = f.stack_id AND h.frame_idx = f.frame_idx AND h."value" = v.range),
    cdf AS (SELECT stack_id, frame_idx, "value", sum(n) OVER (PARTITION BY stack_id, frame_idx ORDER BY "value")::DOUBLE / total * 255 c FROM dense),
    ref AS (SELECT c.stack_id, "value" v0, c c0, lead(c) OVER (PARTITION BY c.stack_id ORDER BY "value") c1, min(c) OVER (PARTITION BY c.stack_id) lc, max(c) OVER (PARTITION BY c.stack_id) hc
      FROM cdf c JOIN refs ON refs.stack_id = c.stack_id AND c.frame_idx = ref_idx),
    bounds AS (SELECT DISTINCT stack_id, lc, hc FROM ref),
    asked AS (SELECT cdf.*, greatest(lc, least(hc, c)) q FROM cdf JOIN bounds USING (stack_id)),
    cand AS (SELECT a.stack_id, a.frame_idx, a."value", q, v0, c0, c1, hc, row_number() OVER (PARTITION BY a.stack_id, a.frame_idx, a."value" ORDER BY v0) rk
      FROM asked a JOIN ref r ON r.stack_id = a.stack_id AND ((q >= c0 AND q < c1) OR (q >= hc AND c0 = hc))),
    raw AS (SELECT stack_id, frame_idx, "value", CASE WHEN q >= hc AND c0 = hc THEN v0::DOUBLE ELSE v0 + (q - c0) / (c1 - c0) END u FROM cand WHERE rk = 1),
    en AS (SELECT *, first_value(u) OVER (PARTITION BY stack_id, frame_idx ORDER BY "value") l0, last_value(u) OVER (PARTITION BY stack_id, frame_idx ORDER BY "value" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) l1 FROM raw),
    st AS (SELECT *, min(CASE WHEN u <> l0 AND u <> l1 THEN u END) OVER f lmin, max(CASE WHEN u <> l0 AND u <> l1 THEN u END) OVER f lmax,
      max(CASE WHEN u = l0 THEN "value" END) OVER f i0, count(CASE WHEN u = l1 THEN 1 END) OVER f n1 FROM en WINDOW f AS (PARTITION BY stack_id, frame_idx))
    SELECT stack_id, frame_idx, 'L' channel, "value", floor(round(CASE WHEN lmin IS NULL THEN u WHEN u = l0 THEN CASE WHEN i0 > 0 THEN "value"::DOUBLE / i0 * lmin ELSE 0 END
      WHEN u = l1 THEN "value" + ("value" - 255) * (255 - lmax) / n1 ELSE u END, 6))::BIGINT out FROM st"""


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.REF}, {_MATCH}")
def A5_match_histogram(s, d):
    px = fx.pixels(s, d)
    return balance.match_histogram(balance.histogram(px), _refs(px))


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.MID}, {o.REF}, {o.LINEAR} SELECT stack_id, frame_idx, channel, round(param, 6) param FROM corr")
def A6_correction_summary(s, d):
    px = fx.pixels(s, d)
    return _rounded(balance.balance_frames(px, _refs(px))[1], "param")


@query(f"WITH {o.SQL_PIXELS.replace('FROM p\n)', 'FROM p WHERE frame_idx < 3)')}, {o.MEAN} SELECT * FROM mean")
def A7_mean_frame(s, d):
    return noise.mean_frame(fx.pixels(s, d), 3)


_LABDIFF = f"""{o.SQL_PIXELS}, {o.MEAN}, {o.sized('mean', 'meanz')}, {o.conv('meanz', 'blurred', {f's{c}': f'b.{c}' for c in 'bgr'}, o.B5, keys=('stack_id',), keep=('b', 'g', 'r'))},
    two AS (SELECT stack_id, 0 frame_idx, y, x, b, g, r FROM blurred UNION ALL SELECT stack_id, 1, y, x, floor((sb + 128) / 256)::BIGINT, floor((sg + 128) / 256)::BIGINT, floor((sr + 128) / 256)::BIGINT FROM blurred),
    {o._lab(8).replace('FROM px)', 'FROM two)')},
    far AS (SELECT p.stack_id, p.y, p.x, sqrt(((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))::DOUBLE) d FROM lab p JOIN lab q USING (stack_id, y, x) WHERE p.frame_idx = 0 AND q.frame_idx = 1)"""


@query(f"WITH {_LABDIFF}, bar AS (SELECT stack_id, round(avg(d) + 2 * stddev_pop(d), 6) bar FROM far GROUP BY 1) SELECT stack_id, y, x FROM far JOIN bar USING (stack_id) WHERE round(d, 6) >= bar")
def A9_hot_pixels_lab(s, d):
    return noise.hot_pixels_norm(noise.differences(noise.mean_frame(fx.pixels(s, d)), lab=True), k=2.0)


def _diff(s, d):
    return noise.differences(noise.mean_frame(fx.pixels(s, d)))


@query(f"""WITH {o.SQL_PIXELS}, {o.DIFF}, {o.CURVE}, lim AS (SELECT stack_id, channel, max(threshold) - 1 t FROM curve WHERE n >= 30 GROUP BY ALL)
    SELECT DISTINCT diff.stack_id, y, x FROM diff JOIN lim USING (stack_id) WHERE (channel = 'b' AND d_b > t) OR (channel = 'g' AND d_g > t) OR (channel = 'r' AND d_r > t)""")
def A8_hot_pixels_rgb(s, d):
    return noise.hot_pixels_rgb(_diff(s, d), n=30)


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, bar AS (SELECT stack_id, round(avg(d) + 2 * stddev_pop(d), 6) bar FROM diff GROUP BY 1) SELECT stack_id, y, x FROM diff JOIN bar USING (stack_id) WHERE round(d, 6) >= bar")
def A9_hot_pixels_norm(s, d):
    return noise.hot_pixels_norm(_diff(s, d), k=2.0)


@query(f"""WITH {o.SQL_PIXELS}, {o.DIFF}, q AS (SELECT *, floor(round((d - min(d) OVER (PARTITION BY stack_id)) / 0.01::DOUBLE, 6)) bin FROM diff),
    e AS (SELECT a.stack_id, a.bin, count(*) n FROM (SELECT DISTINCT stack_id, bin FROM q) a JOIN q ON q.stack_id = a.stack_id AND q.bin >= a.bin GROUP BY ALL),
    t AS (SELECT stack_id, max(bin) edge FROM e WHERE n >= 25 GROUP BY 1) SELECT stack_id, y, x FROM q JOIN t USING (stack_id) WHERE bin >= edge""")
def T3_noisiest_pixels(s, d):
    return noise.hot_pixels_norm(_diff(s, d), n=25)


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.HOT} SELECT stack_id, count(*) n, count(*) > 500 too_many FROM hot GROUP BY 1")
def A10_count_guard(s, d):
    return noise.count_guard(noise.hot_pixels_rgb(_diff(s, d), fixed=40), 500)


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.CURVE} SELECT * FROM curve")
def A11_hot_pixel_curve(s, d):
    return noise.hot_pixel_curve(_diff(s, d))


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.HOT}, bar AS (SELECT stack_id, round(avg(d) + 2 * stddev_pop(d), 6) bar FROM diff GROUP BY 1) "
       "SELECT stack_id, y, x FROM hot UNION SELECT stack_id, y, x FROM diff JOIN bar USING (stack_id) WHERE round(d, 6) >= bar")
def U1_union_of_hot_masks(s, d):
    """Of the pixels that differ in one channel and those that differ by the length of the difference."""
    diff = _diff(s, d)
    return noise.union_of_masks(noise.hot_pixels_rgb(diff, fixed=40), noise.hot_pixels_norm(diff, k=2.0))


_NEAR = "near AS (SELECT hot.stack_id, hot.y hy, hot.x hx, hot.y + dy.j y, hot.x + dx.i x FROM hot, (VALUES (-1), (0), (1)) dy(j), (VALUES (-1), (0), (1)) dx(i))"
_FIX = ("fix AS (SELECT px.stack_id, px.frame_idx, hy y, hx x, " + ", ".join(f"floor(avg(CASE WHEN {c} <> 0 THEN {c} END))::BIGINT n{c}" for c in "bgr") +
        " FROM px JOIN near USING (stack_id, y, x) GROUP BY ALL)")


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.HOT}, {_NEAR}, {_FIX} SELECT {o._PX4}, coalesce(nb, b) b, coalesce(ng, g) g, coalesce(nr, r) r FROM px LEFT JOIN fix USING ({o._PX4})")
def J4_repair_hot_pixels(s, d):
    px = fx.pixels(s, d)
    return noise.repair_hot_pixels(px, noise.hot_pixels_rgb(_diff(s, d), fixed=40)).select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.HOT} SELECT px.* FROM px SEMI JOIN hot USING (stack_id, y, x)")
def J3_select_hot_pixels(s, d):
    return noise.select_hot_pixels(fx.pixels(s, d), noise.hot_pixels_rgb(_diff(s, d), fixed=40)).select(*PX, "b", "g", "r")


_LUTSQL = _MATCH[: _MATCH.rindex("SELECT stack_id, frame_idx, 'L'")] + ", lut AS MATERIALIZED (" + _MATCH[_MATCH.rindex("SELECT stack_id, frame_idx, 'L'"):] + ")"
_LUT3 = ", ".join(f"CASE WHEN frame_idx = ref_idx THEN {c} ELSE {o} END {c}" for c, o in (("b", "ob"), ("g", "og"), ("r", "r_")))
_LUTJ = ", ".join(
    f'j_{c} AS MATERIALIZED (SELECT t.*, lut.out {o} FROM {before} t JOIN lut ON lut.stack_id = t.stack_id AND lut.frame_idx = t.frame_idx AND lut."value" = t.{c})'
    for c, o, before in (("b", "ob", "px"), ("g", "og", "j_b"), ("r", "r_", "j_g"))
)


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.REF}, {_LUTSQL}, {_LUTJ} SELECT {o._PX4}, {_LUT3} FROM j_r JOIN refs USING (stack_id)")
def J2_apply_lut(s, d):
    px = fx.pixels(s, d)
    return balance.balance_frames(px, _refs(px), "LUMI", "MATCH_HIST")[0].select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS}, {o.HIST}, {o.MID}, {o.REF} SELECT m.stack_id, m.frame_idx, m.channel, round(m.mid, 6) mid, round(r.mid, 6) ref_mid FROM mid m JOIN refs USING (stack_id) JOIN mid r ON r.stack_id = m.stack_id AND r.frame_idx = ref_idx")
def J1_reference_join(s, d):
    px = fx.pixels(s, d)
    mid = balance.mid_value(balance.histogram(px))
    ref = balance.reference_rows(mid, _refs(px)).withColumnRenamed("mid", "ref_mid")
    return _rounded(mid.join(ref, ["stack_id", "channel"]), "mid", "ref_mid")


_RGBCORR = """hist AS (SELECT stack_id, frame_idx, 'B' channel, b AS "value", count(*) n FROM px GROUP BY ALL UNION ALL SELECT stack_id, frame_idx, 'G', g, count(*) FROM px GROUP BY ALL
    UNION ALL SELECT stack_id, frame_idx, 'R', r, count(*) FROM px GROUP BY ALL)"""
_RGBAPPLY = ", ".join(o._cut(f"{c} * k{c}.param", 255) + f" {c}" for c in "bgr")
_RGBJOIN = " ".join(f"JOIN corr k{c} ON k{c}.stack_id = px.stack_id AND k{c}.frame_idx = px.frame_idx AND k{c}.channel = '{c.upper()}'" for c in "bgr")


@query(f"WITH {o.SQL_PIXELS}, {_RGBCORR}, {o.MID}, {o.REF}, {o.LINEAR} SELECT px.stack_id, px.frame_idx, px.y, px.x, {_RGBAPPLY} FROM px {_RGBJOIN}")
def K1_balance_rgb(s, d):
    px = fx.pixels(s, d)
    return balance.balance_frames(px, _refs(px), "RGB")[0].select(*PX, "b", "g", "r")


def _space_query(name: str, mode: str, to: str, back: str, mapped: tuple[str, ...], rest: str) -> None:
    """Balances 16-bit pixels in another colour space; ``to`` and ``back`` are tables from px to ``sp`` and from ``bal``."""
    each = " UNION ALL ".join(f"SELECT stack_id, frame_idx, '{c.upper()}' channel, {c} AS \"value\", count(*) n FROM sp GROUP BY ALL" for c in mapped)
    joins = " ".join(f"JOIN corr k{c} ON k{c}.stack_id = sp.stack_id AND k{c}.frame_idx = sp.frame_idx AND k{c}.channel = '{c.upper()}'" for c in mapped)
    cols = ", ".join(o._cut(f"sp.{c} * k{c}.param") + f" {c}" for c in mapped)
    sql = (f"WITH {o.SQL_WIDE}, {to}, hist AS ({each}), {o.MID}, {o.REF}, {o.LINEAR}, "
           f"bal AS (SELECT sp.stack_id, sp.frame_idx, sp.y, sp.x, {rest}, {cols} FROM sp {joins}), {back}")  # fmt: skip
    at = sql.rindex(f"SELECT {o._PX4}")  # the reference frame stays as it is
    kept = ", ".join(f"CASE WHEN px.frame_idx = ref_idx THEN px.{c} ELSE done.{c} END {c}" for c in "bgr")
    sql = f"{sql[:at].rstrip()}, done AS ({sql[at:]}) SELECT px.stack_id, px.frame_idx, px.y, px.x, {kept} FROM px JOIN done USING ({o._PX4}) JOIN refs ON refs.stack_id = px.stack_id"

    def f(s, d):
        px = fx.pixels(s, d, wide=True)
        return balance.balance_frames(px, _refs(px), mode, depth=16)[0].select(*PX, "b", "g", "r")

    f.__name__ = name
    query(sql)(f)


_space_query("K1_balance_hsv", "HSV", f"{o.HSV}, {_HSV_SQL}, sp AS (SELECT * FROM hsv)",
             f"i AS (SELECT {o._PX4}, h / {_U} * 360 hh, s / {_U} ss, v / {_U} vv FROM bal) SELECT {o._PX4}, {o._sextants('hh', '(vv * ss)', '(vv - vv * ss)')} FROM i", ("s", "v"), "sp.h h")
_space_query("K1_balance_hls", "HLS", f"{o.HSV}, {_HLS_SQL}, sp AS (SELECT * FROM hls)",
             f"{_HLS_BACK.replace('FROM hls', 'FROM bal')} SELECT {o._PX4}, {o._sextants('hh', 'cc', '(ll - cc / 2)')} FROM i", ("l", "s"), "sp.h h")
_space_query("K1_balance_lab", "LAB", f"{o._lab().replace('lab AS', 'sp AS')}", f"{o._from_lab().replace('FROM lab', 'FROM bal')}", ("l",), "sp.a a, sp.b b")


def _space8_balance(mode: str, map_: str) -> None:
    def f(s, d):
        px = fx.pixels(s, d)
        return balance.balance_frames(px, _refs(px), mode, map_)[0].select(*PX, "b", "g", "r")

    f.__name__ = f"K1_balance_{mode.lower()}_{map_.lower()}_8bit"
    query(o.balanced8(mode, map_, _BISECT, _MATCH))(f)


for _mode in ("HSV", "HLS", "LAB"):
    for _map in ("LINEAR", "GAMMA", "MATCH_HIST"):
        _space8_balance(_mode, _map)


@query(f"WITH RECURSIVE {o.SQL_PIXELS}, {o.HIST}, {o.MID}, {o.REF}, {_BISECT}, gm AS (SELECT stack_id, frame_idx, CASE WHEN frame_idx = ref_idx THEN 1.0::DOUBLE ELSE (lo + hi) / 2 END param FROM it JOIN refs USING (stack_id) WHERE i = 42) "
       f"SELECT {o._PX4}, {', '.join(f'CASE WHEN param = 1 THEN {c} ELSE CAST(floor(greatest(0.0::DOUBLE, least(pow({c}::DOUBLE / 255, 1 / param) * 255, 255.0::DOUBLE))) AS BIGINT) END {c}' for c in 'bgr')} FROM px JOIN gm USING (stack_id, frame_idx)")
def K1_balance_gamma(s, d):
    px = fx.pixels(s, d)
    return balance.balance_frames(px, _refs(px), "LUMI", "GAMMA")[0].select(*PX, "b", "g", "r")


_MASKED = f"""{o.SQL_PIXELS.replace('px AS', 'px0 AS')}, {o.sized('px0', 'pz0')},
    thin AS (SELECT stack_id, frame_idx, y // 2 y, x // 2 x, (h + 1) // 2 h, (w + 1) // 2 w, b, g, r FROM pz0 WHERE y % 2 = 0 AND x % 2 = 0),
    px1 AS (SELECT * FROM thin WHERE pow(x - w / 2.0, 2) + pow(y - h / 2.0, 2) <= pow(least(w, h) * 0.9 / 2, 2))"""


@query(f'WITH {_MASKED}, px AS (SELECT * FROM px0), hist AS (SELECT stack_id, frame_idx, \'L\' channel, {o.LUMA} AS "value", count(*) n FROM px1 GROUP BY ALL), '
       f'mid AS (SELECT stack_id, frame_idx, channel, sum("value" * n) / sum(n) mid FROM hist WHERE "value" BETWEEN 20 AND 230 GROUP BY ALL), {o.REF}, {o.LINEAR} SELECT {o._PX4}, {_APPLY} FROM px JOIN corr USING (stack_id, frame_idx)')
def K1_balance_masked_subsample(s, d):
    px = with_size(fx.pixels(s, d))
    return balance.balance_frames(px, _refs(px), lo=20, hi=230, factor=2, mask_size=0.9)[0].select(*PX, "b", "g", "r")


# ---- vignetting -----------------------------------------------------------------------------------------------

_RADIAL = f"""rb AS (SELECT *, least(floor(sqrt(pow(x - w / 2.0::DOUBLE, 2) + pow(y - h / 2.0::DOUBLE, 2)) / sqrt(pow(w / 2.0::DOUBLE, 2) + pow(h / 2.0::DOUBLE, 2)) * 20), 19)::BIGINT bin, {o.LUMA} v FROM pz),
    rm AS (SELECT stack_id, frame_idx, bin, avg(v) mean_i FROM rb GROUP BY ALL),
    rf AS (SELECT stack_id, frame_idx, max(sqrt(pow(w / 2.0::DOUBLE, 2) + pow(h / 2.0::DOUBLE, 2))) far FROM pz GROUP BY ALL)"""


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED}, {_RADIAL} SELECT rf.stack_id, rf.frame_idx, v.range AS bin, round((v.range + 0.5::DOUBLE) * far / 20, 6) r_mid, round(mean_i, 6) mean_i FROM rf, range(0, 20) v LEFT JOIN rm ON rm.stack_id = rf.stack_id AND rm.frame_idx = rf.frame_idx AND rm.bin = v.range")
def A12_radial_profile(s, d):
    return _rounded(vignette.radial_profile(with_size(fx.pixels(s, d)), 20), "r_mid", "mean_i")


@query()
def A13_fit_vignette(s, d):
    fitted = vignette.fit_vignette(vignette.radial_profile(with_size(fx.pixels(s, d)), 20))
    return _rounded(fitted, "i0", "k", "r0", digits=3)


_PARAMS = "SELECT p_partkey::BIGINT stack_id, 0::BIGINT frame_idx, (100 + p_partkey % 150)::DOUBLE i0, (1 + p_partkey % 20) / 1000.0::DOUBLE k, (300 + p_partkey % 700)::DOUBLE r0, 1200.0::DOUBLE far FROM part"


def _params(s, d):
    return fx.table(s, d, "part").selectExpr(
        "CAST(p_partkey AS BIGINT) stack_id", "0L frame_idx", "CAST(100 + p_partkey % 150 AS DOUBLE) i0",
        "(1 + p_partkey % 20) / 1000D k", "CAST(300 + p_partkey % 700 AS DOUBLE) r0", "1200D far",
    )


@query(f"""WITH q AS ({_PARAMS}), v AS (SELECT *, i0 / (1 + exp(least(10.0::DOUBLE, exp(greatest(-10.0::DOUBLE, least(-k * r0, 10.0::DOUBLE)))))) v0 FROM q),
    e AS (SELECT *, i0 / (p * v0) - 1 inn FROM v, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) s(p))
    SELECT stack_id, frame_idx, p, round(CASE WHEN p >= 1 OR inn <= 1 THEN 0 ELSE greatest(0, least(r0 + ln(ln(inn)) / k, far)) END, 6) radius FROM e""")
def A14_vignette_radii(s, d):
    return _rounded(vignette.vignette_radii(_params(s, d), (0.1, 0.5, 0.9, 1.0)), "radius")


_FALL = "(200.0::DOUBLE / (1 + exp(least(10.0::DOUBLE, exp(greatest(-10.0::DOUBLE, least(0.05::DOUBLE * (R - 20), 10.0::DOUBLE)))))))"
_RAD = "sqrt(pow(x - w / 2.0::DOUBLE, 2) + pow(y - h / 2.0::DOUBLE, 2))"
_VFIX = ", ".join(f"CASE WHEN least(b, g, r) < 1 THEN {c} ELSE floor(least(round({c} / v, 6), 255))::BIGINT END {c}" for c in "bgr")


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED}, q AS (SELECT *, greatest(0.000001::DOUBLE, least({_FALL.replace('R', _RAD)} / {_FALL.replace('R', '0')}, 1)) v FROM pz) SELECT {o._PX4}, {_VFIX} FROM q")
def G6_correct_vignetting(s, d):
    px = with_size(fx.pixels(s, d))
    params = px.select("stack_id", "frame_idx").distinct().selectExpr("*", "200D i0", "0.05D k", "20D r0")
    return vignette.correct_vignetting(px, params).select(*PX, "b", "g", "r")


@query(ORACLE_SQL["G6_correct_vignetting"].replace("least(b, g, r) < 1", "least(b, g, r) < 20"))
def F8_black_exemption(s, d):
    px = with_size(fx.pixels(s, d))
    params = px.select("stack_id", "frame_idx").distinct().selectExpr("*", "200D i0", "0.05D k", "20D r0")
    return vignette.correct_vignetting(px, params, black=20).select(*PX, "b", "g", "r")


@query()
def K3_correct_vignetting_fitted(s, d):
    return stack.correct_vignette(steps=20)(fx.pixels(s, d)).select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS}, {o.DIFF}, {o.HOT}, {_NEAR}, {_FIX.replace('avg', 'median')} SELECT {o._PX4}, coalesce(nb, b) b, coalesce(ng, g) g, coalesce(nr, r) r FROM px LEFT JOIN fix USING ({o._PX4})")
def K2_mask_noise_median(s, d):
    px = fx.pixels(s, d)
    return noise.repair_hot_pixels(px, noise.hot_pixels_rgb(_diff(s, d), fixed=40), how="median").select(*PX, "b", "g", "r")


@query(f"WITH {_LABDIFF}, q AS (SELECT *, floor(round((d - min(d) OVER (PARTITION BY stack_id)) / 0.01::DOUBLE, 6)) bin FROM far), "
       "e AS (SELECT a.stack_id, a.bin, count(*) n FROM (SELECT DISTINCT stack_id, bin FROM q) a JOIN q ON q.stack_id = a.stack_id AND q.bin >= a.bin GROUP BY ALL), "
       f"te AS (SELECT stack_id, max(bin) edge FROM e WHERE n >= 25 GROUP BY 1), hot AS (SELECT stack_id, y, x FROM q JOIN te USING (stack_id) WHERE bin >= edge), {_NEAR}, {_FIX} "
       f"SELECT {o._PX4}, coalesce(nb, b) b, coalesce(ng, g) g, coalesce(nr, r) r FROM px LEFT JOIN fix USING ({o._PX4})")
def K2_mask_noise(s, d):
    """The step as it comes: the 25 noisiest pixels by distance in Lab, with its guard."""
    return stack.mask_noise(25)(fx.pixels(s, d)).select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_WIDE} SELECT stack_id, y, x, " + ", ".join(f"CAST(floor(avg({c} / 256.0::DOUBLE)) AS BIGINT) {c}" for c in "bgr") + " FROM px GROUP BY ALL")
def A7_mean_frame_16bit(s, d):
    return noise.mean_frame(fx.pixels(s, d, wide=True), depth=16)


# ---- stencils and pyramids ------------------------------------------------------------------------------------


def _sharp(s, d):
    return with_size(fx.sharp_pixels(s, d))


_SZ = f"{o.SQL_SHARP}, {o.SIZED}"


@query(f"WITH {_SZ}, {o.conv('pz', 'c', {c: f'b.{c}' for c in 'bgr'}, o.G5)} SELECT {o._PX4}, b::BIGINT b, g::BIGINT g, r::BIGINT r FROM c")
def W3_convolve(s, d):
    return stencil(_sharp(s, d), GENERATING, None, ["b", "g", "r"]).select(*PX, "b", "g", "r")


@query(f"WITH {_SZ}, {o.reduced('pz', 'c', 'bgr')} SELECT {o._PX4}, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM c")
def W4_reduce(s, d):
    return _rounded(reduce(_sharp(s, d), ["b", "g", "r"]).select(*PX, "b", "g", "r"), "b", "g", "r")


_F0 = f"f0 AS (SELECT {o._PX4}, h, w, b::DOUBLE b, g::DOUBLE g, r::DOUBLE r FROM pz)"
_LAP = f"{_SZ}, {_F0}, {o.reduced('f0', 'f1', 'bgr')}, {o.expanded('f1', 'f0', 'u0', 'bgr')}, {o.plus('f0', 'u0', 'l0', 'bgr', '-')}"


@query(f"WITH {_LAP} SELECT 0 AS level, {o._PX4}, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM l0 UNION ALL SELECT 1, {o._PX4}, round(b, 6), round(g, 6), round(r, 6) FROM f1")
def W5_laplacian_pyramid(s, d):
    a, b = (p.select(F.lit(i).alias("level"), *PX, "b", "g", "r") for i, p in enumerate(pyramid.laplacian_pyramid(fx.sharp_pixels(s, d), 1)))
    return _rounded(a.unionByName(b), "b", "g", "r")


@query(f"WITH {_LAP.split(', f1_ AS')[0]}, {o.reduced('f0', 'f1', 'bgr')}, {o.expanded('f1', 'f0', 'u0', 'bgr')} SELECT {o._PX4}, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM u0")
def J9_expand(s, d):
    px = _sharp(s, d).select(*PX, "h", "w", *(F.col(c).cast("double") for c in "bgr"))
    return _rounded(expand(reduce(px, ["b", "g", "r"]), px, ["b", "g", "r"]).select(*PX, "b", "g", "r"), "b", "g", "r")


_FUSED = f"WITH {_SZ}, {o._pyramid()}"


@query(f"{_FUSED} SELECT stack_id, y, x, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM w0")
def A15_focus_argmax(s, d):
    level = pyramid.laplacian_pyramid(fx.sharp_pixels(s, d), 1)[0]
    return _rounded(pyramid.focus_argmax(level).select("stack_id", "y", "x", "b", "g", "r"), "b", "g", "r")


@query(f"{_FUSED} SELECT stack_id, y, x, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM base")
def A16_base_fusion(s, d):
    level = pyramid.laplacian_pyramid(fx.sharp_pixels(s, d), 1)[1]
    return _rounded(pyramid.base_fusion(level).select("stack_id", "y", "x", "b", "g", "r"), "b", "g", "r")


@query(f"{_FUSED} SELECT * FROM fused")
def K4_focus_stack_pyramid(s, d):
    px = fx.sharp_pixels(s, d)
    h, w = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    return pyramid.focus_stack_pyramid(px, pyramid.levels_for(h, w, 8))


_LARGE = f"{fx.SQL_LARGE}, {o.SIZED}"


@query(f"WITH {_LARGE}, {o.pyramid_deep(3)} SELECT * FROM fused")
def K4_pyramid_of_large_frames(s, d):
    px = fx.large_pixels(s, d)
    h, w = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    return pyramid.focus_stack_pyramid(px, pyramid.levels_for(h, w))


def _mixed_sql(stack: int, levels: int) -> str:
    some = fx.SQL_LARGE.replace(" px AS MATERIALIZED", " pxl AS MATERIALIZED") + f", px AS MATERIALIZED (SELECT * FROM pxl WHERE stack_id = {stack} AND (stack_id = 0 OR (y < 130 AND x < 150)))"
    return f"SELECT * FROM (WITH {some}, {o.SIZED}, {o.pyramid_deep(levels)} SELECT * FROM fused)"


@query(f"{_mixed_sql(0, 3)} UNION ALL {_mixed_sql(1, 2)}")
def K4_stacks_of_two_shapes(s, d):
    """Frames of 275 columns with three levels, and of 150 with two, in one call."""
    return pyramid.focus_stack_pyramid(fx.large_pixels(s, d).filter("stack_id = 0 or (y < 130 and x < 150)"))


_BUNCHED = f"""{o.SQL_SHARP}, {o.sized('px', 'pw')}, bu AS (SELECT * FROM (VALUES (0), (1)) t(bunch_idx)),
    pz AS (SELECT stack_id, bunch_idx::BIGINT bunch_idx, frame_idx, y, x, h, w, b, g, r FROM pw, bu WHERE frame_idx >= bunch_idx * 2 AND frame_idx < bunch_idx * 2 + 3)"""


@query(f"WITH {_BUNCHED}, {o._pyramid(('stack_id', 'bunch_idx'))} SELECT * FROM fused")
def K6_focus_stack_bunch(s, d):
    px = fx.sharp_pixels(s, d)
    h, w = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    return stack.focus_stack_bunch(px, pyramid.levels_for(h, w, 8), n=3, overlap=1)


_BUNCH = f"""{o.FR}, n AS (SELECT stack_id, count(*) alln FROM frames GROUP BY 1), st AS (SELECT stack_id, alln, b.range bunch_idx FROM n, range(0, 100000) b WHERE b.range = 0 OR b.range * 8 < alln - 2)"""


_AS_STACKS = f"""{o.SQL_SHARP.replace(' px AS (', ' px3 AS (')}, px AS MATERIALIZED (SELECT stack_id * 10 + bunch_idx stack_id, frame_idx, y, x, b, g, r FROM px3, (VALUES (0), (1)) t(bunch_idx)
    WHERE frame_idx >= bunch_idx * 2 AND frame_idx < bunch_idx * 2 + 3), {o.sized('px', 'pz3')}, pz AS (SELECT *, {o.LUMA} v FROM pz3)"""


@query(f"WITH {_AS_STACKS}, {o._energy('laplacian')}, {o._bilateral()}, {{MAX}}, wb AS (SELECT * FROM wm), {o.blend_deep(1)} SELECT stack_id // 10 stack_id, stack_id % 10 bunch_idx, y, x, b, g, r FROM blended")
def K6_depthmaps_of_bunches(s, d):
    return stack.focus_stack_bunch(fx.sharp_pixels(s, d), n=3, overlap=1, algo="depthmap", levels=2)


@query(f"WITH {_BUNCH} SELECT st.stack_id, bunch_idx, frame_idx FROM st JOIN frames ON frames.stack_id = st.stack_id AND frame_idx >= bunch_idx * 8 AND frame_idx < bunch_idx * 8 + 10")
def W2_bunches(s, d):
    return bunches(_frames(s, d), 10, 2)


@query(f"WITH {_BUNCH} SELECT st.stack_id, bunch_idx, count(*) n, min(path) first_path FROM st JOIN frames ON frames.stack_id = st.stack_id AND frame_idx >= bunch_idx * 8 AND frame_idx < bunch_idx * 8 + 10 GROUP BY ALL")
def J5_frames_of_bunches(s, d):
    f = _frames(s, d)
    return bunches(f, 10, 2).join(f, ["stack_id", "frame_idx"]).groupBy("stack_id", "bunch_idx").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query(f"WITH {o.SQL_FILES} SELECT stack_id, path, row_number() OVER (PARTITION BY stack_id ORDER BY path DESC) - 1 frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY path DESC) - 1 k FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('tif', 'jpg', 'png', 'cr2')) WHERE k % 3 = 0")
def W1_every_third_reversed(s, d):
    return src.scan_catalog(fx.frame_files(s, d), every=3, reverse=True).select("stack_id", "path", "frame_idx")


_GAUSS = tuple(gaussian_taps(1.0, 7))


@query(f"WITH {_SZ}, {o.conv('pz', 'c', {c: f'b.{c}' for c in 'bgr'}, _GAUSS)} SELECT {o._PX4}, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM c")
def W6_gaussian_blur(s, d):
    return _rounded(stencil(_sharp(s, d), _GAUSS, None, ["b", "g", "r"]).select(*PX, "b", "g", "r"), "b", "g", "r")


@query(f"WITH {_SZ}, {_F0}, {o.reduced('f0', 'f1', 'bgr', t=o.B5)} SELECT {o._PX4}, round(b, 6) b, round(g, 6) g, round(r, 6) r FROM f1")
def W7_pyr_down(s, d):
    return _rounded(reduce(_sharp(s, d), ["b", "g", "r"], taps=BINOMIAL).select(*PX, "b", "g", "r"), "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS}, h AS (SELECT stack_id, frame_idx, b AS \"value\", count(*) n FROM px GROUP BY ALL) SELECT stack_id, frame_idx, \"value\", sum(n) OVER (PARTITION BY stack_id, frame_idx ORDER BY \"value\" DESC)::BIGINT above FROM h")
def W9_reverse_cumulative(s, d):
    h = balance.histogram(fx.pixels(s, d), "RGB").filter("channel = 'B'")
    return balance.reverse_cumulative(h).select("stack_id", "frame_idx", "value", "above")


# ---- depth maps -----------------------------------------------------------------------------------------------


def _gray(s, d):
    return with_size(fx.gray_pixels(s, d))


def _energy_query(kind: str) -> None:
    def f(s, d):
        return _rounded(depthmap.energy_map(_gray(s, d), kind).select(*PX, "e"), "e")

    f.__name__ = f"A17_energy_{kind}"
    query(f"WITH {o.GRAYZ}, {o._energy(kind)} SELECT {o._PX4}, round(e, 6) e FROM en")(f)


for _kind in ("laplacian", "sobel", "variance", "tenengrad"):
    _energy_query(_kind)

_EN = f"{o.GRAYZ}, {o._energy('laplacian')}"
_AVG = "wa AS MATERIALIZED (SELECT stack_id, frame_idx, y, x, CASE WHEN sum(e) OVER p <> 0 THEN e / sum(e) OVER p ELSE 0 END wt FROM en WINDOW p AS (PARTITION BY stack_id, y, x))"
_MAX = """mx AS MATERIALIZED (SELECT *, max(round(e, 6)) OVER (PARTITION BY stack_id, y, x) me FROM EN),
    wm AS (SELECT stack_id, frame_idx, y, x, (round(e, 6) = me)::INT::DOUBLE / sum((round(e, 6) = me)::INT) OVER (PARTITION BY stack_id, y, x) wt FROM mx)"""


@query(f"WITH {_EN}, {o._bilateral()} SELECT {o._PX4}, round(e, 6) e FROM sm2")
def W8_bilateral(s, d):
    return _rounded(depthmap.bilateral(depthmap.energy_map(_gray(s, d))).select(*PX, "e"), "e")


ORACLE_SQL["K6_depthmaps_of_bunches"] = ORACLE_SQL["K6_depthmaps_of_bunches"].replace("{MAX}", _MAX.replace("EN)", "sm2)"))


@query(f"WITH {_EN}, {o._bilateral(2)} SELECT {o._PX4}, round(e, 8) e FROM sm2")
def W8_bilateral_wide(s, d):
    return _rounded(depthmap.bilateral(depthmap.energy_map(_gray(s, d)), d=5).select(*PX, "e"), "e", digits=8)


@query(f"WITH {_EN}, {_AVG} SELECT {o._PX4}, round(wt, 6) wt FROM wa")
def A18_weights_average(s, d):
    return _rounded(depthmap.focus_weights(depthmap.energy_map(_gray(s, d)), "average").select(*PX, "wt"), "wt")


@query(f"WITH {_EN}, {_MAX.replace('EN)', 'en)')}, so AS (SELECT {o._PX4}, e, exp((e - max(e) OVER p) / 50) z FROM en WINDOW p AS (PARTITION BY stack_id, y, x)) "
       f"SELECT 'hard' kind, {o._PX4}, round(wt, 6) wt FROM wm UNION ALL SELECT 'soft', {o._PX4}, round(z / sum(z) OVER (PARTITION BY stack_id, y, x), 6) FROM so")
def A19_weights_max(s, d):
    e = depthmap.energy_map(_gray(s, d))
    hard = depthmap.focus_weights(e).select(F.lit("hard").alias("kind"), *PX, "wt")
    soft = depthmap.focus_weights(e, temperature=50.0).select(F.lit("soft").alias("kind"), *PX, "wt")
    return _rounded(hard.unionByName(soft), "wt")


@query(f"WITH {_EN}, {_AVG}, pw AS (SELECT {o._PX4}, wt * wt wt FROM wa) SELECT {o._PX4}, round(CASE WHEN sum(wt) OVER p <> 0 THEN wt / sum(wt) OVER p ELSE 0 END, 6) wt FROM pw WINDOW p AS (PARTITION BY stack_id, y, x)")
def A20_weight_power(s, d):
    w = depthmap.focus_weights(depthmap.energy_map(_gray(s, d)), "average")
    return _rounded(depthmap.weight_power(w, 2).select(*PX, "wt"), "wt")


@query(f"WITH {_EN}, {_AVG} SELECT stack_id, y, x, floor(round(sum(wt * frame_idx) / sum(wt) / 9 * 255, 6))::BIGINT AS depth FROM wa GROUP BY ALL")
def A21_depth_map(s, d):
    return depthmap.depth_map(depthmap.focus_weights(depthmap.energy_map(_gray(s, d)), "average"))


_COLORGRAY = f"{_SZ.replace('pz AS', 'pz3 AS')}, pz AS (SELECT *, {o.LUMA} v FROM pz3)"
_BLEND = f"""g0 AS (SELECT {o._PX4}, h, w, b::DOUBLE b, g::DOUBLE g, r::DOUBLE r, wt FROM pz JOIN wb USING ({o._PX4})),
    {o.reduced('g0', 'g1', ('b', 'g', 'r', 'wt'), t=o.B5)}, {o.expanded('g1', 'g0', 'u0', 'bgr', t=o.B5)}, {o.plus('g0', 'u0', 'l0', 'bgr', '-', keep=('h', 'w', 'wt'))},
    s0 AS (SELECT stack_id, y, x, h, w, {', '.join(f'CASE WHEN sum(wt) > 1e-8 THEN sum({c} * wt) / sum(wt) ELSE 0 END {c}' for c in 'bgr')} FROM l0 GROUP BY stack_id, y, x, h, w),
    s1 AS (SELECT stack_id, y, x, h, w, {', '.join(f'CASE WHEN sum(wt) > 1e-8 THEN sum({c} * wt) / sum(wt) ELSE 0 END {c}' for c in 'bgr')} FROM g1 GROUP BY stack_id, y, x, h, w),
    {o.expanded('s1', 's0', 'v0', 'bgr', ('stack_id',), o.B5)}, {o.plus('s0', 'v0', 'img', 'bgr', '+', ('stack_id',))},
    blended AS (SELECT stack_id, y, x, {', '.join(f'floor(round(greatest(0, least({c}, 255)), 6))::BIGINT {c}' for c in 'bgr')} FROM img)"""


@query(f"WITH {_COLORGRAY}, {o._energy('laplacian')}, {_AVG}, wb AS (SELECT * FROM wa), {_BLEND} SELECT * FROM blended")
def A22_weighted_blend(s, d):
    px = _sharp(s, d)
    e = depthmap.energy_map(px.withColumn("v", color.gray("b", "g", "r")))
    return depthmap.weighted_blend(px, depthmap.focus_weights(e, "average"), levels=2)


@query(f"WITH {_COLORGRAY}, {o._energy('laplacian')}, {o._bilateral()}, {_MAX.replace('EN)', 'sm2)')}, wb AS (SELECT * FROM wm), {_BLEND} SELECT * FROM blended")
def K5_focus_stack_depthmap(s, d):
    return depthmap.focus_stack_depthmap(_sharp(s, d), levels=2)


_SHARE2 = "ws AS MATERIALIZED (SELECT * FROM (SELECT sm2.*, e * e / nullif(sum(e * e) OVER (PARTITION BY stack_id, y, x), 0) wt FROM sm2))"


@query(f"""WITH {_COLORGRAY}, {o.conv('pz', 'sm', {'v': 'b.v'}, (1, 2, 1), scale='16.0::DOUBLE')}, {o.conv('sm', 'la', {'l1': 'b.v'}, (1, -2, 1), (1, 2, 1))}, {o.conv('sm', 'lb', {'l2': 'b.v'}, (1, 2, 1), (1, -2, 1))},
    en AS MATERIALIZED (SELECT {o._PX4}, la.h, la.w, abs(l1 + l2) e FROM la JOIN lb USING ({o._PX4})), {o._bilateral(2)}, {_SHARE2}, w0 AS (SELECT * REPLACE (coalesce(wt, 0) AS wt) FROM ws),
    {o.conv('w0', 'wb', {'wt': 'b.wt'}, (1, 2, 1), scale='16.0::DOUBLE')}, {o.blend_deep(2).replace('FROM pz JOIN wb USING', 'FROM pz JOIN (SELECT stack_id, frame_idx, y, x, wt FROM wb) USING')} SELECT * FROM blended""")
def K5_depthmap_options(s, d):
    """Other kernels, smoothing of energies and of weights, the square of the shares, three levels."""
    return depthmap.focus_stack_depthmap(_sharp(s, d), map_="average", power=2.0, levels=3, kernel_size=3, blur_size=3, energy_smooth_size=5, pyramid_smooth_size=3)


@query(f"WITH {_COLORGRAY.replace(o.SQL_SHARP, fx.SQL_LARGE)}, {o._energy('laplacian')}, {o._bilateral()}, {_MAX.replace('EN)', 'sm2)')}, wb AS (SELECT * FROM wm), {o.blend_deep(4)} SELECT * FROM blended")
def K5_depthmap_of_large_frames(s, d):
    return depthmap.focus_stack_depthmap(fx.large_pixels(s, d))


_SHARPEN = ", ".join(f"CASE WHEN abs({c} - floor(round(s{c}, 6) + 0.5)) > 4 THEN greatest(0, least(floor(round({c} * 1.5 - 0.5 * floor(round(s{c}, 6) + 0.5), 6) + 0.5), 255))::BIGINT ELSE {c} END {c}" for c in "bgr")


@query(f"WITH {_SZ}, {o.conv('pz', 'c', {f's{c}': f'b.{c}' for c in 'bgr'}, _GAUSS, keep=('b', 'g', 'r'))} SELECT {o._PX4}, {_SHARPEN} FROM c")
def I1_unsharp_mask(s, d):
    return filters.unsharp_mask(_sharp(s, d), 1.0, 0.5, 4).select(*PX, "b", "g", "r")


_CLAHE = """tl AS (SELECT *, floor(y / (h / 2.0))::BIGINT ty, floor(x / (w / 2.0))::BIGINT tx FROM pz),
    ct AS (SELECT stack_id, frame_idx, ty, tx, v AS "value", count(*) n FROM tl GROUP BY ALL), ar AS (SELECT stack_id, frame_idx, ty, tx, count(*) area FROM tl GROUP BY ALL),
    de AS (SELECT ar.*, v.range AS "value", coalesce(n, 0) n, greatest(floor(2.0 * area / 256), 1) lim FROM ar, range(0, 256) v LEFT JOIN ct ON ct.stack_id = ar.stack_id AND ct.frame_idx = ar.frame_idx AND ct.ty = ar.ty AND ct.tx = ar.tx AND ct."value" = v.range),
    ex AS (SELECT *, sum(greatest(n - lim, 0)) OVER (PARTITION BY stack_id, frame_idx, ty, tx)::BIGINT xs FROM de),
    ad AS (SELECT *, least(n, lim) + xs // 256 + CASE WHEN xs % 256 > 0 AND "value" % greatest(256 // greatest(xs % 256, 1), 1) = 0 AND "value" // greatest(256 // greatest(xs % 256, 1), 1) < xs % 256 THEN 1 ELSE 0 END q FROM ex),
    lu AS (SELECT stack_id, frame_idx, ty, tx, "value", floor(sum(q) OVER (PARTITION BY stack_id, frame_idx, ty, tx ORDER BY "value") * 255.0::DOUBLE / area + 0.5) out FROM ad),
    po AS (SELECT *, (y + 0.5::DOUBLE) / (h / 2.0::DOUBLE) - 0.5 gy, (x + 0.5::DOUBLE) / (w / 2.0::DOUBLE) - 0.5 gx FROM pz),
    sp AS (SELECT po.*, CASE WHEN j = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END * CASE WHEN i = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END wt,
      greatest(0, least(floor(gy)::BIGINT + j, 1)) ty, greatest(0, least(floor(gx)::BIGINT + i, 1)) tx FROM po, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(j, i)),
    mi AS (SELECT sp.stack_id, sp.frame_idx, y, x, max(v) v0, sum(wt * out) v1 FROM sp JOIN lu ON lu.stack_id = sp.stack_id AND lu.frame_idx = sp.frame_idx AND lu.ty = sp.ty AND lu.tx = sp.tx AND lu."value" = sp.v GROUP BY ALL)"""


@query(f"WITH {o.GRAYZ}, {_CLAHE} SELECT {o._PX4}, floor(round(0.5 * v0 + 0.5 * floor(round(v1, 6) + 0.5), 6) + 0.5)::BIGINT v FROM mi")
def I2_local_tonemap(s, d):
    return filters.local_tonemap(_gray(s, d), 0.5, 2.0, 2).select(*PX, "v")


@query(f"""WITH {_SZ.replace('pz AS', 'pzc AS')}, {o._lab(8)}, pz AS MATERIALIZED (SELECT lab.*, pzc.h, pzc.w, lab.l v FROM lab JOIN pzc USING ({o._PX4})), {_CLAHE},
    bal AS (SELECT {o._PX4}, floor(round(0.5 * v0 + 0.5 * floor(round(v1, 6) + 0.5), 6) + 0.5)::BIGINT l, lab.a, lab.b FROM mi JOIN lab USING ({o._PX4})), {o._from_lab(8).replace('FROM lab', 'FROM bal')}""")
def I2_local_tonemap_color(s, d):
    return filters.local_tonemap_color(_sharp(s, d)).select(*PX, "b", "g", "r")


@query()
def I3_denoise(s, d):
    return filters.denoise(_sharp(s, d), h=10.0).select(*PX, "b", "g", "r")


_SHARP0 = ", ".join(f"greatest(0, least(floor(round({c} * 1.5 - 0.5 * floor(round(s{c}, 6) + 0.5), 6) + 0.5), 255))::BIGINT {c}" for c in "bgr")


@query(f"{_FUSED}, {o.sized('fused', 'fz')}, {o.conv('fz', 'c', {f's{c}': f'b.{c}' for c in 'bgr'}, _GAUSS, keys=('stack_id',), keep=('b', 'g', 'r'))} SELECT stack_id, y, x, {_SHARP0} FROM c")
def I4_fuse_and_sharpen(s, d):
    fused = with_size(K4_focus_stack_pyramid(s, d))
    return filters.unsharp_mask(fused, 1.0, 0.5, 0, keys=("stack_id",)).select("stack_id", "y", "x", "b", "g", "r")


# ---- alignment ------------------------------------------------------------------------------------------------

_PAIRS = "prs AS (SELECT DISTINCT stack_id, frame_idx, frame_idx + 1 target_idx FROM kp)"


def _pairs(kp):
    return kp.select("stack_id", "frame_idx", (F.col("frame_idx") + 1).alias("target_idx")).distinct()


_MET = f"""{o.SQL_KEYPOINTS}, {_PAIRS}, met AS (SELECT a.stack_id, a.frame_idx, target_idx, a.kp_id kp0, b.kp_id kp1, a.desc_ da, b.desc_ db, a.signs sa, b.signs sb
    FROM kp a JOIN prs USING (stack_id, frame_idx) JOIN kp b ON b.stack_id = a.stack_id AND b.frame_idx = target_idx)"""


@query(f"""WITH {_MET}, q AS (SELECT stack_id, frame_idx, target_idx, kp0, kp1, round(sqrt(list_sum(list_transform(generate_series(1, len(da)), lambda i: (da[i]::DOUBLE - db[i]::DOUBLE) * (da[i]::DOUBLE - db[i]::DOUBLE)))), 9) dist FROM met),
    k AS (SELECT *, row_number() OVER w rk, lead(dist) OVER w d2 FROM q WINDOW w AS (PARTITION BY stack_id, frame_idx, target_idx, kp0 ORDER BY dist, kp1))
    SELECT stack_id, frame_idx, target_idx, kp0, kp1, round(dist, 6) dist FROM k WHERE rk = 1 AND dist < 0.95 * d2""")
def J6_match_knn(s, d):
    kp = fx.keypoints(s, d)
    return _rounded(align.match_knn(kp, _pairs(kp), 0.95), "dist")


_HAM = f"""{_MET}, q AS (SELECT stack_id, frame_idx, target_idx, kp0, kp1, list_sum(list_transform(generate_series(1, len(sa)), lambda i: ((sa[i] > 0) <> (sb[i] > 0))::INT))::BIGINT dist FROM met),
    k AS (SELECT *, row_number() OVER (PARTITION BY stack_id, frame_idx, target_idx, kp0 ORDER BY dist, kp1) ra, row_number() OVER (PARTITION BY stack_id, frame_idx, target_idx, kp1 ORDER BY dist, kp0) rb FROM q)"""


@query(f"WITH {_HAM} SELECT stack_id, frame_idx, target_idx, kp0, kp1, dist FROM k WHERE ra = 1 AND rb = 1")
def J7_match_cross_check(s, d):
    kp = fx.keypoints(s, d)
    return align.match_cross_check(kp, _pairs(kp))


@query(f"WITH {_HAM} SELECT stack_id, frame_idx, target_idx, kp0, kp1, dist FROM k WHERE ra = 1 AND rb = 1 AND dist <= 21")
def J7_match_within(s, d):
    """The same matches up to 21 bits, by tables of parts of the words."""
    kp = fx.keypoints(s, d)
    return align.match_within(kp, _pairs(kp), 21)


@query(f"WITH {_HAM} SELECT stack_id, frame_idx, kp0, kp1, dist, row_number() OVER (PARTITION BY stack_id, frame_idx ORDER BY dist, kp0) rank FROM k WHERE ra = 1 AND rb = 1")
def T4_matches_by_distance(s, d):
    kp = fx.keypoints(s, d)
    return align.best_matches(align.match_cross_check(kp, _pairs(kp))).select("stack_id", "frame_idx", "kp0", "kp1", "dist", "rank")


_CAND = f"""{o.FR}, {o.FREF}, cand AS (SELECT f.stack_id, f.frame_idx, f.frame_idx + sign(ref_idx - f.frame_idx)::BIGINT * d.delta target_idx, d.delta FROM frames f JOIN refs USING (stack_id), (VALUES (1), (2)) d(delta)
    WHERE f.frame_idx <> ref_idx AND d.delta <= abs(ref_idx - f.frame_idx))"""


@query(f"WITH {_CAND} SELECT * FROM cand")
def J8_pair_frames(s, d):
    f = _frames(s, d)
    return align.pair_frames(f, src.resolve_reference(f), 2)


@query(f"WITH {o.FR}, {o.FREF} SELECT stack_id, frame_idx FROM frames EXCEPT SELECT stack_id, ref_idx FROM refs")
def U3_without_reference(s, d):
    f = _frames(s, d)
    return src.without_reference(f, src.resolve_reference(f))


@query(f"WITH {o.FR}, {o.FREF} SELECT stack_id, frame_idx, row_number() OVER (PARTITION BY stack_id ORDER BY abs(frame_idx - ref_idx), frame_idx) rank FROM frames JOIN refs USING (stack_id)")
def T5_frames_by_distance(s, d):
    f = _frames(s, d)
    return src.by_distance(f, src.resolve_reference(f)).select("stack_id", "frame_idx", "rank")


@query(f"WITH {o.FR} SELECT stack_id, frame_idx, path FROM frames WHERE frame_idx < 5")
def T2_first_frames(s, d):
    return src.first_frames(_frames(s, d), 5).select("stack_id", "frame_idx", "path")


@query(f"WITH {o.FR} SELECT stack_id, frame_idx, path FROM frames ORDER BY stack_id, path")
def T1_sorted_frames(s, d):
    return src.sorted_frames(_frames(s, d)).select("stack_id", "frame_idx", "path")


@query(f"WITH {o.SQL_FILES} SELECT stack_id, path, 0 source_idx FROM files UNION ALL SELECT stack_id, 'more/' || path, 1 FROM files")
def U2_union_sources(s, d):
    a = fx.frame_files(s, d).select("stack_id", "path")
    return src.union_sources(a, a.withColumn("path", F.concat(F.lit("more/"), "path")))


@query(f"WITH {o.SQL_MATCHES} SELECT stack_id, frame_idx, count(*) n, count(*) >= 300 enough FROM m GROUP BY ALL")
def A23_match_counts(s, d):
    return align.match_counts(fx.matches(s, d), 300)


_FIT = """sm AS (SELECT stack_id, frame_idx, count(*)::DOUBLE n, sum(x0) x, sum(y0) y, sum(x1) u, sum(y1) v, sum(x0 * x0 + y0 * y0) q, sum(x0 * x1 + y0 * y1) c, sum(x0 * y1 - y0 * x1) d FROM SRC GROUP BY ALL),
    ab AS (SELECT *, (c - (x * u + y * v) / n) / (q - (x * x + y * y) / n) a, (d - (x * v - y * u) / n) / (q - (x * x + y * y) / n) b FROM sm)"""
_FITOUT = "round(a, 6) a, round(b, 6) b, round((u - a * x + b * y) / n, 5) tx, round((v - b * x - a * y) / n, 5) ty"


def _flat(models):
    m = F.col("m")
    return [F.round(m[0], 6).alias("a"), F.round(m[3], 6).alias("b"), F.round(m[2], 5).alias("tx"), F.round(m[5], 5).alias("ty")]


@query(f"WITH {o.SQL_MATCHES}, inl AS (SELECT * FROM m WHERE (kp_id // 5) % 4 <> 0), {_FIT.replace('SRC', 'inl')} SELECT stack_id, frame_idx, {_FITOUT} FROM ab")
def A24_similarity_fit(s, d):
    rows = fx.matches(s, d).filter("(kp_id div 5) % 4 <> 0")
    fitted = align.similarity_sums(rows, ["stack_id", "frame_idx"])
    return fitted.select("stack_id", "frame_idx", *_flat(fitted))


_RANSAC = """nu AS (SELECT *, row_number() OVER (PARTITION BY stack_id, frame_idx ORDER BY kp_id) - 1 i, count(*) OVER (PARTITION BY stack_id, frame_idx) n FROM m),
    fr AS (SELECT DISTINCT stack_id, frame_idx, n FROM nu), hy AS (SELECT fr.*, h.range hyp, (h.range * 7919 + 104729) % n i FROM fr, range(0, 256) h),
    hj AS (SELECT *, (i + 1 + (hyp * 6101 + 15485) % (n - 1)) % n j FROM hy),
    tw AS (SELECT hj.stack_id, hj.frame_idx, hyp, p.x0, p.y0, p.x1, p.y1, q.x0 - p.x0 dx, q.y0 - p.y0 dy, q.x1 - p.x1 du, q.y1 - p.y1 dv FROM hj JOIN nu p ON p.frame_idx = hj.frame_idx AND p.i = hj.i JOIN nu q ON q.frame_idx = hj.frame_idx AND q.i = hj.j),
    mo AS (SELECT stack_id, frame_idx, hyp, a, b, x1 - a * x0 + b * y0 tx, y1 - b * x0 - a * y0 ty FROM (SELECT *, (dx * du + dy * dv) / (dx * dx + dy * dy) a, (dx * dv - dy * du) / (dx * dx + dy * dy) b FROM tw WHERE dx * dx + dy * dy > 0)),
    tr AS (SELECT mo.*, round(sqrt(pow(a * x0 - b * y0 + tx - x1, 2) + pow(b * x0 + a * y0 + ty - y1, 2)), 6) e FROM mo JOIN m USING (stack_id, frame_idx)),
    sc AS (SELECT stack_id, frame_idx, hyp, a, b, tx, ty, count(*) FILTER (e <= 3) score FROM tr GROUP BY ALL),
    be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame_idx ORDER BY score DESC, hyp) rk FROM sc) WHERE rk = 1),
    inl AS (SELECT m.* FROM m JOIN be USING (stack_id, frame_idx) WHERE round(sqrt(pow(a * x0 - b * y0 + tx - x1, 2) + pow(b * x0 + a * y0 + ty - y1, 2)), 6) <= 3)"""


@query(f"WITH {o.SQL_MATCHES}, {_RANSAC}, {_FIT.replace('SRC', 'inl')} SELECT stack_id, frame_idx, {_FITOUT}, n::BIGINT n_inliers FROM ab")
def J11_robust_fit(s, d):
    fitted = align.robust_fit(fx.matches(s, d))
    return fitted.select("stack_id", "frame_idx", *_flat(fitted), "n_inliers")


_LMEDS = _RANSAC.replace("count(*) FILTER (e <= 3) score", "-quantile_cont(e, 0.5) score")


@query(f"WITH {o.SQL_MATCHES}, {_LMEDS}, {_FIT.replace('SRC', 'inl')} SELECT stack_id, frame_idx, {_FITOUT}, n::BIGINT n_inliers FROM ab")
def J11_robust_fit_lmeds(s, d):
    fitted = align.robust_fit(fx.matches(s, d), method="LMEDS")
    return fitted.select("stack_id", "frame_idx", *_flat(fitted), "n_inliers")


_TRUE = "SELECT DISTINCT stack_id, frame_idx, 1 + frame_idx / 64.0::DOUBLE a, frame_idx / 32.0::DOUBLE b, (3 * frame_idx)::DOUBLE tx, (-2 * frame_idx)::DOUBLE ty FROM m"


@query(f"""WITH {o.SQL_MATCHES}, tm AS ({_TRUE}), er AS (SELECT m.stack_id, m.frame_idx, round(sqrt(pow(a * x0 - b * y0 + tx - x1, 2) + pow(b * x0 + a * y0 + ty - y1, 2)), 6) e FROM m JOIN tm USING (stack_id, frame_idx)),
    st AS (SELECT stack_id, frame_idx, count(*) FILTER (e <= 3) / count(*) inlier_share, avg(e) FILTER (e <= 3) / sqrt(count(*) FILTER (e <= 3)) * 2 avg_error, max(e) FILTER (e <= 3) * 2 max_error FROM er GROUP BY ALL)
    SELECT stack_id, frame_idx, round(inlier_share, 6) inlier_share, round(avg_error, 6) avg_error, round(max_error, 6) max_error,
           CASE WHEN avg_error IS NULL THEN 'FAILED' WHEN inlier_share >= 0.75 AND avg_error <= 1 AND max_error <= 30 THEN 'GOOD' ELSE 'POOR' END status FROM st""")
def A23_fit_quality(s, d):
    m = fx.matches(s, d)
    a, b = "1 + frame_idx / 64D", "frame_idx / 32D"
    true = m.select("stack_id", "frame_idx").distinct().selectExpr("*", f"array({a}, -({b}), CAST(3 * frame_idx AS DOUBLE), {b}, {a}, CAST(-2 * frame_idx AS DOUBLE), 0D, 0D, 1D) m")
    return _rounded(align.fit_quality(m, true, 2), "inlier_share", "avg_error", "max_error")


_PICK4 = """h4 AS (SELECT fr.*, h.range hyp, (h.range * 7919 + 104729) % n i0, (h.range * 5477 + 7001) % n i2, (h.range * 4337 + 3083) % n i3 FROM fr, range(0, 256) h),
    p4 AS (SELECT *, (i0 + 1 + (hyp * 6101 + 15485) % (n - 1)) % n i1 FROM h4), q4 AS MATERIALIZED (SELECT * FROM p4 WHERE len(list_distinct([i0, i1, i2, i3])) = 4),
    """ + ", ".join(
    f"""j{k} AS MATERIALIZED (SELECT t.*, nu.x0 x0_{k}, nu.y0 y0_{k}, nu.x1 x1_{k}, nu.y1 y1_{k} FROM {f'j{k - 1}' if k else 'q4'} t
        JOIN nu ON nu.stack_id = t.stack_id AND nu.frame_idx = t.frame_idx AND nu.i = t.i{k})""" for k in range(4))


def _base_sql(x: str, y: str, out: str) -> str:
    """Areas of the triangles of four points, as columns: without the first, the second, the third, the fourth."""
    area = lambda a, b, c: f"(({x}_{b} - {x}_{a}) * ({y}_{c} - {y}_{a}) - ({x}_{c} - {x}_{a}) * ({y}_{b} - {y}_{a}))"
    return f"{area(3, 1, 2)} {out}0, {area(0, 3, 2)} {out}1, {area(0, 1, 3)} {out}2, {area(0, 1, 2)} {out}3"


def _four_sql() -> str:
    a = [[f"(s{k} * x0_{k})" for k in range(3)], [f"(s{k} * y0_{k})" for k in range(3)], [f"s{k}" for k in range(3)]]
    b = [[f"(t{k} * x1_{k})" for k in range(3)], [f"(t{k} * y1_{k})" for k in range(3)], [f"t{k}" for k in range(3)]]
    ways = [(1, 2), (2, 0), (0, 1)]
    adj = [[f"({a[r0][c0]} * {a[r1][c1]} - {a[r0][c1]} * {a[r1][c0]})" for r0, r1 in ways] for c0, c1 in ways]
    m = ", ".join(" + ".join(f"{b[i][k]} * {adj[k][j]}" for k in range(3)) + f" m{3 * i + j}" for i in range(3) for j in range(3))
    return f"""a4 AS (SELECT *, {_base_sql('x0', 'y0', 's')}, {_base_sql('x1', 'y1', 't')} FROM j3),
        m4 AS (SELECT stack_id, frame_idx, hyp, {m} FROM a4 WHERE {' AND '.join(f'abs({c}{k}) > 1e-6' for c in 'st' for k in range(4))}),
        n4 AS MATERIALIZED (SELECT stack_id, frame_idx, hyp, {', '.join(f'm{k} / m8 m{k}' for k in range(9))} FROM m4),
        e4 AS (SELECT stack_id, frame_idx, hyp, round(sqrt(pow((m0 * x0 + m1 * y0 + m2) / (m6 * x0 + m7 * y0 + m8) - x1, 2) + pow((m3 * x0 + m4 * y0 + m5) / (m6 * x0 + m7 * y0 + m8) - y1, 2)), 6) e FROM n4 JOIN m USING (stack_id, frame_idx)),
        k4 AS (SELECT stack_id, frame_idx, hyp, count(*) FILTER (e <= 3) n_inliers FROM e4 GROUP BY ALL), c4 AS (SELECT * FROM n4 JOIN k4 USING (stack_id, frame_idx, hyp))"""


@query(f"WITH {o.SQL_MATCHES}, {_RANSAC.split(', hy AS')[0]}, {_PICK4}, {_four_sql()} SELECT stack_id, frame_idx, {', '.join(f'round(m{k}, 6) + 0.0::DOUBLE m{k}' for k in range(9))}, n_inliers FROM c4 "
       "QUALIFY row_number() OVER (PARTITION BY stack_id, frame_idx ORDER BY n_inliers DESC, hyp) = 1")
def J11_robust_homography(s, d):
    """Outliers are left in: the fit to the inliers is the true transform, as is the best of 256 samples."""
    fitted = align.robust_fit(fx.matches(s, d), kind="homography")
    return fitted.select("stack_id", "frame_idx", *((F.round(F.col("m")[i], 6) + 0.0).alias(f"m{i}") for i in range(9)), "n_inliers")


@query()
def G7_homography_fit(s, d):
    fitted = align.homography_fit(fx.matches(s, d).filter("(kp_id div 5) % 4 <> 0"))
    return fitted.select("stack_id", "frame_idx", *(F.round(F.col("m")[i], 4).alias(f"m{i}") for i in range(9)))


@query()
def A25_phase_shift(s, d):
    """Each of the ten frames against itself moved by 5 columns and 2 rows."""
    px = _gray(s, d).select(F.col("frame_idx").alias("stack_id"), F.lit(0).cast("long").alias("frame_idx"), "y", "x", "h", "w", "v")
    moved = px.withColumns({"frame_idx": F.lit(1).cast("long"), "y": (F.col("y") + 2) % F.col("h"), "x": (F.col("x") + 5) % F.col("w")})
    pairs = px.select("stack_id", "frame_idx", F.lit(1).cast("long").alias("target_idx")).distinct()
    return _rounded(align.phase_shift(px.unionByName(moved).select(*PX, "v"), pairs), "dx", "dy", "scale", digits=3)


_WARPM = "frame_idx / 16.0::DOUBLE"
_INV = f"""SELECT *, x - (1.25::DOUBLE + {_WARPM}) u, y + (0.5::DOUBLE + {_WARPM}) v FROM pz"""


def _shifts(px):
    return px.select("stack_id", "frame_idx").distinct().selectExpr("*", "array(1D, 0D, 1.25D + frame_idx / 16D, 0D, 1D, -0.5D - frame_idx / 16D, 0D, 0D, 1D) m")


_WARP = f"""q AS ({_INV}), t4 AS (SELECT stack_id, frame_idx, y ty, x tx, h, w, floor(v)::BIGINT + j sy, floor(u)::BIGINT + i sx,
      CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END wt FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(j, i)),
    wp AS (SELECT t4.stack_id, t4.frame_idx, ty y, tx x, {', '.join(f'floor(round(sum({c} * wt), 6))::BIGINT {c}' for c in 'bgr')} FROM t4 JOIN px p ON p.stack_id = t4.stack_id AND p.frame_idx = t4.frame_idx
      AND p.y = greatest(0, least(sy, h - 1)) AND p.x = greatest(0, least(sx, w - 1)) GROUP BY ALL)"""


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED}, {_WARP} SELECT * FROM wp")
def J10_warp(s, d):
    px = with_size(fx.pixels(s, d))
    return align.warp(px, _shifts(px)).select(*PX, "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED}, {_WARP.replace('sum(b * wt)', 'sum(CASE WHEN out_ THEN 7 ELSE b END * wt)').replace('sum(g * wt)', 'sum(CASE WHEN out_ THEN 7 ELSE g END * wt)').replace('sum(r * wt)', 'sum(CASE WHEN out_ THEN 7 ELSE r END * wt)').replace('FROM t4 JOIN', 'FROM (SELECT *, sy < 0 OR sx < 0 OR sy >= h OR sx >= w out_ FROM t4) t4 JOIN')} SELECT * FROM wp")
def J10_warp_constant_border(s, d):
    px = with_size(fx.pixels(s, d))
    return align.warp(px, _shifts(px), "CONSTANT", 7).select(*PX, "b", "g", "r")


_BLURRED = ", ".join(f"CASE WHEN out_ THEN floor(round(s{c}, 6))::BIGINT ELSE {c} END {c}" for c in "bgr")


@query(f"WITH {o.SQL_PIXELS}, {o.SIZED}, {_WARP.replace('FROM t4 JOIN', ', max(sy < 0 OR sx < 0 OR sy >= h OR sx >= w) out_, max(t4.h) h, max(t4.w) w FROM t4 JOIN')}, "
       f"{o.conv('wp', 'c', {f's{c}': f'b.{c}' for c in 'bgr'}, gaussian_taps(50.0, 21), keep=('b', 'g', 'r', 'out_'))} SELECT {o._PX4}, {_BLURRED} FROM c")
def J10_warp_blurred_border(s, d):
    px = with_size(fx.pixels(s, d))
    return align.blur_outside(with_size(align.warp(px, _shifts(px), "REPLICATE_BLUR"))).select(*PX, "b", "g", "r")


def _chain(f, refs):
    pairs = align.pair_frames(f, refs, 2).filter("NOT (delta = 1 AND frame_idx % 7 = 3) AND NOT (frame_idx % 490 = 3)")
    m = "array(1D, 0D, CAST(frame_idx AS DOUBLE), 0D, 1D, CAST(-target_idx AS DOUBLE), 0D, 0D, 1D) m"
    return align.choose_pairs(pairs.drop("delta").withColumn("delta", F.abs(F.col("frame_idx") - F.col("target_idx"))), pairs.selectExpr("stack_id", "frame_idx", "target_idx", m))


_CHAIN = f"""{o.FR.replace("files)", "files) ")}, rf AS (SELECT stack_id, count(*) // 2 ref_idx FROM frames GROUP BY 1),
    cd AS (SELECT f.stack_id, f.frame_idx, ref_idx, f.frame_idx + sign(ref_idx - f.frame_idx)::BIGINT * d.delta target_idx, d.delta FROM frames f JOIN rf USING (stack_id), (VALUES (1), (2)) d(delta) WHERE f.frame_idx <> ref_idx AND d.delta <= abs(ref_idx - f.frame_idx)),
    ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame_idx ORDER BY delta) rk FROM cd WHERE NOT (delta = 1 AND frame_idx % 7 = 3) AND NOT (frame_idx % 490 = 3)) WHERE rk = 1),
    walk AS (SELECT stack_id, ref_idx frame_idx, 0.0::DOUBLE tx, 0.0::DOUBLE ty FROM rf UNION ALL SELECT ch.stack_id, ch.frame_idx, walk.tx + ch.frame_idx, walk.ty - ch.target_idx FROM walk JOIN ch ON ch.stack_id = walk.stack_id AND ch.target_idx = walk.frame_idx)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT stack_id, frame_idx, tx, ty FROM walk")
def W10_compose_chain(s, d):
    f = _frames(s, d)
    refs = src.resolve_reference(f)
    return align.compose_chain(_chain(f, refs), refs).select("stack_id", "frame_idx", F.col("m")[2].alias("tx"), F.col("m")[5].alias("ty"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stack_id, frame_idx, path FROM frames ANTI JOIN walk USING (stack_id, frame_idx)")
def J13_without_transform(s, d):
    f = _frames(s, d)
    refs = src.resolve_reference(f)
    return align.without_transform(f, align.compose_chain(_chain(f, refs), refs)).select("stack_id", "frame_idx", "path")


@query()
def K7_align_frames(s, d):
    """All ten frames, each followed by itself moved by a known shift: frame 2 i + 1 is frame 2 i moved."""
    px = _gray(s, d).withColumnsRenamed({"stack_id": "one", "frame_idx": "stack_id"}).drop("one")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("frame_idx")
    moved = px.select("stack_id", "h", "w", "v", "y", "x", copies)
    moved = moved.withColumns({"y": (F.col("y") + 2 * F.col("frame_idx")) % F.col("h"), "x": (F.col("x") + 3 * F.col("frame_idx")) % F.col("w")})
    rows = moved.select(*PX, *(F.col("v").alias(c) for c in "bgr"))
    found = stack.align_stack(rows, src.resolve_reference(rows.select("stack_id", "frame_idx").distinct()), border="REPLICATE")[1]
    return found.select("stack_id", "frame_idx", *(F.round(F.col("m")[i], 3).alias(f"m{i}") for i in range(6)))


@query()
def K8_keypoints(s, d):
    return align.detect_keypoints(_gray(s, d), 40).select("stack_id", "frame_idx", "kp_id", "y", "x", "bits")


# ---- geometry -------------------------------------------------------------------------------------------------

_TSQL = """tf AS (SELECT p_partkey, 1 + (p_partkey % 21 - 10) / 100.0::DOUBLE a, (p_partkey % 13 - 6) / 60.0::DOUBLE b, (p_partkey % 401 - 200)::DOUBLE tx,
    -(p_partkey % 13 - 6) / 55.0::DOUBLE c, 1 + (p_partkey % 17 - 8) / 90.0::DOUBLE d, (p_partkey % 301 - 150)::DOUBLE ty, (p_partkey % 11 - 5) / 40000.0::DOUBLE g, (p_partkey % 7 - 3) / 40000.0::DOUBLE h FROM part)"""


def _transforms(s, d, projective=False):
    g, h = ("(p_partkey % 11 - 5) / 40000D", "(p_partkey % 7 - 3) / 40000D") if projective else ("0D", "0D")
    return fx.table(s, d, "part").selectExpr("p_partkey", f"""array(1 + (p_partkey % 21 - 10) / 100D, (p_partkey % 13 - 6) / 60D, CAST(p_partkey % 401 - 200 AS DOUBLE),
        -(p_partkey % 13 - 6) / 55D, 1 + (p_partkey % 17 - 8) / 90D, CAST(p_partkey % 301 - 150 AS DOUBLE), {g}, {h}, 1D) m""")


_DEC = """dc AS (SELECT *, sqrt(a * a + b * b) sx, sqrt(c * c + d * d) sy, degrees(atan2(b, a)) rotation, degrees(atan2(-c, d)) - degrees(atan2(b, a)) sh FROM tf),
    de AS (SELECT *, (sh + 180) - 360 * floor((sh + 180) / 360) - 180 shear FROM dc)"""


@query(f"WITH {_TSQL}, {_DEC} SELECT p_partkey, round(sx, 6) sx, round(sy, 6) sy, round(rotation, 6) rotation, round(shear, 6) shear, tx, ty FROM de")
def G1_decompose_affine(s, d):
    t = _transforms(s, d).select("p_partkey", geometry.decompose_affine("m").alias("p")).select("p_partkey", "p.*")
    return _rounded(t, "sx", "sy", "rotation", "shear")


@query(f"""WITH {_TSQL}, {_DEC} SELECT p_partkey, concat_ws('; ', CASE WHEN abs(rotation) > 10 THEN 'rotation' END, CASE WHEN sx < 0.9 OR sx > 1.1 THEN 'x-scale' END,
    CASE WHEN sy < 0.9 OR sy > 1.1 THEN 'y-scale' END, CASE WHEN abs(shear) > 5 THEN 'shear' END, CASE WHEN abs(tx) > 2000 * 0.1 THEN 'x-translation' END,
    CASE WHEN abs(ty) > 1300 * 0.1 THEN 'y-translation' END) reasons FROM de""")
def G2_check_affine(s, d):
    return _transforms(s, d).select("p_partkey", geometry.check_affine("m", 1300.0, 2000.0).alias("reasons"))


_CORNERS = """co AS (SELECT p_partkey, i, (a * X + b * Y + tx) / (g * X + h * Y + 1) px, (c * X + d * Y + ty) / (g * X + h * Y + 1) py FROM tf, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 2000.0::DOUBLE, 0.0::DOUBLE), (2, 2000.0::DOUBLE, 1300.0::DOUBLE), (3, 0.0::DOUBLE, 1300.0::DOUBLE)) q(i, X, Y)),
    ed AS (SELECT a.p_partkey, a.i, a.px, a.py, b.px qx, b.py qy, c.px rx, c.py ry FROM co a JOIN co b ON b.p_partkey = a.p_partkey AND b.i = (a.i + 1) % 4 JOIN co c ON c.p_partkey = a.p_partkey AND c.i = (a.i + 3) % 4),
    an AS (SELECT p_partkey, abs(sum(px * qy - qx * py)) / 2 / (2000.0::DOUBLE * 1300) ratio, max(abs(degrees(acos(greatest(-1, least(1, ((rx - px) * (qx - px) + (ry - py) * (qy - py)) / sqrt((pow(rx - px, 2) + pow(ry - py, 2)) * (pow(qx - px, 2) + pow(qy - py, 2))))))) - 90)) angle FROM ed GROUP BY 1),
    bx AS (SELECT e.p_partkey, e.i, max((p.px * (qx - e.px) + p.py * (qy - e.py)) / n) - min((p.px * (qx - e.px) + p.py * (qy - e.py)) / n) s, max((p.py * (qx - e.px) - p.px * (qy - e.py)) / n) - min((p.py * (qx - e.px) - p.px * (qy - e.py)) / n) t
      FROM (SELECT *, sqrt(pow(qx - px, 2) + pow(qy - py, 2)) n FROM ed) e JOIN co p ON p.p_partkey = e.p_partkey GROUP BY ALL),
    asp AS (SELECT p_partkey, min((round(s * t, 6), greatest(s, t) / least(s, t))) z FROM bx GROUP BY 1)"""


@query(f"""WITH {_TSQL}, {_CORNERS}, fin AS (SELECT p_partkey, ratio area_ratio, z[2] aspect, angle FROM an JOIN asp USING (p_partkey))
    SELECT p_partkey, round(area_ratio, 5) area_ratio, round(aspect, 6) aspect, round(angle, 6) angle,
           concat_ws('; ', CASE WHEN area_ratio > 1.5 OR area_ratio < 1 / 1.5 THEN 'area' END, CASE WHEN aspect > 2 THEN 'aspect' END, CASE WHEN angle > 10 THEN 'angle' END) reasons FROM fin""")
def G3_check_homography(s, d):
    t = _transforms(s, d, True).select("p_partkey", geometry.check_homography("m", 1300.0, 2000.0).alias("p")).select("p_partkey", "p.*")
    return _rounded(_rounded(t, "aspect", "angle"), "area_ratio", digits=5)


@query(f"WITH {_TSQL} SELECT p_partkey, round(0.5 * a - 0.25 * c, 6) m0, round(0.5 * b - 0.25 * d, 6) m1, round(0.5 * tx - 0.25 * ty + 7, 6) m2, round(0.25 * a + 0.5 * c, 6) m3, round(0.25 * b + 0.5 * d, 6) m4, round(0.25 * tx + 0.5 * ty - 3, 6) m5 FROM tf")
def G4_compose(s, d):
    then = F.array(*map(F.lit, (0.5, -0.25, 7.0, 0.25, 0.5, -3.0, 0.0, 0.0, 1.0)))
    t = _transforms(s, d).select("p_partkey", geometry.compose("m", then).alias("m"))
    return t.select("p_partkey", *(F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(6)))


@query(f"WITH {_TSQL} SELECT p_partkey, round(tx * 4, 6) rigid_tx, round(ty * 4, 6) rigid_ty, round(tx * 4, 6) tx, round(g / 4, 9) g, round(h / 4, 9) h FROM tf")
def G5_rescale_transform(s, d):
    t = _transforms(s, d, True).select("p_partkey", geometry.rescale_transform("m", 4).alias("r"), geometry.rescale_transform("m", 4, "homography").alias("q"))
    return t.select("p_partkey", F.round(F.col("r")[2], 6).alias("rigid_tx"), F.round(F.col("r")[5], 6).alias("rigid_ty"), F.round(F.col("q")[2], 6).alias("tx"), F.round(F.col("q")[6], 9).alias("g"), F.round(F.col("q")[7], 9).alias("h"))


# ---- metadata and retouching ----------------------------------------------------------------------------------


def _xmp(s, d):
    return fx.exif_texts(s, d).select("file_key", F.expr("""concat('exif:FNumber="', fnum, '/10" exif:ISOSpeedRatings="', iso, '" <exif:ExposureTime>1/', den, '</exif:ExposureTime> exif:DateTimeOriginal="', day, 'T10:20:30"')""").alias("xmp"))


@query(f"WITH {o.SQL_EXIF}, {o.PARSED} SELECT * FROM parsed")
def D1_parse_xmp(s, d):
    return metadata.parse_xmp(_xmp(s, d), "file_key")


@query(f"""WITH {o.SQL_EXIF} SELECT file_key, 'FNumber' field, CASE WHEN den % 3 = 0 THEN fnum || '/10' WHEN den % 3 = 1 THEN (fnum / 10.0::DOUBLE)::VARCHAR ELSE '0.0' END AS "value",
    CASE WHEN den % 3 = 0 THEN fnum END num, CASE WHEN den % 3 = 0 THEN 10 END den FROM texts""")
def D2_typed_value(s, d):
    raw = F.expr("CASE WHEN den % 3 = 0 THEN concat(fnum, '/10') WHEN den % 3 = 1 THEN CAST(fnum / 10D AS STRING) ELSE 'fast' END")
    return fx.exif_texts(s, d).select("file_key", F.lit("FNumber").alias("field"), raw.alias("raw")).select("file_key", "field", *metadata.typed_value(F.col("field"), F.col("raw")))


_TYPED = """CASE den % 5 WHEN 0 THEN 'RATIONAL:1/' || den WHEN 1 THEN 'INT:' || iso WHEN 2 THEN 'ARRAY:' || iso || ', ' || fnum WHEN 3 THEN 'STRING:a:b' ELSE 'plain' END"""


@query(f"""WITH {o.SQL_EXIF} SELECT file_key, CASE den % 5 WHEN 0 THEN 'RATIONAL' WHEN 1 THEN 'INT' WHEN 2 THEN 'ARRAY' WHEN 3 THEN 'STRING' ELSE 'TEXT' END kind,
    CASE den % 5 WHEN 0 THEN '1/' || den WHEN 1 THEN iso::VARCHAR WHEN 2 THEN iso || ', ' || fnum WHEN 3 THEN 'a:b' ELSE 'plain' END AS "value",
    CASE WHEN den % 5 = 0 THEN den END den, CASE WHEN den % 5 = 2 THEN iso || '|' || fnum END items FROM texts""")
def D3_parse_typed_text(s, d):
    text = F.expr(_TYPED)
    t = fx.exif_texts(s, d).select("file_key", metadata.parse_typed_text(text).alias("p"))
    return t.select("file_key", "p.kind", "p.value", "p.den", F.array_join("p.items", "|").alias("items"))


@query(f"""WITH {o.SQL_EXIF}, tg AS (SELECT file_key, CASE den % 5 WHEN 0 THEN 'PNG_EXIF_Make' WHEN 1 THEN 'EXIF_Model' WHEN 2 THEN 'PNG_gamma' WHEN 3 THEN '33437' ELSE '99999' END tag FROM texts)
    SELECT file_key, tag, CASE tag WHEN 'PNG_EXIF_Make' THEN 'Make' WHEN 'EXIF_Model' THEN 'Model' WHEN '33437' THEN 'FNumber' ELSE tag END tag_name FROM tg WHERE tag <> 'PNG_gamma'""")
def D4_normalize_tags(s, d):
    tag = F.expr("CASE den % 5 WHEN 0 THEN 'PNG_EXIF_Make' WHEN 1 THEN 'EXIF_Model' WHEN 2 THEN 'PNG_gamma' WHEN 3 THEN '33437' ELSE '99999' END")
    return metadata.normalize_tags(fx.exif_texts(s, d).select("file_key", tag.alias("tag")))


@query(f"""WITH {o.SQL_EXIF}, {o.PARSED} SELECT p.file_key, p.field, CASE p.field WHEN 'FNumber' THEN 'f/' || printf('%.1f', t.fnum / 10.0::DOUBLE) WHEN 'ISOSpeedRatings' THEN 'ISO ' || t.iso
    WHEN 'ExposureTime' THEN CASE WHEN 1 / t.den::DOUBLE >= 0.5 THEN printf('%.1f', 1 / t.den::DOUBLE) || ' s' ELSE '1/' || t.den || ' s' END
    ELSE split_part(t."day", '-', 3) || '/' || split_part(t."day", '-', 2) || '/' || split_part(t."day", '-', 1) || ' 10:20:30' END shown FROM parsed p JOIN texts t USING (file_key)""")
def D5_format_value(s, d):
    p = metadata.parse_xmp(_xmp(s, d), "file_key")
    return p.select("file_key", "field", metadata.format_value(F.col("field"), F.col("value"), F.col("num"), F.col("den")).alias("shown"))


@query(f"""WITH {o.FR}, fe AS (SELECT *, first_value(ext) OVER (PARTITION BY stack_id ORDER BY path) want FROM frames), rk AS (SELECT *, CASE WHEN ext = want THEN 0 WHEN ext <> 'cr2' THEN 1 ELSE 2 END k FROM fe)
    SELECT stack_id, path FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY k, path) r FROM rk) WHERE r = 1""")
def J12_choose_metadata_source(s, d):
    return metadata.choose_metadata_source(_frames(s, d), src.EXTENSIONS["raw"])


@query(f"""WITH {o.FR}, fe AS (SELECT *, first_value(ext) OVER (PARTITION BY stack_id ORDER BY path) want FROM frames), rk AS (SELECT *, CASE WHEN ext = want THEN 0 WHEN ext <> 'cr2' THEN 1 ELSE 2 END k FROM fe),
    c AS (SELECT stack_id, file_key FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY k, path) r FROM rk) WHERE r = 1), {o.SQL_EXIF}, {o.PARSED}
    SELECT c.stack_id, field, "value" FROM c JOIN parsed USING (file_key)""")
def D6_inherit_metadata(s, d):
    f = _frames(s, d)
    meta = metadata.parse_xmp(_xmp(s, d), "file_key").join(f.select("file_key", "path"), "file_key").select("path", "field", "value")
    out = f.select("stack_id").distinct()
    return metadata.inherit_metadata(out, metadata.choose_metadata_source(f, src.EXTENSIONS["raw"]), meta).select("stack_id", "field", "value")


_STROKES = "st AS (SELECT p_partkey % 2 stack_id, p_partkey % 25 cx, (p_partkey * 7) % 50 cy, 1 + p_partkey % 3 radius FROM part)"
_PROFILE = "0.5 * (cos(pi() * pow(least(f, 1.0), 2.0::DOUBLE)) + 1)"


@query(f"""WITH {o.SQL_PIXELS}, {_STROKES}, cv AS (SELECT stack_id, cy + dy.range y, cx + dx.range x, sqrt((dx.range * dx.range + dy.range * dy.range)::DOUBLE) / (radius + 0.5::DOUBLE) f FROM st, range(-3, 4) dy, range(-3, 4) dx WHERE abs(dy.range) <= radius AND abs(dx.range) <= radius),
    mk AS (SELECT stack_id, y, x, least(1.0::DOUBLE, sum({_PROFILE} * 0.8 * 0.1)) m FROM cv WHERE {_PROFILE} > 0 GROUP BY ALL),
    ms AS (SELECT * FROM px WHERE frame_idx = 0), so AS (SELECT * FROM px WHERE frame_idx = 1)
    SELECT ms.stack_id, ms.y, ms.x, {', '.join(f'CASE WHEN m IS NULL THEN ms.{c} ELSE floor(round(greatest(0, least(ms.{c} * (1 - m * 0.8) + so.{c} * (m * 0.8), 255)), 6))::BIGINT END {c}' for c in 'bgr')}
    FROM ms JOIN so USING (stack_id, y, x) LEFT JOIN mk USING (stack_id, y, x)""")
def J15_apply_strokes(s, d):
    px = fx.pixels(s, d)
    strokes = fx.table(s, d, "part").selectExpr("p_partkey % 2 stack_id", "p_partkey % 25 x", "(p_partkey * 7) % 50 y", "1 + p_partkey % 3 radius", "1L layer_idx")
    master = px.filter("frame_idx = 0").drop("frame_idx")
    done = layers.apply_strokes(master, px.withColumnRenamed("frame_idx", "layer_idx"), strokes, hardness=0.5, opacity=0.8, flow=0.1)
    return done.select("stack_id", "y", "x", "b", "g", "r")


@query()
def K9_stack_pipeline(s, d):
    """Noise, vignetting, alignment, balancing, fusion with all its levels, denoising, tone mapping and sharpening."""
    px = fx.sharp_pixels(s, d)
    h, w = px.agg(F.max("y") + 1, F.max("x") + 1).first()
    refs = _refs(px)
    steps = [stack.mask_noise(20, method="rgb"), stack.correct_vignette(20), stack.auto_aligned(refs, limits="large"), stack.balanced(refs)]
    fuse = lambda p: pyramid.focus_stack_pyramid(p, pyramid.levels_for(h, w, 8))
    return stack.stack_job(px, refs, steps, fuse, [stack.denoised(), stack.tone_mapped(), stack.sharpened()]).select("stack_id", "y", "x", "b", "g", "r")


@query(f"WITH {o.SQL_PIXELS} SELECT stack_id, frame_idx, max(b)::BIGINT peak FROM px GROUP BY ALL")
def K9_map_frames(s, d):
    import pandas as pd

    peak = lambda pdf: pd.DataFrame({"stack_id": pdf["stack_id"].iloc[:1], "frame_idx": pdf["frame_idx"].iloc[:1], "peak": [pdf["b"].max()]})
    return filters.map_frames(fx.pixels(s, d), peak, "stack_id long, frame_idx long, peak long")
