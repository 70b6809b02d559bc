"""Frame tables derived from the given tables by integer arithmetic; they grow with those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Two stacks of four colour frames, 25 pixels wide, from ``events``; ``wide``: 16-bit values."""
    p = table(spark, sf_dir, "events").selectExpr(
        "event_id % 2 stack_id",
        "(event_id div 2) % 4 frame_idx",
        "(event_id div 8) div 25 y",
        "(event_id div 8) % 25 x",
        "CAST(round(value * 100) AS BIGINT) v",
    )
    k = 257 if wide else 1
    return p.selectExpr(
        "stack_id", "frame_idx", "y", "x",
        f"(v * 7 + x * 3) % 256 * {k} b", f"(v * 13 + y * 5) % 256 * {k} g", f"(v * 29 + (x + y) * 11) % 256 * {k} r",
    )


def sharp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stacks over a smooth base; in each band of five rows one known frame holds the detail."""
    base = "(x * 9 + y * 5) % 256"
    sharp = "(y div 5) % 4 = frame_idx"
    return pixels(spark, sf_dir).selectExpr(
        "stack_id", "frame_idx", "y", "x", *(f"CASE WHEN {sharp} THEN {c} ELSE {base} END {c}" for c in "bgr")
    )


def large_pixels(spark: SparkSession, sf_dir: str, scale: int = 11) -> DataFrame:
    """The sharp stacks with every pixel as a square of ``scale`` x ``scale``: frames 275 pixels wide by default."""
    places = [F.explode(F.sequence(F.lit(0), F.lit(scale - 1))).alias(c) for c in ("dy", "dx")]
    spread = sharp_pixels(spark, sf_dir).select("*", places[0]).select("*", places[1])
    return spread.selectExpr("stack_id", "frame_idx", f"y * {scale} + dy y", f"x * {scale} + dx x", "b", "g", "r")


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack of ten gray frames, 64 pixels wide, from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.selectExpr(
        "CAST(0 AS BIGINT) stack_id", "vec_id % 10 frame_idx", "vec_id div 10 y", "CAST(x AS BIGINT) x",
        "least(255L, greatest(0L, floor(128 + 320 * CAST(e AS DOUBLE)))) v",
    )


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten frames of keypoints with 64-component descriptors, and their sign bits as one word."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(
        F.slice("embedding", 1, 62),
        F.lit(0).cast("long"),
        lambda acc, v: acc * 2 + F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
    )
    return e.select(
        F.lit(0).cast("long").alias("stack_id"),
        (F.col("vec_id") % 10).alias("frame_idx"),
        F.expr("vec_id div 10").alias("kp_id"),
        F.col("embedding").alias("desc"),
        bits.alias("bits"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched points of five frames by a known similarity of each; every fourth of a run of five is an outlier."""
    p = table(spark, sf_dir, "part").selectExpr(
        "CAST(0 AS BIGINT) stack_id", "CAST(p_partkey % 5 AS BIGINT) frame_idx", "CAST(p_partkey AS BIGINT) kp_id",
        "CAST(p_partkey % 97 AS DOUBLE) x0", "CAST((p_partkey * 31) % 89 AS DOUBLE) y0",
        "CASE WHEN (p_partkey div 5) % 4 = 0 THEN 40 + p_partkey % 7 ELSE 0 END off",
    )
    a, b = "(1 + frame_idx / 64D)", "(frame_idx / 32D)"
    return p.selectExpr(
        "stack_id", "frame_idx", "kp_id", "x0", "y0",
        f"{a} * x0 - {b} * y0 + 3 * frame_idx + off x1", f"{b} * x0 + {a} * y0 - 2 * frame_idx - off y1",
    )


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of image files of many stacks, some of another size or depth, some not images, from ``orders``."""
    ext = "element_at(array('jpg', 'JPG', 'tif', 'png', 'cr2', 'txt'), CAST(o_orderkey % 6 AS INT) + 1)"
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 20 AS BIGINT) stack_id",
        f"concat('stack_', o_custkey % 20, '/img_', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.', {ext}) path",
        "CASE WHEN o_orderkey % 101 = 0 THEN 1000 ELSE 2000 END width",
        "CASE WHEN o_orderkey % 101 = 0 THEN 650 ELSE 1300 END height",
        "3 channels",
        "CASE WHEN o_orderkey % 103 = 0 THEN 16 ELSE 8 END bit_depth",
        "CAST(o_orderkey AS BIGINT) file_key",
    )


def exif_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata texts of those files: XMP, typed text and raw tags."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) file_key",
        "CAST(o_orderkey % 1000 + 1 AS BIGINT) den",
        "CAST(10 + o_orderkey % 200 AS BIGINT) fnum",
        "CAST(100 * (1 + o_orderkey % 64) AS BIGINT) iso",
        "date_format(o_orderdate, 'yyyy-MM-dd') day",
    )


SQL_PIXELS = """p AS (
    SELECT event_id % 2 stack_id, (event_id // 2) % 4 frame_idx, (event_id // 8) // 25 y, (event_id // 8) % 25 x,
           CAST(round(value * 100) AS BIGINT) v FROM events
), px AS MATERIALIZED (
    SELECT stack_id, frame_idx, y, x, (v * 7 + x * 3) % 256 b, (v * 13 + y * 5) % 256 g, (v * 29 + (x + y) * 11) % 256 r
    FROM p
)"""
SQL_WIDE = SQL_PIXELS.replace("px AS", "px8 AS") + """, px AS (
    SELECT stack_id, frame_idx, y, x, b * 257 b, g * 257 g, r * 257 r FROM px8)"""
SQL_SHARP = SQL_PIXELS.replace("px AS", "px1 AS") + """, px AS (
    SELECT stack_id, frame_idx, y, x,
           CASE WHEN (y // 5) % 4 = frame_idx THEN b ELSE (x * 9 + y * 5) % 256 END b,
           CASE WHEN (y // 5) % 4 = frame_idx THEN g ELSE (x * 9 + y * 5) % 256 END g,
           CASE WHEN (y // 5) % 4 = frame_idx THEN r ELSE (x * 9 + y * 5) % 256 END r FROM px1)"""
SQL_LARGE = SQL_SHARP.replace(" px AS (", " px2 AS (") + """, px AS MATERIALIZED (
    SELECT stack_id, frame_idx, y * 11 + dy.range y, x * 11 + dx.range x, b, g, r FROM px2, range(11) dy, range(11) dx)"""
SQL_GRAY = """gp AS (
    SELECT vec_id % 10 frame_idx, vec_id // 10 y, unnest(generate_series(0, len(embedding) - 1)) x, unnest(embedding) e
    FROM embeddings
), px AS MATERIALIZED (
    SELECT 0::BIGINT stack_id, frame_idx, y, x, CAST(least(255, greatest(0, floor(128 + 320 * e::DOUBLE))) AS BIGINT) v
    FROM gp
)"""
SQL_KEYPOINTS = """kp AS (
    SELECT 0::BIGINT stack_id, vec_id % 10 frame_idx, vec_id // 10 kp_id, embedding AS desc_, embedding[1:62] AS signs
    FROM embeddings
)"""
SQL_MATCHES = """mp AS (
    SELECT 0::BIGINT stack_id, CAST(p_partkey % 5 AS BIGINT) frame_idx, p_partkey::BIGINT kp_id,
           (p_partkey % 97)::DOUBLE x0, ((p_partkey * 31) % 89)::DOUBLE y0,
           CASE WHEN (p_partkey // 5) % 4 = 0 THEN 40 + p_partkey % 7 ELSE 0 END AS shifted FROM part
), m AS (
    SELECT stack_id, frame_idx, kp_id, x0, y0,
           (1 + frame_idx / 64.0::DOUBLE) * x0 - (frame_idx / 32.0::DOUBLE) * y0 + 3 * frame_idx + shifted x1,
           (frame_idx / 32.0::DOUBLE) * x0 + (1 + frame_idx / 64.0::DOUBLE) * y0 - 2 * frame_idx - shifted y1 FROM mp
)"""
SQL_FILES = """files AS (
    SELECT CAST(o_custkey % 20 AS BIGINT) stack_id,
           'stack_' || (o_custkey % 20) || '/img_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.' ||
               (['jpg', 'JPG', 'tif', 'png', 'cr2', 'txt'])[(o_orderkey % 6 + 1)::INT] path,
           CASE WHEN o_orderkey % 101 = 0 THEN 1000 ELSE 2000 END width,
           CASE WHEN o_orderkey % 101 = 0 THEN 650 ELSE 1300 END height, 3 channels,
           CASE WHEN o_orderkey % 103 = 0 THEN 16 ELSE 8 END bit_depth, o_orderkey::BIGINT file_key FROM orders
)"""
SQL_EXIF = """texts AS (
    SELECT o_orderkey::BIGINT file_key, (o_orderkey % 1000 + 1)::BIGINT den, (10 + o_orderkey % 200)::BIGINT fnum,
           (100 * (1 + o_orderkey % 64))::BIGINT iso, strftime(o_orderdate, '%Y-%m-%d') AS "day" FROM orders
)"""
