"""Frame catalogs: listing, numbering, validation, decoded pixels and output names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tiles
from .scratch import TILE_ROWS

#: File extensions that are images, by kind.
EXTENSIONS = {
    "tif": ["tif", "tiff"],
    "jpg": ["jpg", "jpeg"],
    "png": ["png"],
    "raw": ["arw", "cr2", "cr3", "dng", "nef", "orf", "pef", "raf", "raw", "rw2", "srw"],
    "pdf": ["pdf"],
}
IMAGES = ("tif", "jpg", "png", "raw")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def has_kind(path: Column | str, *kinds: str) -> Column:
    return extension(path).isin([e for k in kinds for e in EXTENSIONS[k]])


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Paths and lengths of all files below the given folders; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", "length")


def scan_catalog(files: DataFrame, every: int = 1, reverse: bool = False, source_order: str | None = None) -> DataFrame:
    """``files(path, ...)`` to frames: images only, sorted within each directory, every n-th kept, then numbered.

    ``frame_idx`` runs over the directories of a stack in the order of ``source_order`` (by default by name).
    """
    directory = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    stack = ["stack_id"] if "stack_id" in files.columns else []
    images = files.filter(has_kind("path", *IMAGES)).withColumns({"dir": directory, "ext": extension("path")})
    way = F.col("path").desc() if reverse else F.col("path").asc()
    ranked = images.withColumn("rank", F.row_number().over(Window.partitionBy(*stack, "dir").orderBy(way)) - 1)
    kept = ranked.filter(F.col("rank") % every == 0)
    order = Window.partitionBy(*stack).orderBy(source_order or "dir", "rank")
    return kept.withColumn("frame_idx", F.row_number().over(order) - 1).drop("rank")


def scan_filelist(names: DataFrame, root: str) -> DataFrame:
    """An explicit list of files, sorted; relative names are joined to ``root``."""
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", F.lit(root), "path"))
    named = names.withColumn("path", full)
    return named.withColumn("frame_idx", F.row_number().over(Window.partitionBy("stack_id").orderBy("path")) - 1)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """8-bit pixels of JPEG and PNG files: ``path, y, x, b, g, r``; gray files have three equal channels.

    Files that are no images are left out. Deeper images come as Parquet (``read_pixels``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                origin, h, w, n, data = (batch.column(k)[at].as_py() for k in range(5))
                image = np.frombuffer(data, np.uint8).reshape(h, w, n)
                channels = [image[..., k if n >= 3 else 0] for k in range(3)]
                for lo in range(0, h, rows := max(1, (1 << 16) // max(1, w))):  # a stretch of rows at a time
                    y, x = np.mgrid[lo : min(h, lo + rows), 0:w]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(origin, y.size), pa.array(y.ravel(), pa.int64()), pa.array(x.ravel(), pa.int64())]
                        + [pa.array(c[lo : lo + rows].ravel().astype(np.int64)) for c in channels],
                        ["path", "y", "x", "b", "g", "r"],
                    )

    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    source = image.select("origin", "height", "width", "nChannels", "data")
    return source.mapInArrow(run, "path string, y long, x long, b long, g long, r long")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_frames`` wrote, or any such table of pixels."""
    return spark.read.parquet(path)


def write_tiles(px: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pixel rows as tile rows (see ``operators.tiles``): a row holds a square of a frame."""
    tiles.pack_tiles(tiles.sized(px)).write.mode(mode).options(**TILE_ROWS).parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tiles`` wrote: fusion takes it as it is, ``tiles.unpack_tiles`` gives pixel rows."""
    return spark.read.parquet(path)


def sorted_frames(frames: DataFrame) -> DataFrame:
    """By stack and path; the sort is by ranges, so no task holds all frames."""
    return frames.orderBy("stack_id", "path")


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") < n)


def without_reference(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """Frames but for their stacks' reference frames."""
    ref = refs.select("stack_id", F.col("ref_idx").alias("frame_idx"))
    return frames.select("stack_id", "frame_idx").join(ref, ["stack_id", "frame_idx"], "left_anti")


def by_distance(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``rank``: frames of a stack from its reference outwards, of two as far the first."""
    order = Window.partitionBy("stack_id").orderBy(F.abs(F.col("frame_idx") - F.col("ref_idx")), "frame_idx")
    return frames.join(refs, "stack_id").withColumn("rank", F.row_number().over(order))


def output_names(frames: DataFrame, prefix: str = "stack_", algorithm: str | None = None) -> DataFrame:
    """Adds ``out_name``: prefix, file stem, a mark of the fusion, and the extension (raw files become tif)."""
    mark = {"pyramid": "_pyram", "depthmap": "_depmp"}.get(algorithm or "", "")
    stem = F.regexp_extract("path", r"([^/]*?)\.[^./]+$", 1)
    ext = F.when(has_kind("path", "raw"), "tif").otherwise(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return frames.withColumn("out_name", F.concat(F.lit(prefix), stem, F.lit(mark + "."), ext))


def write_frames(px: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per stack; ``mode`` overwrite clears an earlier run, append keeps it."""
    px.write.mode(mode).partitionBy("stack_id").parquet(path)


def estimate_bytes(frames: DataFrame, limit: int = 8 << 30) -> DataFrame:
    size = F.col("width").cast("long") * F.col("height") * F.col("channels") * F.expr("bit_depth div 8")
    total = frames.groupBy("stack_id").agg(F.sum(size).alias("bytes"))
    return total.withColumn("over_limit", F.col("bytes") > limit)


def validate_stack(frames: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``status``: ok, shape or depth, against the first frame of the stack; strict raises instead."""
    first = Window.partitionBy("stack_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    want = F.first(F.struct("height", "width", "channels", "bit_depth")).over(first)
    checked = frames.withColumn("want", want)
    shape = (F.col("height") != F.col("want.height")) | (F.col("width") != F.col("want.width"))
    status = F.when(shape | (F.col("channels") != F.col("want.channels")), "shape").when(
        F.col("bit_depth") != F.col("want.bit_depth"), "depth"
    )
    if strict:
        status = F.when(status.isNotNull(), F.raise_error(F.concat(F.lit("bad frame: "), "path"))).otherwise(status)
    return checked.withColumn("status", F.coalesce(status, F.lit("ok"))).drop("want")


def resolve_reference(frames: DataFrame, ref: int = 0) -> DataFrame:
    """(stack_id, ref_idx): 0 is the middle frame, -1 the last, k from 1 the k-th; others are an error."""
    n = frames.groupBy("stack_id").agg(F.count("*").alias("n"))
    out_of_range = F.raise_error(F.concat(F.lit("reference out of range in stack "), F.col("stack_id").cast("string")))
    idx = {0: F.expr("n div 2"), -1: F.col("n") - 1}.get(ref, F.when(F.lit(ref).between(1, F.col("n")), F.lit(ref - 1).cast("long")).otherwise(out_of_range.cast("long")))
    return n.select("stack_id", idx.cast("long").alias("ref_idx"))


def auto_factor(rule: str, height: Column | str = "height", width: Column | str = "width") -> Column:
    """The subsampling factor of an image for balancing, vignetting or alignment."""
    h, w = (F.col(c) if isinstance(c, str) else c for c in (height, width))
    return {
        "balance": 1 + F.floor(h * w / (1 << 20) / 2),
        "vignetting": 1 + F.floor((h / 1000) * (w / 1000) / 2),
        "align": F.sqrt((1 + F.floor((h / 1024) * (w / 1024) / 2)).cast("double")).cast("long"),
    }[rule]


def union_sources(*sources: DataFrame) -> DataFrame:
    """Folders one after the other; ``source_idx`` keeps their order."""
    numbered = [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)]
    out = numbered[0]
    for more in numbered[1:]:
        out = out.unionByName(more)
    return out
