"""What keeps tables of large frames within memory and time: files, plans and batches, not values."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from framespark.operators import depthmap, pyramid, tiles
from framespark.sources import frames as src
from framespark.sources import scratch

from .test_frames import image, table
from .test_plans import texture

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(files) -> int:
    """Of all row groups of Parquet files, the most rows."""
    metas = [pq.ParquetFile(f).metadata for f in files]
    return max(m.row_group(k).num_rows for m in metas for k in range(m.num_row_groups))


def test_tile_rows_are_written_and_read_a_few_at_a_time(spark, tmp_path):
    """a reader holds a row group of tiles, and a batch on its way to Python."""
    spark.conf.unset(KEY)
    frames = {f: texture(8, 9, f) for f in range(40)}
    src.write_tiles(table(spark, frames), str(tmp_path / "t"))
    assert most_rows(glob.glob(f"{tmp_path}/t/*.parquet")) <= 16
    px = tiles.unpack_tiles(src.read_tiles(spark, str(tmp_path / "t")))
    assert int(spark.conf.get(KEY).rstrip("b")) == tiles.BATCH
    assert np.array_equal(image(px.filter("frame_idx = 7").drop("frame_idx"), (8, 9)), frames[7][..., 0])


def test_a_session_may_set_its_own_batches(spark):
    spark.conf.set(KEY, "16m")
    tiles.in_batches(spark.range(1))
    assert spark.conf.get(KEY) == "16m"
    spark.conf.unset(KEY)


def parts_from(monkeypatch) -> list:
    """What goes to ``parts_of_pixels`` from now on."""
    seen, parts = [], tiles.parts_of_pixels
    monkeypatch.setattr(tiles, "parts_of_pixels", lambda px, *a, **k: seen.append(px) or parts(px, *a, **k))
    return seen


def test_levels_are_worked_out_once_a_stack(spark, monkeypatch):
    """not by a loop over all sizes for each pixel."""
    seen = parts_from(monkeypatch)
    pyramid.focus_stack_pyramid(table(spark, {0: texture(40, 70), 1: texture(40, 70, 2)}))
    assert "lambda" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("shapes", [[(8, 9), (70, 80)], [(8, 9), (7, 7)], [(70, 80), (66, 64)]])
def test_stacks_with_and_without_levels_are_those_alone(spark, shapes):
    stacks = [table(spark, {f: texture(*shape, 5 * k + f) for f in range(3)}).withColumn("stack_id", F.lit(k).cast("long")) for k, shape in enumerate(shapes)]
    both = pyramid.focus_stack_pyramid(stacks[0].unionByName(stacks[1]))
    for k, shape in enumerate(shapes):
        alone = image(pyramid.focus_stack_pyramid(stacks[k]), shape)
        assert np.array_equal(image(both.filter(F.col("stack_id") == k), shape), alone) and alone.std() > 1


def test_pixels_of_a_pyramid_do_not_go_to_the_driver(spark):
    """files of a coarse level are small, what is grown of it is not."""
    detail = pyramid.laplacian_pyramid(table(spark, {0: texture(40, 70), 1: texture(40, 70, 2)}), 1)[0]
    level = detail.select("stack_id", "frame_idx", "y", "x", "h", "w", "b", "g", "r")
    image = pyramid.collapse([level.filter("frame_idx = 0"), level.filter("frame_idx = 1")])
    for df in (detail, image):  # sizes of stacks are sent to all, pixels are not
        joins = [line for line in plan(df).splitlines() if "Join" in line and " y#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_levels_of_a_pyramid_are_shuffled_at_any_size(spark):
    """the whole query, over a small table whose grown pixels Spark takes for smaller than they are."""
    found = plan(__spark_entry__.queries()["W5_laplacian_pyramid"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in found and not any("BroadcastHashJoin" in line and " y#" in line for line in found.splitlines())


def test_parts_of_a_depth_map_are_written_a_few_at_a_time(spark, monkeypatch):
    """what is read again for norms and for blending."""
    files, write = {}, scratch.written

    def written(df, name, **options):
        files[name] = out = write(df, name, **options)
        return out

    monkeypatch.setattr(depthmap, "written", written)
    frames = table(spark, {f: texture(8, 9, f) for f in range(40)}).coalesce(1)
    depthmap.focus_stack_depthmap(frames, levels=2)
    assert files["parts"].count() == 40
    assert all(most_rows(f.removeprefix("file://") for f in files[name].inputFiles()) <= 16 for name in ("parts", "norms", "blend"))


def test_pixels_of_a_stack_stay_in_their_tasks(spark, monkeypatch):
    """joined with their stack's size, and not shuffled by stack for it."""
    seen = parts_from(monkeypatch)
    pyramid.focus_stack_pyramid(table(spark, {0: texture(40, 70), 1: texture(40, 70, 2)}), 1)
    assert "BroadcastHashJoin" in plan(seen[0]) and "Exchange hashpartitioning" not in plan(seen[0])


@pytest.mark.parametrize("taps", [(1, 5, 8, 5, 1), (1, 4, 6, 4, 1)])
def test_half_and_double_sizes_by_definition(taps):
    """only the rows and columns that stay are worked out, and zeros are not laid out."""
    random = np.random.default_rng(3)
    for _ in range(300):
        sizes = [int(v) for v in random.integers(4, 30, 2)]
        halves = [(v + 1) // 2 for v in sizes]
        a, b = random.normal(size=(3, *sizes)), random.normal(size=(3, *halves))
        wants = [tuple(sorted(int(v) for v in random.choice(n + 1, 2, replace=False))) for n in halves]
        rows, columns = (tiles.mirrored(np.arange(2 * lo - 2, 2 * hi + 1), n) for (lo, hi), n in zip(wants, sizes))
        want = tiles.convolved(a[:, rows[:, None], columns], taps)[:, ::2, ::2] / float(sum(taps) ** 2)
        assert np.array_equal(tiles.reduced(a, [(0, n) for n in sizes], wants, sizes, taps), want)
        wants = [tuple(sorted(int(v) for v in random.choice(n + 1, 2, replace=False))) for n in sizes]
        zeros = np.zeros((3, *(2 * n for n in halves)))
        zeros[:, ::2, ::2] = b
        rows, columns = (tiles.mirrored(np.arange(lo - 2, hi + 2), 2 * n) for (lo, hi), n in zip(wants, halves))
        want = tiles.convolved(zeros[:, rows[:, None], columns], taps) * (4.0 / sum(taps) ** 2)
        assert np.array_equal(tiles.expanded(b, [(0, n) for n in halves], wants, halves, taps), want)
