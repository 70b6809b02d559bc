"""Frames as rows of tiles, and pyramid fusion from tile to tile.

A tile row holds a square of a frame (``side`` x ``side``, less at the far ends) for its three colours in one binary column.
Work on a tile needs a margin of its neighbours' pixels: tasks deal out *parts*, packed pixels of one frame for one tile, so
a shuffle moves a few large rows, the tile's own pixels once and border strips to its neighbours. A task meets the parts of
a tile in the order of frames and holds one frame and the winners so far, however many frames there are.

A pass works out ``STEP`` levels of a pyramid at once; what it hands on, the next coarse level, is a 64th of its input.
Stacks may differ in shape: ``left`` tells how many levels a row's frame still has, and rows with none are put aside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written
from .stencil import GENERATING

#: The side of a tile (a multiple of 2**STEP) and the levels of a pass.
SIDE, STEP = 256, 3
#: Bytes of parts that a task gathers before it hands them on, and of tile rows that go to a Python worker at once: Spark
#: holds a few copies of these, and by itself sends 64 MB.
GATHER, BATCH = 24 << 20, 8 << 20
BGR = ("b", "g", "r")
#: Pixels beyond a tile that ``n`` levels need at its finest one: details are wanted two pixels beyond it, their energies
#: two more, and every reduction doubles what it needs and adds two.
MARGIN = [3, 8, 18, 38]
#: Pixels beyond a tile that rebuilding the image needs, at every level but the finest.
AROUND = 2


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    at = np.abs(at)
    return np.where(at >= size, 2 * (size - 1) - at, at)


def taken(planes: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """Rows (axis -2) or columns (axis -1) at some places; a view where these follow each other, as away from the ends."""
    if len(at) and at[-1] - at[0] == len(at) - 1 and (np.diff(at) == 1).all():
        some = slice(at[0], at[-1] + 1)
        return planes[..., some, :] if axis == -2 else planes[..., some]
    return np.take(planes, at, axis)


def convolved(planes: np.ndarray, taps: Sequence[float]) -> np.ndarray:
    """Planes (…, y, x) convolved along both axes, without their margins."""
    return convolved_by(planes, taps, taps)


def convolved_by(planes: np.ndarray, taps_y: Sequence[float], taps_x: Sequence[float]) -> np.ndarray:
    for axis, taps in ((-2, taps_y), (-1, taps_x)):
        n, total = planes.shape[axis] - len(taps) + 1, None
        for k, tap in enumerate(taps):
            part = planes[..., k : k + n, :] if axis == -2 else planes[..., k : k + n]
            total = added(total, part, tap)
        planes = total
    return planes


def added(total: np.ndarray | None, part: np.ndarray, tap: float) -> np.ndarray:
    if total is None:
        return part * tap
    total += part * tap
    return total


class Span:
    """A tile along one axis at every level of a pass: sizes of the frame and ranges of the tile."""

    def __init__(self, tile: int, size: int, levels: int, side: int = SIDE) -> None:
        self.size, self.own = [size], [(tile * side, min((tile + 1) * side, size))]
        for k in range(levels):
            self.size.append((self.size[k] + 1) // 2)
            lo = self.own[k][0] // 2
            self.own.append((lo, min((tile + 1) * side >> (k + 1), self.size[-1])))

    def around(self, level: int, margin: int) -> tuple[int, int]:
        lo, hi = self.own[level]
        return max(0, lo - margin), min(self.size[level], hi + margin)


def cut(planes: np.ndarray, has: list[tuple[int, int]], wants: list[tuple[int, int]]) -> np.ndarray:
    (y, _), (x, _) = has
    return planes[..., wants[0][0] - y : wants[0][1] - y, wants[1][0] - x : wants[1][1] - x]


def reduced(planes: np.ndarray, has: list[tuple[int, int]], wants: list[tuple[int, int]], sizes: list[int], taps: Sequence[float]) -> np.ndarray:
    """The next level over ``wants``, from ``planes`` over ``has`` of a frame with ``sizes``."""
    r = len(taps) // 2
    at = [mirrored(np.arange(2 * lo - r, 2 * (hi - 1) + r + 1), size) - h[0] for (lo, hi), h, size in zip(wants, has, sizes, strict=True)]
    planes, (rows, columns) = taken(taken(planes, at[0], -2), at[1], -1), [hi - lo for lo, hi in wants]
    for axis, n in ((-2, rows), (-1, columns)):  # every other row and column alone
        total = None
        for k, tap in enumerate(taps):
            some = slice(k, k + 2 * n - 1, 2)
            total = added(total, planes[..., some, :] if axis == -2 else planes[..., some], tap)
        planes = total
    return planes / float(sum(taps) ** 2)


def expanded(planes: np.ndarray, has: list[tuple[int, int]], wants: list[tuple[int, int]], sizes: list[int], taps: Sequence[float]) -> np.ndarray:
    """A level at twice its size over ``wants``: zeros between, on a grid of exactly twice ``sizes``, convolved, times 4.

    Mirroring keeps even places even, so places of one parity get every other tap of the same run of values, and the zeros
    need not be laid out.
    """
    r = len(taps) // 2
    for axis, (lo, hi), h, size in zip((-2, -1), wants, has, sizes, strict=True):
        first = (lo - r) % 2  # of the places from lo - r on, the first even one
        values = taken(planes, mirrored(np.arange(lo - r + first, hi + r, 2), 2 * size) // 2 - h[0], axis)
        shape = list(values.shape)
        shape[axis] = hi - lo
        planes = np.zeros(shape)
        for parity in (0, 1):
            n, total = (hi - lo - parity + 1) // 2, None
            for k in range((first + parity) % 2, len(taps), 2):
                at = (parity + k - first) // 2
                total = added(total, values[..., at : at + n, :] if axis == -2 else values[..., at : at + n], taps[k])
            if n and total is not None:
                if axis == -2:
                    planes[..., parity::2, :] = total
                else:
                    planes[..., parity::2] = total
    return planes * (4.0 / sum(taps) ** 2)


def sizes(px: DataFrame, keys: Sequence[str] = ("stack_id",), **more: Column) -> DataFrame:
    """``keys``, ``h`` and ``w`` of every stack, and what ``more`` makes of these, written: Spark then knows that they are
    few, and a join with them leaves the pixels in the tasks they are in. Shuffled by stack, all pixels of a stack would go
    to one task; and what is said of a stack is worked out once, not for each of its pixels."""
    size = px.groupBy(*keys).agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"))
    return written(size.withColumns(more) if more else size, "sizes")


def sized(px: DataFrame, keys: Sequence[str] = ("stack_id",)) -> DataFrame:
    """``with_size`` by written sizes."""
    return px.drop("h", "w").join(sizes(px, keys), list(keys))


def in_batches(rows: DataFrame) -> DataFrame:
    """Rows of tiles on their way to Python: their bytes at once are bounded, unless the session says otherwise."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH)
    return rows


class Parts:
    """Packed pixels on their way to tiles."""

    def __init__(self, schema: pa.Schema, keys: Sequence[str], side: int) -> None:
        self.schema, self.keys, self.side = schema, keys, side
        self.held: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.bytes = 0

    def add(self, head: tuple, y: np.ndarray, x: np.ndarray, planes: np.ndarray, h: int, w: int, margin: int, side: int) -> Iterator[pa.RecordBatch]:
        """Pixels of one frame, ``planes`` of shape (…, n); ``head`` are the values of ``keys`` and what goes with them."""
        ys, xs = [], []
        for at, size, out in ((y, h, ys), (x, w, xs)):
            last = (size - 1) // side
            first, final = np.clip((at - margin) // side, 0, last), np.clip((at + margin) // side, 0, last)
            for k in range(int((final - first).max(initial=0)) + 1):
                out.append((first + k, first + k <= final))
        for ty, in_y in ys:
            for tx, in_x in xs:
                mine = np.flatnonzero(in_y & in_x)
                code = ty[mine] * (1 << 32) + tx[mine]
                order = np.argsort(code, kind="stable")
                code, mine = code[order], mine[order]
                edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    some = mine[lo:hi]
                    key = (*head, h, w, int(code[lo] >> 32), int(code[lo] & 0xFFFFFFFF))
                    part = y[some].astype("<i4"), x[some].astype("<i4"), np.ascontiguousarray(planes[:, some])
                    self.held.setdefault(key, []).append(part)
                    self.bytes += sum(a.nbytes for a in part)
        if self.bytes > GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for key, parts in self.held.items():
            y, x = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            planes = np.concatenate([p[2] for p in parts], axis=1)
            rows.append((*key, len(y), planes.dtype.str, y.tobytes() + x.tobytes() + planes.tobytes()))
            total += planes.nbytes
            if total > 1 << 23:
                yield self._batch(rows)
                rows, total = [], 0
        if rows:
            yield self._batch(rows)
        self.held, self.bytes = {}, 0

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, data = row["n"], row["data"]
    y, x = np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i4", n, 4 * n)
    return y, x, np.frombuffer(data, row["kind"], offset=8 * n).reshape(-1, n)


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _part_schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    types = {f.name: f.dataType for f in df.schema}
    schema = StructType()
    for k in keys:
        schema = schema.add(k, types[k])
    for c in ("frame_idx", "left", "h", "w", "ty", "tx", "n"):
        schema = schema.add(c, "long")
    return schema.add("kind", "string").add("data", "binary")


def parts_of_pixels(px: DataFrame, keys: Sequence[str], margins: Sequence[int] = MARGIN, side: int = SIDE, shrink: bool = False, planes: Sequence[str] = BGR) -> DataFrame:
    """Parts of pixel rows ``keys, frame_idx, y, x, h, w, left`` and ``planes``: a row for each frame and tile of a task.

    With ``shrink`` tiles have ``side`` at the level that these pixels rebuild, ``min(left, STEP)`` levels finer.
    """
    names = [*keys, "frame_idx", "left", "h", "w", "y", "x", *planes]
    schema = _part_schema(px, keys)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(arrow, keys, side)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for c in names[: len(keys) + 4]:
                values = batch.column(c).dictionary_encode()
                codes = codes * (len(values.dictionary) + 1) + values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
            y, x = (batch.column(c).to_numpy().astype(np.int64) for c in "yx")
            values = np.stack([batch.column(c).to_numpy() for c in planes])
            if values.dtype.kind in "iu" and values.min() >= 0 and values.max() < 1 << 16:
                values = values.astype("<u2")
            for lo, hi in zip(edges[:-1], edges[1:]):
                mine = order[lo:hi]
                head = tuple(batch.column(c)[int(mine[0])].as_py() for c in names[: len(keys) + 2])
                h, w = (int(batch.column(c)[int(mine[0])].as_py()) for c in ("h", "w"))
                n = min(head[-1], STEP)
                yield from parts.add(head, y[mine], x[mine], values[:, mine], h, w, margins[n], side >> n if shrink else side)
        yield from parts.flush()

    return px.select(*names).mapInArrow(run, schema)


def tile_schema(df: DataFrame, keys: Sequence[str]) -> StructType:
    types = {f.name: f.dataType for f in df.schema}
    schema = StructType()
    for k in keys:
        schema = schema.add(k, types[k])
    for c in ("frame_idx", "left", "h", "w", "y0", "x0", "rows", "columns"):
        schema = schema.add(c, "long")
    return schema.add("data", "binary")


def parts_of_tiles(tiles: DataFrame, keys: Sequence[str], margins: Sequence[int] = MARGIN, side: int = SIDE, shrink: bool = False) -> DataFrame:
    """Parts of tile rows (see ``pack_tiles``)."""
    schema = _part_schema(tiles, keys)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(arrow, keys, side)
        for row in rows_of(batches):
            planes = np.frombuffer(row["data"], "<f8").reshape(-1, row["rows"] * row["columns"])
            y = np.repeat(row["y0"] + np.arange(row["rows"]), row["columns"])
            x = np.tile(row["x0"] + np.arange(row["columns"]), row["rows"])
            n = min(row["left"], STEP)
            head = tuple(row[c] for c in (*keys, "frame_idx", "left"))
            yield from parts.add(head, y, x, planes, row["h"], row["w"], margins[n], side >> n if shrink else side)
        yield from parts.flush()

    return in_batches(tiles.select(*keys, "frame_idx", "left", "h", "w", "y0", "x0", "rows", "columns", "data")).mapInArrow(run, schema)


def met(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts dealt out by tile, a tile's parts in the order of frames. Rows are few and large."""
    return in_batches(parts.repartition(*keys, "ty", "tx").sortWithinPartitions(*keys, "ty", "tx", "frame_idx"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = [(c, batch.column(c)) for c in batch.schema.names]
        for i in range(batch.num_rows):
            yield {c: values[i].as_py() for c, values in columns}


def frames_of_tiles(batches: Iterator[pa.RecordBatch], keys: Sequence[str], reach) -> Iterator[tuple[dict, list[tuple[int, int]], np.ndarray]]:
    return frames_of_rows(rows_of(batches), keys, reach)


def frames_of_rows(rows: Iterator[dict], keys: Sequence[str], reach) -> Iterator[tuple[dict, list[tuple[int, int]], np.ndarray]]:
    """(head, ranges, planes) of every frame of every tile in turn; ``reach(head)`` gives the spans along y and x and the
    margin. Parts come in the order of ``met``."""
    head, planes, has, ident = None, None, None, None
    for row in rows:
        mine = tuple(row[c] for c in (*keys, "ty", "tx", "frame_idx"))
        if mine != ident:
            if head is not None:
                yield head, has, planes
            ident, head = mine, {c: row[c] for c in (*keys, "ty", "tx", "frame_idx", "left", "h", "w")}
            spans, margin = reach(head)
            has = [s.around(0, margin) for s in spans]
            planes = None
        y, x, values = unpacked(row)
        if planes is None:
            planes = np.zeros((len(values), *(hi - lo for lo, hi in has)))
        inside = (y >= has[0][0]) & (y < has[0][1]) & (x >= has[1][0]) & (x < has[1][1])
        planes[:, y[inside] - has[0][0], x[inside] - has[1][0]] = values[:, inside]
    if head is not None:
        yield head, has, planes


def pack_tiles(px: DataFrame, keys: Sequence[str] = ("stack_id",), side: int = SIDE) -> DataFrame:
    """Pixel rows ``keys, frame_idx, y, x, h, w, b, g, r`` as tile rows: ``keys, frame_idx, left, h, w, y0, x0, rows,
    columns, data``. ``data`` holds the three planes as doubles, little-endian, row by row; ``left`` is null."""
    schema = tile_schema(px, keys)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reach(head):
            return [Span(head["ty"], head["h"], 0, side), Span(head["tx"], head["w"], 0, side)], 0

        for head, has, planes in frames_of_tiles(batches, keys, reach):
            yield tile_row(arrow, keys, head, None, head["h"], head["w"], has, planes)

    parts = parts_of_pixels(px.withColumn("left", F.lit(0).cast("long")), keys, [0] * 4, side)
    return met(parts, keys).mapInArrow(run, schema)


def tile_row(arrow: pa.Schema, keys: Sequence[str], head: dict, left, h: int, w: int, has: list[tuple[int, int]], planes: np.ndarray) -> pa.RecordBatch:
    (y0, y1), (x0, x1) = has
    values = [*(head[k] for k in keys), head["frame_idx"], left, h, w, y0, x0, y1 - y0, x1 - x0, np.ascontiguousarray(planes, "<f8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)


def unpack_tiles(
    tiles: DataFrame, keys: Sequence[str] = ("stack_id",), frames: bool = True, whole: int | None = None, signed: bool = False
) -> DataFrame:
    """Pixel rows of tile rows: ``keys, frame_idx (if frames), y, x, h, w, b, g, r`` as doubles, or with ``whole`` as whole
    numbers up to it, without ``h`` and ``w``: of the magnitudes, or with ``signed`` 0 for what is negative."""
    types = {f.name: f.dataType for f in tiles.schema}
    names = [*keys, *(["frame_idx"] if frames else [])]
    schema = StructType()
    for k in names:
        schema = schema.add(k, types[k])
    for c in ("y", "x") if whole else ("y", "x", "h", "w"):
        schema = schema.add(c, "long")
    for c in BGR:
        schema = schema.add(c, "long" if whole else "double")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n = row["rows"] * row["columns"]
                planes = np.frombuffer(row["data"], "<f8").reshape(3, n)
                if whole:
                    planes = np.maximum(planes, 0) if signed else np.abs(planes)
                    planes = np.floor(np.round(np.minimum(planes, whole), 6)).astype(np.int64)
                done = [pa.repeat(batch.column(k)[i], n) for k in names]
                done += [pa.array(np.repeat(row["y0"] + np.arange(row["rows"]), row["columns"])), pa.array(np.tile(row["x0"] + np.arange(row["columns"]), row["rows"]))]
                if not whole:
                    done += [pa.repeat(pa.scalar(row[c], pa.int64()), n) for c in ("h", "w")]
                yield pa.RecordBatch.from_arrays([*done, *map(pa.array, planes)], schema=arrow)

    return in_batches(tiles.select(*names, "h", "w", "y0", "x0", "rows", "columns", "data")).mapInArrow(run, schema)


def reductions(h: Column, w: Column, min_size: int = 32) -> Column:
    """The levels of a pyramid of a frame: reductions until the smaller side nears ``min_size``; none leaves a side below 4."""
    least = F.least(h, w)
    wanted = F.when(least > min_size, F.floor(F.log2(least / float(min_size)))).otherwise(0)
    possible = F.size(F.filter(F.sequence(F.lit(1), F.lit(40)), lambda k: F.ceil(least / F.pow(F.lit(2.0), k)) >= 4))
    return F.least(wanted, possible).cast("long")


def _gray(planes: np.ndarray) -> np.ndarray:
    return 0.299 * planes[2] + 0.587 * planes[1] + 0.114 * planes[0]


def fuse_details(parts: DataFrame, keys: Sequence[str], digits: int = 6, side: int = SIDE) -> DataFrame:
    """A pass over the next ``min(left, STEP)`` levels: tile rows of the winners' details (null ``frame_idx``, the data of
    all levels one after the other, with ``AROUND`` pixels around the tile but at the finest level) and tile rows of each
    frame's next coarse level.

    At each place and level wins the frame with the most energy (the smoothed square of the gray detail, to ``digits``
    digits), of equal ones the first.
    """
    schema = tile_schema(parts, keys)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, best, spans = None, [], []

        def reach(head):
            n = min(head["left"], STEP)
            return [Span(head["ty"], head["h"], n, side), Span(head["tx"], head["w"], n, side)], MARGIN[n]

        def winners() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([planes.reshape(-1) for _, planes in best])
            where = [s.own[0] for s in spans]
            yield tile_row(arrow, keys, {**tile, "frame_idx": None}, tile["left"], tile["h"], tile["w"], where, data)

        for head, has, planes in frames_of_tiles(batches, keys, reach):
            mine = tuple(head[c] for c in (*keys, "ty", "tx"))
            if tile is None or mine != tuple(tile[c] for c in (*keys, "ty", "tx")):
                if best:
                    yield from winners()
                tile, best, spans = head, [], reach(head)[0]
            n = min(head["left"], STEP)
            fresh = not best
            for k in range(n):
                sizes = [s.size[k] for s in spans]
                wants = [s.around(k + 1, MARGIN[n - k - 1]) for s in spans]
                coarse = reduced(planes, has, wants, sizes, GENERATING)
                detail_at = [s.around(k, 2 + (AROUND if k else 0)) for s in spans]
                detail = cut(planes, has, detail_at) - expanded(coarse, wants, detail_at, [s.size[k + 1] for s in spans], GENERATING)
                out_at = [s.around(k, AROUND if k else 0) for s in spans]
                rows, columns = (mirrored(np.arange(lo - 2, hi + 2), size) - d[0] for (lo, hi), size, d in zip(out_at, sizes, detail_at))
                gray = _gray(detail)
                energy = np.round(convolved((gray * gray)[rows[:, None], columns], GENERATING) / 400, digits)
                detail = cut(detail, detail_at, out_at)
                if fresh:
                    best.append((energy, detail.copy()))
                else:
                    most, kept = best[k]
                    wins = energy > most
                    most[wins] = energy[wins]
                    kept[:, wins] = detail[:, wins]
                planes, has = coarse, wants
            own = [s.own[n] for s in spans]
            yield tile_row(arrow, keys, head, head["left"] - n, spans[0].size[n], spans[1].size[n], own, cut(planes, has, own))
        if best:
            yield from winners()

    return met(parts, keys).mapInArrow(run, schema)


def rebuild(details: DataFrame, parts: DataFrame, keys: Sequence[str], taps: Sequence[float] = GENERATING, side: int = SIDE) -> DataFrame:
    """Tile rows of images ``min(left, STEP)`` levels finer: ``parts`` of the coarse images (see ``shrink``) meet the tile
    rows of ``details``."""
    schema = tile_schema(details, keys)
    arrow = arrow_schema(schema)
    types = {f.name: f.dataType for f in details.schema}
    held = details.select(
        *keys, F.lit(-1).cast("long").alias("frame_idx"), "left", "h", "w", F.expr(f"y0 div {side}").alias("ty"), F.expr(f"x0 div {side}").alias("tx"),
        F.lit(0).cast("long").alias("n"), F.lit("").alias("kind"), "data",
    )
    parts = parts.withColumn("frame_idx", F.lit(0).cast("long"))
    assert types["data"].typeName() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, spans, coarse, wants = None, [], None, []

        def image() -> pa.RecordBatch:
            n, shapes = min(tile["left"], STEP), []
            for k in range(n):
                shapes.append([s.around(k, AROUND if k else 0) for s in spans])
            data, at, planes, has = np.frombuffer(tile["data"], "<f8"), [0], coarse, wants
            for (y0, y1), (x0, x1) in shapes:
                at.append(at[-1] + 3 * (y1 - y0) * (x1 - x0))
            for k in range(n - 1, -1, -1):
                shape = [hi - lo for lo, hi in shapes[k]]
                detail = data[at[k] : at[k + 1]].reshape(3, *shape)
                planes, has = detail + expanded(planes, has, shapes[k], [s.size[k + 1] for s in spans], taps), shapes[k]
            return tile_row(arrow, keys, {**tile, "frame_idx": None}, None, tile["h"], tile["w"], has, planes)

        for row in rows_of(batches):
            if row["frame_idx"] == -1:  # the details come first
                if tile is not None:
                    yield image()
                tile, n = row, min(row["left"], STEP)
                spans = [Span(row["ty"], row["h"], n, side), Span(row["tx"], row["w"], n, side)]
                wants = [s.around(n, AROUND) for s in spans]
                coarse = np.zeros((3, *(hi - lo for lo, hi in wants)))
                continue
            y, x, values = unpacked(row)
            inside = (y >= wants[0][0]) & (y < wants[0][1]) & (x >= wants[1][0]) & (x < wants[1][1])
            coarse[:, y[inside] - wants[0][0], x[inside] - wants[1][0]] = values[:, inside]
        if tile is not None:
            yield image()

    return met(held.unionByName(parts), keys).mapInArrow(run, schema)
