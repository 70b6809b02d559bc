"""Near-duplicate vectors: an exact similarity join by pigeonhole over blocks of rotated components.

Unit vectors with cosine c are at squared distance 2 - 2c. After a rotation the components are cut into blocks of a
few dimensions each; if a pair's squared distance is within the budget of the join, then in some block its part is
within that block's proportional share. So each block is range-joined on its own, by a grid over the block's first
components, on rows that carry the block's components alone. Only rows that met someone there fetch their vectors, and
the candidates are verified on the original vectors. A pair is counted in the first block whose share it meets, so no
list of pairs is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet_in_blocks
from .components import connected_components
from .storage import materialize
from .vectors import lists, matrix, rotation
from .worker import begin_task

BLOCK_DIMS = 8
GRID_DIMS = 3
#: Rows of one side that meet in one task; fuller cells are cut into stretches that meet pairwise.
CELL_ROWS = 2048
#: What rounding may add to the squared distance of two parts.
ROUNDING = 1e-9

Blocks = list[tuple[int, int, float]]


def _prepare(dim: int, turn: np.ndarray):
    """All rows; those that take part get a digest of their vector, the vector and its rotated unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x, places = matrix(batch.column(3), dim)
                u = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ turn
                slot = np.full(batch.num_rows, -1, np.int64)
                slot[places] = np.arange(len(places))
                at = pa.array(slot, mask=slot < 0)
                keys = pa.array([hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x + 0.0], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], keys.take(at), lists(x).take(at), lists(u).take(at)], ["row", "id", "label", "key", "v", "u"]
                )

    return run


def _cells(blocks: Blocks, width: float):
    """Each vector's cell in every block, and the later cells whose range its own range reaches into."""
    g = GRID_DIMS
    offsets = np.array([o for o in np.ndindex(*(3,) * g)]) - 1
    later = np.array([o for o in offsets if tuple(o) > (0,) * g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                u = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                for j, (lo, hi, budget) in enumerate(blocks):
                    d = min(g, hi - lo)
                    x, reach = u[:, lo : lo + d], np.sqrt(budget) * (1 + 1e-9) + ROUNDING
                    at = np.floor(x / width).astype(np.int64)
                    rows, cell = [np.arange(len(u))], [at]
                    for off in {tuple(o[:d]) for o in later if tuple(o[:d]) > (0,) * d}:
                        near = np.ones(len(u), bool)
                        for k, o in enumerate(off):
                            gap = (at[:, k] + 1) * width - x[:, k] if o > 0 else x[:, k] - at[:, k] * width
                            near &= gap <= reach if o else True
                        rows.append(np.flatnonzero(near))
                        cell.append(at[near] + np.array(off))
                    home = np.zeros(sum(map(len, rows)), bool)
                    home[: len(u)] = True
                    rows, cell = np.concatenate(rows), np.concatenate(cell)
                    code = ((cell + (1 << 19)) * np.array([1 << 40, 1 << 20, 1])[:d]).sum(axis=1)
                    which = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(which),
                            batch.column(1).take(which),
                            pa.array(np.full(len(rows), j), pa.int32()),
                            pa.array(code, pa.int64()),
                            pa.array(home),
                            lists(u[rows, lo:hi]),
                        ],
                        ["id", "label", "block", "cell", "home", "part"],
                    )

    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return pa.concat_arrays(table.column(name).chunks).flatten().to_numpy().reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two stretches of a cell, and whether they are one."""
    first, second, piece = table.column("first")[0].as_py(), table.column("second")[0].as_py(), table.column("piece").to_numpy()
    return np.flatnonzero(piece == first), np.flatnonzero(piece == second), first == second


def _near(part: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides whose parts are within the share, by steps of bounded size."""
    b = part[right]
    norm = (b * b).sum(axis=1)
    step = max(1, (1 << 20) // max(1, len(right)))
    for s in range(0, len(left), step):
        rows = left[s : s + step]
        a = part[rows]
        i, k = np.nonzero((a * a).sum(axis=1)[:, None] + norm - 2 * (a @ b.T) <= share + 2 * ROUNDING)
        yield rows[i], right[k]


def _once(home: np.ndarray, i: np.ndarray, k: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs count here: two visitors meet in a cell of their own, and a row of one stretch meets later ones."""
    once = home[i] | home[k]
    return once & (i < k) if same else once


FACING = "block int, cell long, label string, first int, second int, id long, home boolean, piece int"


def _facing(blocks: Blocks):
    """The rows that come near anyone in their block's components."""

    def run(table: pa.Table) -> pa.Table:
        left, right, same = _sides(table)
        home, met = table.column("home").to_numpy(), np.zeros(table.num_rows, bool)
        for i, k in _near(_column(table, "part"), left, right, blocks[table.column("block")[0].as_py()][2]):
            ok = _once(home, i, k, same)
            met[i[ok]] = met[k[ok]] = True
        return table.take(pa.array(np.flatnonzero(met))).select(["block", "cell", "label", "first", "second", "id", "home", "piece"])

    return run


def _join(blocks: Blocks, cosine: float):
    """Links of one cell: each row's number of links, and enough pairs to join the rows that they connect."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids, copies, home = (table.column(c).to_numpy() for c in ("id", "copies", "home"))
        v, u = _column(table, "v"), _column(table, "u")
        length = np.sqrt((v * v).sum(axis=1))
        j = table.column("block")[0].as_py()
        lo, hi, share = blocks[j]
        left, right, same = _sides(table)
        count, edges = np.zeros(n, np.int64), []
        for i, k in _near(u[:, lo:hi], left, right, share):
            ok = _once(home, i, k, same)
            i, k = i[ok], k[ok]
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], k[s : s + (1 << 16)]
                for e, (p, q, part) in enumerate(blocks[: j + 1]):
                    within = ((u[a, p:q] - u[b, p:q]) ** 2).sum(axis=1) <= part
                    ok = within if e == j else ~within
                    a, b = a[ok], b[ok]
                ok = (v[a] * v[b]).sum(axis=1) / (length[a] * length[b]) >= cosine
                a, b = a[ok], b[ok]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                label = np.arange(n)
                while True:  # the smallest row of each part of these links
                    low = np.minimum(label[a], label[b])
                    if (label[a] == low).all() and (label[b] == low).all():
                        break
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                moved = np.flatnonzero(label != np.arange(n))
                edges.append(np.column_stack((moved, label[moved])))
        edges = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(count)
        return pa.table(
            {
                "a": np.concatenate((ids[some], ids[edges[:, 0]])),
                "b": np.concatenate((ids[some], ids[edges[:, 1]])),
                "n": np.concatenate((count[some], np.zeros(len(edges), np.int64))),
            }
        )

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block_dims: int = BLOCK_DIMS,
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Linked are vectors of one label with a cosine of at least ``cosine``, in double precision. Vectors that are null,
    zero, of an uncommon length, or hold null or non-finite components, and rows without a label or id, link with
    nothing (their component is their own id, and they are kept). Rows that repeat an id are vectors of their own, with
    links of their own. Other columns are ignored; no rows give no rows.

    Equal vectors of a label are one node with a number of copies. Cells are cut into stretches of bounded size.
    """
    # a number for each row, fixed by being written: ids may be null or repeat
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    lengths = source.filter("v is not null").groupBy(F.size("v").alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), "dim").first()
    links, component = F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    if common is None or not common["dim"]:
        return source.select(F.col("id").alias(id_col), links, component, F.lit(True).alias("kept"))
    dim, budget = common["dim"], 2 - 2 * cosine
    cuts = [*range(0, dim, block_dims), dim]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < GRID_DIMS:
        del cuts[-2]
    # a tiny allowance covers the rounding of the rotation
    blocks = [(lo, hi, budget * (hi - lo) / dim + 1e-12) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    prepared = materialize(
        source.mapInArrow(
            _prepare(dim, rotation(dim)), "row long, id long, label string, key binary, v array<double>, u array<double>"
        ),
        "prepared",
    )
    takes_part = F.col("key").isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull()
    nodes = materialize(
        prepared.filter(takes_part)
        .groupBy("label", "key")
        .agg(
            F.min("row").alias("node"), F.min("id").alias("least"), F.any_value("v").alias("v"), F.any_value("u").alias("u"),
            F.count("*").alias("copies"),
        ),
        "nodes",
    )
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    # cells as wide as the longest reach at least; wider, and fewer copies of each row, while few rows share a label
    reach = max(np.sqrt(part) for _, _, part in blocks) + 2 * ROUNDING
    width = max(reach * (1 + 1e-6), 4 / np.sqrt(dim) / max(1.0, (most / CELL_ROWS) ** (1 / GRID_DIMS)))
    celled = materialize(
        nodes.select(F.col("node").alias("id"), "label", "u").mapInArrow(
            _cells(blocks, width), "id long, label string, block int, cell long, home boolean, part array<double>"
        ),
        "cells",
    )
    cell = ["label", "block", "cell"]
    meeting = meet_in_blocks(celled, cell, CELL_ROWS, "homes > 0 and rows > 1")
    group = [*cell, "first", "second"]
    facing = materialize(meeting.groupBy(*group).applyInArrow(_facing(blocks), FACING), "facing")
    # vectors grow with the input, so they are never broadcast
    fetched = facing.join(nodes.select(F.col("node").alias("id"), "v", "u", "copies").hint("merge"), "id")
    found = materialize(fetched.groupBy(*group).applyInArrow(_join(blocks, cosine), "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    labels = connected_components(found.filter("a <> b").select("a", "b"))
    # a component is named by the smallest id of its nodes, which are numbered by rows
    named = labels.join(nodes.select("node", "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    known = nodes.select("label", "key", "node", "least", "copies").join(counts, "node", "left")
    known = known.join(labels.join(names, "component").select("node", "name"), "node", "left").select(
        "label",
        "key",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("name", "least").alias("component_id"),
    )
    rows = prepared.select("id", "label", "key")
    linked = rows.filter(takes_part).join(known, ["label", "key"]).select("id", "n_links", "component_id")
    alone = rows.filter(~takes_part).select("id", links, component)
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
