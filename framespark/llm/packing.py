"""Packing of token sequences into as few fixed-length sequences as can be, certified by lower bounds.

Lengths are packed by best-fit decreasing within groups of bounded size. Dual-feasible functions give each group a
lower bound on its bins; where the bins exceed it, the documents of the group's bins that are not full are dealt out
to new, fewer groups and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .tokenfile import encode_batches, token_width

#: Pieces that one task packs at once.
GROUP = 5_000


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of the dual-feasible functions f_e (e from 0 to capacity/2) on the bins for these lengths.

    f_e lifts lengths over capacity - e to the capacity, drops those under e, and keeps the others; whatever fits
    one bin still fits one bin afterwards, so the lifted total over the capacity bounds the bins from below.
    """
    return _bound(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64))


def _bound(count: np.ndarray) -> int:
    """``lower_bound`` from the number of documents of each length."""
    capacity = len(count) - 1
    many, mass = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    e = np.arange(capacity // 2 + 1)
    over = many[capacity] - many[capacity - e]
    below = np.where(e > 0, mass[e - 1], 0)
    total = over * capacity + mass[capacity - e] - below
    return int(-(-total.max() // capacity))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length by best-fit decreasing; ties in length go by position."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, at, used = capacity, used, used + 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins, offsets


def _packer(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        at, offset = best_fit(lengths, capacity)
        fill = np.bincount(at, weights=lengths).astype(np.int64)
        certified = len(fill) == lower_bound(lengths, capacity)
        return pd.DataFrame(
            {
                "key": pdf["key"], "length": lengths, "grp": pdf["grp"], "bin": at, "offset": offset,
                "done": certified | (fill[at] == capacity), "certified": certified,
            }
        )

    return run


PACKED = "key string, length long, grp long, bin long, offset long, done boolean, certified boolean"


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """``pieces(key, length)`` with unique keys and 1 <= length <= capacity to ``key, sequence_id, offset, certified``.

    Every round packs groups by themselves. A group whose bins are as many as its lower bound is certified and stays; of
    the others all full bins stay, and the documents of their other bins are dealt out to new groups. Rounds go on while
    they lower the number of bins; what the last one has is kept. ``certified`` marks documents of full bins and of
    groups that met their bound. No pieces, no rows; a null length is an error.
    """
    full = pieces.filter(F.col("length") == capacity).select(
        "key", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    rest = pieces.filter(F.col("length") < capacity).select("key", "length")
    n, out, base, step, before, left = rest.count(), full, 0, 0, None, None
    while n:
        groups = -(-n // group)
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(step)), F.lit(groups)))
        packed = materialize(dealt.groupBy("grp").applyInPandas(_packer(capacity), PACKED), "packed")
        # a group has at most as many bins as pieces, and hashing keeps it near its mean
        packed = packed.withColumn("sequence_id", 2 * (F.lit(base) + F.col("grp") * (1 << 32) + F.col("bin")))
        base, step = base + (groups << 32), step + 1
        bins = packed.filter("offset = 0").agg(F.count("*"), F.count_if(~F.col("done"))).first()
        # one group can't do better by itself; a round that lowers nothing is the last one
        last = groups == 1 or not bins[1] or (before is not None and bins[0] >= before)
        settled = left if before is not None and bins[0] > before else packed if last else packed.filter("done")
        out = out.unionByName(settled.select("key", "sequence_id", "offset", F.col("done").alias("certified")))
        if last:
            break
        left = packed.filter("not done")
        rest, n, before = left.select("key", "length"), left.count(), bins[1]
    return out


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """(sequences used, the lower bound on them) of rows with ``length, sequence_id, offset``: from at most ``capacity``
    counts, so it costs one pass. Equal numbers certify the whole packing as the best there is."""
    used = packed.filter("offset = 0").count()
    rows = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["n"]
    return used, _bound(count)


def cut_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32): every document's ids with ``end_id``, cut only if over ``capacity``.

    All pieces of a cut document but the first have ``capacity`` ids. ``key`` names a row's piece: rows that repeat
    an id get keys of their own.
    """
    width = token_width(tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for names, encoded in encode_batches(batches, tokenizer_file, end_id):
            rows = []
            for doc, raw in zip(names.to_pylist(), encoded.to_pylist(), strict=True):
                ids = np.frombuffer(raw, width).astype("<u4")
                head = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((f"{task}.{row}.{k}", doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi])))
                row += 1
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", id_col, "piece", "start", "length", "ids_crc32"]
            )

    schema = f"key string, {id_col} long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 0,
    capacity: int = 2048,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset, certified`` (see ``pack``).

    Null and empty texts are a piece of the end id alone. A null id is carried along. Rows that repeat an id are
    packed as documents of their own. Other columns are ignored; no rows give no pieces.
    """
    pieces = materialize(
        cut_documents(docs, tokenizer_file, end_id, capacity, id_col, text_col), "pieces"
    )
    placed = pack(pieces, capacity, group)
    return pieces.join(placed, "key").select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"
    )
